"""Finding every window of a fixed length that occurs more than once in a corpus, for op5 (bytes) and op6 (words).

A window of `window` symbols holds window - gram + 1 grams of `gram` symbols; its smallest gram hash is its anchor, and
equal windows have their anchors at the same place. So instead of every position only anchors (about two in
window - gram + 2 positions) travel:

1. `anchors`: per document, each anchor's gram hash and the hash of its context, which holds all windows around it. Those
   of a task that share a whole context are settled there, and one of them travels (for each of the smallest document's
   places), so that copies don't make a hot group. They are dealt by ranges of the gram hash, packed in blobs (a row a range
   and task), and sorted there.
2. `decide`: anchors whose gram is unique are dropped. Those whose whole context is repeated are settled at once. What
   remains are the ends of repeated passages: their contexts are fetched from the texts, and
3. `refine`, given by the operator, finds which windows of the contexts that share a gram are repeated. Equal windows
   always meet, as they share their anchor's gram.
4. `finish` turns the settled intervals of each document into the operator's result.

Every step deals its rows into buckets of about BUCKET bytes of text, so memory stays bounded as the corpus grows.
Hashes have 48 bits or more beyond the bucket's, and only compare anchors that share a gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.common import release, slices, store, tidied, utf8

#: Bytes of text that a kernel works on at once, bytes of text a bucket, anchors that a task gathers before it deals them.
PART, BUCKET, GATHER = 1 << 20, 4 << 20, 1 << 19
_LOW = np.uint64((1 << 48) - 1)
_BLOB = "bucket int, kind string, doc_id long, text string, a binary, b binary, c binary, d binary, e binary"
_NAMES = [x.split()[0] for x in _BLOB.split(", ")]
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("doc_id", pa.int64()), ("text", pa.string()), *((c, pa.binary()) for c in "abcde")])


@dataclass(frozen=True)
class Spec:
    """What a symbol is ("bytes" or "words"), and the lengths of window and gram in symbols."""

    symbols: str
    window: int
    gram: int
    #: whether a window counts only if it also starts in a document with a smaller id
    earlier: bool

    @property
    def reach(self) -> int:
        return self.window - self.gram


def symbols(spec: Spec, at: np.ndarray, data: np.ndarray):
    """Symbol values (64 bits) of the texts, each text's first symbol (n + 1), and for words their starts and ends."""
    if spec.symbols == "bytes":
        return W._BYTE[data[at[0] : at[-1]]], at - at[0], None
    starts, ends, h, first = W.words(at, data)
    return h, first, (starts, ends)


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """best of each `width` consecutive items."""
    step = 1
    while 2 * step <= width:
        a = best(a[:-step], a[step:])
        step *= 2
    return best(a[: len(a) - (width - step)], a[width - step :]) if step < width else a


def anchors(spec: Spec, v: np.ndarray, first: np.ndarray):
    """Of the symbols `v` of several texts: (text number, place in the text, gram hash, context hash) of each anchor."""
    none = np.zeros(0, np.int64)
    n, g, k = len(v), spec.gram, spec.reach + 1
    if n < spec.window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = W.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(v * up[:-1], out=total[1:])
    h = W.mix((total[g:] - total[:-g]) * down[: n - g + 1])
    least = _slide(h, k, np.minimum)
    # windows that lie in one text
    inside = np.zeros(len(least), bool)
    size = np.diff(first)
    for a, m in zip(first[:-1][size >= spec.window].tolist(), size[size >= spec.window].tolist()):
        inside[a : a + m - spec.window + 1] = True
    least[~inside] = 0
    most = _slide(np.concatenate([np.zeros(k - 1, np.uint64), least, np.zeros(k - 1, np.uint64)]), k, np.maximum)
    p = np.flatnonzero(most[: len(h)] == h)
    text = np.searchsorted(first, p, "right") - 1
    start, end = np.maximum(first[text], p - spec.reach), np.minimum(first[text + 1], p + g + spec.reach)
    context = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * W.PLACE[1] + (p - start).astype(np.uint64) * W.PLACE[2]
    return text, p - first[text], h[p], W.mix(context)


def _row(bucket: int, kind: str, *columns: np.ndarray) -> tuple:
    return (bucket, kind, None, None, *(c.tobytes() for c in columns), *[None] * (5 - len(columns)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def _deal(kind: str, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """A row a bucket with the columns' items that go there, in their order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    columns = [c[order] for c in columns]
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
        yield _row(int(bucket[a]), kind, *(c[a:b] for c in columns))


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences: small numbers that compress well."""
    return np.diff(a, prepend=a.dtype.type(0))


def _six(a: np.ndarray) -> np.ndarray:
    """Six bytes of each 64-bit number."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _eight(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _gram_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """(doc_id, text) with distinct ids in the order of doc_id, what they stand for if they are new, and the number of buckets."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, rows, given = d.agg(F.sum(F.octet_length("text")), F.count("*"), F.count("doc_id")).first()
    buckets = _prime(max(3, -(-(total or 0) // BUCKET)))
    if given == rows and d.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return d, None, buckets
    # rows that share or lack an id: number them in the order of id, then text (rare, so the sort's shuffle is borne)
    named = d.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn("number", F.monotonically_increasing_id())
    named = store(named, "numbered")
    return named.select(F.col("number").alias("doc_id"), "text"), named.select("number", F.col("doc_id").alias("name")), buckets


def find(docs: DataFrame, spec: Spec, buckets: int, refine: Callable) -> DataFrame:
    """Blobs (kind "i": doc, start, end in symbols) of intervals in which every window of the spec is repeated."""
    spark = docs.sparkSession

    def gather(batches):
        held, n = [], 0

        def flush():
            doc, place, h, context = (np.concatenate(x) for x in zip(*held))
            # equal contexts within this task: settled here, so that one of them travels (of the smallest document each)
            own = W.mix(h * W.PLACE[3] + context)
            order = np.lexsort((doc, own))
            new = np.diff(own[order], prepend=~own[order][:1]) != 0
            number, lead = np.cumsum(new) - 1, np.flatnonzero(new)
            several = np.bincount(number)[number] > 1
            settled = doc[order] > doc[order][lead][number] if spec.earlier else several
            stay = settled if spec.earlier else several & ~new
            gone, left = order[settled], order[~stay]
            yield from _deal("i", np.mod(doc[gone], buckets).astype(np.int32), doc[gone], place[gone].astype(np.int32) - spec.reach, place[gone].astype(np.int32) + spec.gram + spec.reach)
            known = np.zeros(len(left), np.int8) if spec.earlier else several[~stay].astype(np.int8)
            again = np.lexsort((place[left], doc[left], _gram_bucket(h[left], buckets)))
            left, known = left[again], known[again]
            bucket, doc, place, h, context = _gram_bucket(h[left], buckets), doc[left], place[left], h[left], context[left]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
                yield _row(int(bucket[a]), "a", _steps(doc[a:b]), _steps(place[a:b].astype(np.int32)), _six(h[a:b]), _six(context[a:b]), known[a:b])

        for batch in slices(batches, "text", PART):
            v, first, _ = symbols(spec, *utf8(batch.column(1)))
            text, place, h, context = anchors(spec, v, first)
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((ids[text], place, h, context))
            n += len(text)
            if n >= GATHER:
                yield _batch(list(flush()))
                held, n = [], 0
        if n:
            yield _batch(list(flush()))

    def decide(key, rows):
        kinds = rows.column("kind").to_pylist()
        passed = rows.filter(pa.array([k == "i" for k in kinds])).select(_NAMES)
        parts = [(np.cumsum(np.frombuffer(r["a"], np.int64)), np.cumsum(np.frombuffer(r["b"], np.int32), dtype=np.int32), _eight(r["c"]), _eight(r["d"]), np.frombuffer(r["e"], np.int8)) for r in rows.filter(pa.array([k == "a" for k in kinds])).select(list("abcde")).to_pylist()]
        if not parts:
            return passed.cast(_ARROW)
        doc, place, h, context, known = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        s = h[order]
        twin = np.zeros(len(s), bool)
        twin[1:] = s[1:] == s[:-1]
        twin[:-1] |= s[1:] == s[:-1]
        some = order[twin]  # the rank of all others is unique: dropped
        order = some[np.lexsort((place[some], doc[some], context[some], h[some]))]
        doc, place, h, context, known = doc[order], place[order], h[order], context[order], known[order]
        if not len(doc):
            return passed.cast(_ARROW)
        new_gram = np.diff(h, prepend=~h[:1]) != 0
        new_class = new_gram | (np.diff(context, prepend=~context[:1]) != 0)
        number, gram = np.cumsum(new_class) - 1, np.cumsum(new_gram) - 1
        size, lead = np.bincount(number), np.flatnonzero(new_class)
        mixed = np.bincount(gram[lead])[gram] > 1  # the gram has several contexts
        copies = np.zeros(len(doc), bool)
        if spec.earlier:
            settled = doc > doc[lead][number]
            ask = new_class & mixed
            copies = ~settled & mixed & ~new_class  # same document, same context: what holds for the first holds for them
        else:
            settled = (size[number] > 1) | (known > 0)
            ask = mixed & (new_class | ~settled)  # of settled ones, one to compare with
            known = settled.astype(np.int8)
        out = list(_deal("i", np.mod(doc[settled], buckets).astype(np.int32), doc[settled], place[settled] - spec.reach, place[settled] + spec.gram + spec.reach))
        out += _deal("q", np.mod(doc[ask], buckets).astype(np.int32), doc[ask], place[ask], _six(h[ask]), known[ask], np.full(int(ask.sum()), key[0].as_py(), np.int32))
        out += _deal("m", np.mod(doc[copies], buckets).astype(np.int32), doc[copies], place[copies], place[lead][number][copies])
        return pa.concat_tables([_table(out), passed.cast(_ARROW)])

    def fetch(key, rows):
        kinds = rows.column("kind").to_pylist()
        asked = [r for r in rows.filter(pa.array([k == "q" for k in kinds])).select(list("abcde")).to_pylist()]
        if not asked:
            return _table([])
        doc, place, h, known, goes = (np.concatenate([np.frombuffer(r[c], t) if t else _eight(r[c]) for r in asked]) for c, t in zip("abcde", (np.int64, np.int32, None, np.int8, np.int32)))
        order = np.lexsort((place, doc))
        doc, place, h, known, goes = doc[order], place[order], h[order], known[order], goes[order]
        texts = rows.filter(pa.array([k == "t" for k in kinds])).combine_chunks()
        wanted = np.isin(texts.column("doc_id").to_numpy(), doc)
        texts = texts.filter(pa.array(wanted))
        out: dict[int, list] = {}
        for batch in slices(iter(texts.to_batches()), "text", PART):
            at, data = utf8(batch.column(batch.schema.get_field_index("text")))
            v, first, _ = symbols(spec, at, data)
            raw = data[at[0] : at[-1]] if spec.symbols == "bytes" else v
            for i, d in enumerate(batch.column(batch.schema.get_field_index("doc_id")).to_pylist()):
                for j in range(*np.searchsorted(doc, [d, d + 1]).tolist()):
                    p = first[i] + place[j]
                    a, b = max(first[i], p - spec.reach), min(first[i + 1], p + spec.gram + spec.reach)
                    out.setdefault(int(goes[j]), []).append((h[j], d, int(place[j]) - (p - a), b - a, known[j], p - a, raw[a:b]))
        return _table([_row(g, "c", _six(np.array([x[0] for x in xs], np.uint64)), *_pack(xs)) for g, xs in out.items()])

    def _pack(xs):
        doc, start, size, known, lead = (np.array([x[k] for x in xs], np.int64) for k in (1, 2, 3, 4, 5))
        return doc, np.stack([start, size, known, lead]).astype(np.int32), np.concatenate([x[6] for x in xs])

    def compare(key, rows):
        h, doc, meta, raw = [], [], [], []
        for r in rows.select(list("abcd")).to_pylist():
            h.append(_eight(r["a"]))
            doc.append(np.frombuffer(r["b"], np.int64))
            meta.append(np.frombuffer(r["c"], np.int32).reshape(4, -1))
            raw.append(np.frombuffer(r["d"], np.uint8 if spec.symbols == "bytes" else np.uint64))
        start, size, known, lead = np.concatenate(meta, 1).astype(np.int64)
        d, a, b = refine(spec, np.concatenate(h), np.concatenate(doc), start, size, known > 0, lead, np.concatenate(raw))
        return _table(list(_deal("i", np.mod(d, buckets).astype(np.int32), d, a.astype(np.int32), b.astype(np.int32))))

    texts = docs.select(F.pmod("doc_id", F.lit(buckets)).cast("int").alias("bucket"), F.lit("t").alias("kind"), "doc_id", "text", *(F.lit(None).cast("binary").alias(c) for c in "abcde"))
    dealt = docs.mapInArrow(tidied(gather), _BLOB)
    decided = store(dealt.groupBy("bucket").applyInArrow(decide, _BLOB), "decided")
    del dealt
    release(spark)
    asked = decided.filter("kind = 'q'")
    contexts = texts.unionByName(asked).groupBy("bucket").applyInArrow(fetch, _BLOB)
    refined = store(contexts.groupBy("bucket").applyInArrow(compare, _BLOB), "refined")
    del contexts
    release(spark)
    return texts.unionByName(decided.filter("kind in ('i', 'm')")).unionByName(refined)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def covered(spec: Spec, n: int, start: np.ndarray, end: np.ndarray, copies: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Which of n symbols are covered by repeated windows: those of the intervals, and around the anchors `copies` those that are
    repeated around their `leads`. What is cut at the text's ends still has to hold a window."""
    if n < spec.window:
        return np.zeros(n, bool)
    first, last = np.maximum(start, 0), np.minimum(end, n) - spec.window
    ok = last >= first
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, first[ok], 1)
    np.add.at(edge, last[ok] + 1, -1)
    windows = np.cumsum(edge[: n - spec.window + 1]) > 0
    around = np.arange(-spec.reach, 1)
    for k in range(0, len(copies), 1 << 16):
        to, source = (x[k : k + (1 << 16), None] + around for x in (copies, leads))
        inside = (to >= 0) & (to < len(windows)) & (source >= 0) & (source < len(windows))
        windows[to[inside][windows[source[inside]]]] = True
    at = np.flatnonzero(windows)
    edge[:] = 0
    edge[at] += 1
    edge[at + spec.window] -= 1
    return np.cumsum(edge[:n]) > 0


def finish(found: DataFrame, spec: Spec, result: Callable, schema: str) -> DataFrame:
    """Rows of the schema, whose columns `result` gives for each batch: (ids, text column, list of coverage masks)."""

    def work(key, rows):
        kinds = rows.column("kind").to_pylist()

        def blobs(kind):
            found = rows.filter(pa.array([k == kind for k in kinds])).select(list("abc")).to_pylist()
            x, y, z = (np.concatenate([np.frombuffer(r[c], t) for r in found] or [np.zeros(0, t)]) for c, t in zip("abc", (np.int64, np.int32, np.int32)))
            order = np.argsort(x, kind="stable")
            return x[order], y[order].astype(np.int64), z[order].astype(np.int64)

        (doc, start, end), (of, copies, leads) = blobs("i"), blobs("m")
        texts = rows.filter(pa.array([k == "t" for k in kinds])).combine_chunks()
        out = []
        for batch in slices(iter(texts.to_batches()), "text", PART):
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            at, data = utf8(batch.column(batch.schema.get_field_index("text")))
            _, first, spans = symbols(spec, at, data)
            for i, d in enumerate(ids.to_pylist()):
                a, b = np.searchsorted(doc, [d, d + 1])
                p, q = np.searchsorted(of, [d, d + 1])
                gone = covered(spec, int(first[i + 1] - first[i]), start[a:b], end[a:b], copies[p:q], leads[p:q])
                if spans is None:
                    out.append(result(d, data[at[i] : at[i + 1]], gone, None))
                else:
                    base = at[i] - at[0]
                    out.append(result(d, data[at[i] : at[i + 1]], gone, (spans[0][first[i] : first[i + 1]] - base, spans[1][first[i] : first[i + 1]] - base)))
        kinds_of = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        columns = [x.split() for x in schema.split(", ")]
        return pa.table({n: pa.array([r[k] for r in out], kinds_of[t]) for k, (n, t) in enumerate(columns)})

    return found.groupBy("bucket").applyInArrow(work, schema)


def named(result: DataFrame, names: DataFrame | None) -> DataFrame:
    """The result with the given ids in place of the numbers of `keyed`."""
    if names is None:
        return result
    return result.join(names, F.col("doc_id") == F.col("number")).withColumn("doc_id", F.col("name")).drop("number", "name")
