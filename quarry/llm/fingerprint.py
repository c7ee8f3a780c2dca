"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every byte, taken with two later ones at several distances, makes triplets; each is hashed to one of BUCKETS counters.
The digest holds two bits a counter (below which quartile of the counters it lies) and the logarithm of the length.
The difference of two digests is the sum of the counters' quartile steps (two apart or more count extra) and of the
length's, bounded; likeness is 1 minus the difference over its bound.

Null text is empty; an empty text has all counters equal and length code 0; equal texts have equal fingerprints.
`neighbours` pairs each row with the next in ascending doc_id (null first, those by a hash of the text; ties by text; after the
last, the first) without a global window: rows go to range buckets at approximate quantiles of doc_id or ranges of the hash, and the first row of each bucket
is sent to the bucket before it as well. A table of one row is its own next. Very long texts are hashed in parts of PART bytes;
repeated rows and ids stand beside one another in the order of their texts; other columns aren't read, whatever their names.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
#: Distances of the second and third byte of a triplet from its first.
REACH = ((1, 2), (2, 5), (3, 7))
#: Bytes of a text that are worked on at once.
PART = 1 << 20
#: Range buckets of `neighbours`, at most.
MAX_CUTS = 20_000
#: Most that the two length codes may add to a difference.
LENGTH_MOST = 24


def counters(data: bytes) -> np.ndarray:
    """Hashed triplets by bucket."""
    out = np.zeros(BUCKETS, np.int64)
    reach = max(b for _, b in REACH)
    for first in range(0, len(data), PART):
        a = np.frombuffer(data, np.uint8, min(len(data) - first, PART + reach), first).astype(np.uint32)
        for k, (i, j) in enumerate(REACH):
            n = min(PART, len(a) - j)  # triplets that begin in this part and end in the text
            if n <= 0:
                continue
            h = (a[:n] | a[i : i + n] << 8 | a[j : j + n] << 16) + np.uint32(k << 24)
            h = (h ^ h >> 15) * np.uint32(0x2C1B3C6D)
            h = (h ^ h >> 12) * np.uint32(0x297A2D39)
            out += np.bincount(h >> 24, minlength=BUCKETS)
    return out


def fingerprint(data: bytes) -> str:
    """Hex digits: 2 for the length code, then 2 bits a counter."""
    c = counters(data)
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    levels = (c[:, None] > q[None, :]).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = levels[:, 0] << 6 | levels[:, 1] << 4 | levels[:, 2] << 2 | levels[:, 3]
    code = min(255, round(8 * np.log2(len(data) + 1)))
    return f"{code:02x}" + packed.astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for the largest difference that the score can be."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    steps = np.zeros(BUCKETS, np.int64)
    for k in range(4):
        steps[k::4] = np.abs((x[1:] >> 2 * k & 3).astype(np.int64) - (y[1:] >> 2 * k & 3))
    cost = int(np.where(steps == 3, 6, steps).sum()) + min(LENGTH_MOST, abs(int(x[0]) - int(y[0])))
    return 1 - cost / (6 * BUCKETS + LENGTH_MOST)


def edited(text: str, following: str) -> str:
    """`text` with its last quarter replaced by the first as many code points of `following`."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def neighbours(docs: DataFrame, per_bucket: int = 1000) -> DataFrame:
    """(bucket, copy, none, key, text), dealt so that a bucket's rows, sorted, end with a copy of the next bucket's first row.

    key is the doc_id or, where it is null (`none`), a hash of the text, by whose ranges such rows go to buckets below 0. The
    driver gets at most MAX_CUTS quantiles of doc_id and the first key of each bucket, never texts.
    """
    text, id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    d = docs.select(id.isNull().alias("none"), F.coalesce(id, F.xxhash64(text)).alias("key"), text.alias("text"))
    ids = d.select("none", "key")
    rows, given = ids.agg(F.count("*"), F.count_if(~F.col("none"))).first()
    parts, spread = (max(1, min(MAX_CUTS, n // per_bucket)) for n in (given, rows - given))
    marks = F.percentile_approx("key", [i / parts for i in range(1, parts)], 10 * parts) if parts > 1 else F.lit(None)
    cuts = np.unique(np.asarray(ids.filter("not none").agg(marks.alias("cuts")).first()["cuts"] or [], np.int64))
    edges = np.asarray([(k << 64) // spread - (1 << 63) for k in range(1, spread)], np.int64)

    def bucket_of(none: pa.Array, key: pa.Array) -> np.ndarray:
        k = key.to_numpy()
        return np.where(none.to_numpy(zero_copy_only=False), np.searchsorted(edges, k, "right") - spread, np.searchsorted(cuts, k, "right")).astype(np.int32)

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(*batch.columns)), *batch.columns], names=["bucket", "none", "key"])

    placed = ids.mapInArrow(place, "bucket int, none boolean, key long").groupBy("bucket", "none")
    firsts = sorted(placed.agg(F.min("key").alias("key")).collect())  # one row a bucket
    before = [{k: firsts[i - 1][0] for i, (_, none, k) in enumerate(firsts) if none == kind} for kind in (False, True)]
    keys = [np.asarray(sorted(x), np.int64) for x in before]
    to = [np.asarray([x[k] for k in sorted(x)], np.int32) for x in before]

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            none, key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            goes, twice = np.zeros(len(key), np.int32), np.zeros(len(key), bool)
            for kind in (0, 1):
                if len(keys[kind]):
                    at = np.minimum(np.searchsorted(keys[kind], key), len(keys[kind]) - 1)
                    hit = (none == bool(kind)) & (keys[kind][at] == key)
                    goes[hit], twice = to[kind][at[hit]], twice | hit
            copies = batch.take(pa.array(np.flatnonzero(twice)))
            for some, bucket, copy in ((batch, bucket_of(*batch.columns[:2]), False), (copies, goes[twice], True)):
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(some.num_rows, copy)), *some.columns], names=["bucket", "copy", "none", "key", "text"])

    return d.mapInArrow(deal, "bucket int, copy boolean, none boolean, key long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and how like they and the next one's are."""
    dealt = neighbours(docs)
    dealt = dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket", "copy", "key", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]):
        held = None  # bucket, doc_id, text, fingerprint of the row whose next one isn't known yet
        for batch in batches:
            rows = []
            for bucket, copy, none, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                doc_id = None if none else key
                if held is None and copy or held is not None and copy and held[0] != bucket:
                    continue
                own = fingerprint(text.encode())
                if held is not None and held[0] == bucket:
                    _, last_id, last, print_ = held
                    changed = edited(last, text).encode("utf-8", "surrogatepass")
                    other = fingerprint(changed)
                    rows.append((last_id, len(last), hashlib.sha256(changed).hexdigest(), print_, other, likeness(print_, other), likeness(print_, own)))
                held = None if copy else (bucket, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    return dealt.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
