"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

The product of the sparse document x shingle matrix with its transpose holds the overlap of every two documents. It is
worked out in blocks, each behind a bound that follows from sizes alone; what a block proves is contracted before the next:

1. Copies (equal sets) are one row of the matrix, known by a 64-bit hash of the set.
2. A pair above the threshold t shares one of the first n - ceil(t n) + 1 shingles of either set in any common order,
   so only these columns are multiplied. The order is by counts of all data (per hash bucket; as many buckets as the corpus
   asks for, within bounds), rare first, so that passages many documents share don't make candidates.
3. First block: within a column, rows are sorted by size and each is paired with the column's first and its previous row
   (two entries a row, however many rows share the shingle). Their common columns are counted; each row keeps the TRIES
   partners with which it has most; their overlaps are accumulated on the whole sets, and links are joined into components.
4. Next blocks, as long as they find much: in the columns that still hold several components, rows are paired as before but
   in another order and with rows of other components only; each row keeps the TRIES partners whose sketches are nearest.
   A sketch has the parity of the set's count in each of 512 hash blocks; two sets differ in as many shingles as parities
   at least, and pairs that can't reach the threshold by that bound are discarded.
5. Last block: the columns that still hold several components are multiplied in full, but for the pairs within one, which
   can't change it. An entry is made only if the sizes, the places in the order and the sketches leave room for the
   threshold. A pair that also meets in the one or two open columns before is left to those, so that near copies make
   a few entries a pair, not one a column. Overlaps are accumulated as before, and the links joined.

So no link between different components is lost, and a group of n near copies costs n entries a column rather than n
squared. Overlaps are accumulated over hash blocks of the sets, so that the set of a very long document needn't fit in a row.

Null texts and texts without words have an empty set and stand alone; fewer words than `size` make one shingle; copies
of a text, and repeated rows, share a component; rows without a doc_id take part, and a component's id is its smallest
given doc_id (null if none has one). A very long text's shingles are hashed in one task, which needs some 50 bytes a word.
An empty table gives an empty table; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import discard, release, slices, store, tidied, utf8
from quarry.llm.components import components
from quarry.llm.words import mix, shingle_sets

SIZE, PERCENT = 5, 80
#: Text bytes a bucket of the counts, least and most buckets (as powers of two), and rows in which tasks hand in their counts.
BUCKET_BYTES, LEAST_BITS, MOST_BITS, SEGMENTS = 256, 18, 24, 64
#: 64-bit words of a row's sketch.
WORDS = 8
#: Partners that a row keeps in each block but the last, and blocks between the first and the last, at most.
TRIES, TURNS = 2, 6
#: Shingles of a set that one row holds, about.
SET_ROW = 1 << 16
#: Bytes of text that a kernel works on at once.
PART = 1 << 20
#: Ids of sets that a task remembers, so as not to send copies it has just sent.
SEEN = 1 << 18
_WORDS = [f"w{k}" for k in range(WORDS)]


def set_id(s: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingle hashes."""
    if not len(s):
        return 0
    h = mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))
    return int(h.astype(np.int64)[0]) or 1


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WORDS signed numbers a set: the parity of its count in each of 64 x WORDS hash blocks."""
    wide = 64 * WORDS
    block = np.concatenate([s & np.uint64(wide - 1) for s in sets] or [np.zeros(0, np.uint64)]).astype(np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    counts = np.bincount(row * wide + block, minlength=len(sets) * wide).reshape(-1, wide)
    return np.packbits((counts & 1).astype(np.uint8), axis=1).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "text", PART):
        yield batch, shingle_sets(*utf8(batch.column(batch.schema.get_field_index("text"))), size)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, id, n, sketch) of every row, and the order: a level by hash bucket that grows with its count over all documents."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (total // BUCKET_BYTES).bit_length()))
    width = (1 << bits) // SEGMENTS
    names = ["segment", "counts", "doc_id", "id", "n", *_WORDS]
    own = (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * WORDS)

    def work(batches):
        counts = np.zeros(1 << bits, np.int32)
        for batch, sets in _sets(batches, size):
            if sets:
                at, times = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
                counts[at.astype(np.int64)] += times.astype(np.int32)
            k = len(sets)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), batch.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(w) for w in parities(sets).T)], names=names)
        blobs = [zlib.compress(counts[i * width : (i + 1) * width].tobytes(), 1) for i in range(SEGMENTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array(blobs, pa.binary()), *(pa.nulls(SEGMENTS, t) for t in own)], names=names)

    schema = "segment int, counts binary, doc_id long, id long, n int, " + ", ".join(f"{w} long" for w in _WORDS)
    both = store(docs.select("doc_id", "text").mapInArrow(tidied(work), schema), "signatures")

    def add(key, rows):
        counts = np.zeros(width, np.int64)
        for blob in rows.column("counts"):
            counts += np.frombuffer(zlib.decompress(blob.as_py()), np.int32)
        # the logarithm's sixths are order enough, and fit a byte each
        level = np.minimum(255, np.log2(counts + 1) * 6).astype(np.uint8)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})

    parts = both.filter("segment is not null").select("segment", "counts").groupBy("segment").applyInArrow(add, "segment int, levels binary").collect()
    level = np.zeros(1 << bits, np.uint8)
    for r in parts:  # SEGMENTS rows of fixed size, 16 MB in all at most
        level[r[0] * width : (r[0] + 1) * width] = np.frombuffer(bytes(r[1]), np.uint8)
    return both.filter("segment is null").drop("segment", "counts"), level


def incidence(docs: DataFrame, level: np.ndarray, size: int, percent: int) -> DataFrame:
    """The matrix's columns that can hold a link: (shingle, id, n, place), rare shingles first."""
    sent = docs.sparkSession.sparkContext.broadcast(level)
    bits = len(level).bit_length() - 1

    def work(batches):
        level, seen = sent.value, set()
        for _, sets in _sets(batches, size):
            shingle, ids, ns, places = [], [], [], []
            for s in sets:
                if not (n := len(s)) or (own := set_id(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(own)
                k = prefix_length(n, percent)
                # by level, then by hash (s is sorted)
                first = s[np.argsort(level[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")[:k]]
                shingle.append(first)
                ids.append(np.full(k, own, np.int64))
                ns.append(np.full(k, n, np.int32))
                places.append(np.arange(k, dtype=np.int32))
            if shingle:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([x.astype(np.int64) for x in shingle], ids, ns, places)], names=["shingle", "id", "n", "place"])

    return docs.select("text").mapInArrow(tidied(work), "shingle long, id long, n int, place int")


def sets_of(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """(id, block, shingles): each set by its shingles' first `bits` bits."""

    def work(batches):
        for _, sets in _sets(batches, size):
            ids, blocks, parts = [], [], []
            for s in sets:
                cut = np.searchsorted(s, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                for k, part in enumerate(np.split(s, cut)):
                    if len(part):
                        ids.append(set_id(s))
                        blocks.append(k)
                        parts.append(part.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blocks, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["id", "block", "shingles"])

    return docs.select("text").mapInArrow(tidied(work), "id long, block int, shingles array<long>")


def _possible(n, place, m, other, percent: int):
    """Whether sizes n and m, and the places of a first common shingle, leave room for the threshold."""
    least = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - F.lit(1e-9))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - place, m - other) >= least)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose sets reach the threshold: overlaps accumulated over the blocks of the full sets."""
    a, b = (sets.select(F.col("id").alias(c), "block", F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, ["b", "block"]).select("a", "b", "n_a", "n_b", "block", F.size(F.array_intersect("sa", "sb")).alias("part"))
    # a set may have been made from several rows (of one doc_id, or of none): the same part then
    found = both.distinct().groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    return found.filter(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, n_a, n_b) with a < b, from (id, n, other, m)."""
    swap = F.col("id") > F.col("other")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), either("n", "m").alias("n_a"), either("m", "n").alias("n_b")).distinct()


def _first_block(table: DataFrame, percent: int) -> DataFrame:
    """Pairs of each row with its best partners among its columns' first and previous rows."""
    tries = [table.filter(_possible(F.col("n"), F.col("place"), F.col(f"{x}_n"), F.col(f"{x}_place"), percent)).select("id", "n", F.col(f"{x}_id").alias("other"), F.col(f"{x}_n").alias("m")) for x in ("last", "first")]
    counted = tries[0].union(tries[1]).filter("id <> other").groupBy("id", "n", "other", "m").agg(F.count("*").alias("common"))
    best = counted.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy(F.col("common").desc(), "other")))
    return _ordered(best.filter(F.col("nth") <= TRIES))


def _open(table: DataFrame, inside: DataFrame) -> DataFrame:
    """The table's rows with their components, in the columns that hold several."""
    marked = table.join(inside.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = marked.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("shingle")
    return marked.join(several, "shingle", "left_semi")


def _differ(x, y):
    """Number of hash blocks of which one row's count is even and the other's odd."""
    return sum(F.bit_count(x(w).bitwiseXOR(y(w))) for w in _WORDS)


def _room(x, y, percent: int):
    return (100 + percent) * _differ(x, y) <= (100 - percent) * (x("n") + y("n"))


def _next_block(marked: DataFrame, tried: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each row with its likeliest partners among the first and the previous row of its columns, in an order of the
    turn's own, of other components."""
    mine = F.struct("id", "n", "place", "component", *_WORDS)
    column = W.partitionBy("shingle").orderBy(F.xxhash64("id", F.lit(turn)), "id")
    both = marked.select("id", "n", "place", "component", *_WORDS, F.lag(mine).over(column).alias("last"), F.first(mine).over(column).alias("first"))
    tries = []
    for other in [lambda c, side=side: F.col(side).getField(c) for side in ("last", "first")]:
        possible = (other("component") != F.col("component")) & _possible(F.col("n"), F.col("place"), other("n"), other("place"), percent) & _room(F.col, other, percent)
        tries.append(F.when(possible, F.struct(other("id").alias("other"), other("n").alias("m"), _differ(F.col, other).alias("differ"))))
    pairs = both.select("id", "n", F.explode(F.array(*tries)).alias("pair")).filter("pair is not null").select("id", "n", "pair.*").distinct()
    best = pairs.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("differ", "other")))
    return _ordered(best.filter(F.col("nth") <= TRIES)).join(tried.select("a", "b"), ["a", "b"], "left_anti")


def _last_block(marked: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in the columns, behind all bounds, besides those tried."""
    before = W.partitionBy("id").orderBy("place")
    open_ = store(marked.withColumns({f"p{k}": F.lag("shingle", k).over(before) for k in (1, 2)}), "open")
    x, y = (open_.select(*(F.col(c).alias(f"{c}_{side}") for c in open_.columns)) for side in "xy")
    met = F.coalesce((F.col("p1_x") == F.col("p1_y")) | (F.col("p1_x") == F.col("p2_y")) | (F.col("p2_x") == F.col("p1_y")) | (F.col("p2_x") == F.col("p2_y")), F.lit(False))
    of = [lambda c, side=side: F.col(f"{c}_{side}") for side in "xy"]
    possible = _possible(F.col("n_x"), F.col("place_x"), F.col("n_y"), F.col("place_y"), percent)
    rest = x.join(y, F.col("shingle_x") == F.col("shingle_y")).filter((F.col("component_x") < F.col("component_y")) & possible & _room(*of, percent) & ~met)
    rest = rest.select(F.col("id_x").alias("id"), F.col("n_x").alias("n"), F.col("id_y").alias("other"), F.col("n_y").alias("m"))
    rest = store(_ordered(rest).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    discard(open_)
    return rest


def links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id, n) of every document, and components (node, component) of the linked ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    rows, level = signatures(docs, size)
    bits = max(0, (rows.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] // SET_ROW).bit_length())
    column = W.partitionBy("shingle").orderBy("n", "id")
    table = incidence(docs, level, size, percent)
    # copies of a set are equal rows next to one another; running frames only, so that a column of any length streams
    table = table.withColumn("last", F.lag("id").over(column)).filter("last is null or last <> id")
    table = table.select("shingle", "id", "n", "place", *(F.lag(c).over(column).alias(f"last_{c}") for c in ("id", "n", "place")), *(F.first(c).over(column).alias(f"first_{c}") for c in ("id", "n", "place")), F.lead("id").over(column).alias("following"))
    table = store(table.filter("last_id is not null or following is not null").drop("following"), "incidence")
    release(spark)
    tried = store(_first_block(table, percent), "pairs")
    found = _verified(tried, docs, rows, size, percent, bits)
    inside, known = components(found), found.count()
    marked = _open(table.select("shingle", "id", "n", "place"), inside)
    sketches = rows.join(marked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(*(F.any_value(w).alias(w) for w in _WORDS))
    sketched = store(marked.drop("component").join(sketches, "id"), "columns")
    release(spark)
    discard(table)
    for turn in range(1, TURNS + 1):
        pairs = store(_next_block(_open(sketched, inside), tried, turn, percent), "pairs")
        release(spark)
        if pairs.isEmpty():
            break
        tried, new = tried.union(pairs), _verified(pairs, docs, rows, size, percent, bits)
        linked = new.count()
        known += linked
        if linked:
            inside = components(_joined(inside, new))
        if 50 * linked < known:  # what links remain are too few to be met this way
            break
    rest = _last_block(_open(sketched, inside), tried, percent)
    discard(sketched)
    release(spark)
    if not rest.isEmpty():
        inside = components(_joined(inside, _verified(rest, docs, rows, size, percent, bits)))
    return rows.select("doc_id", "id", "n"), inside


def _joined(inside: DataFrame, new: DataFrame) -> DataFrame:
    """The edges of components and new links: each node's to its component's smallest stands for all links before."""
    return inside.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new.select("a", "b"))


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    sets = _sets_for(pairs, docs, rows, size, bits)
    found = store(_linked(pairs, sets, percent), "links")
    release(docs.sparkSession)
    discard(sets)
    return found


def _sets_for(pairs: DataFrame, docs: DataFrame, rows: DataFrame, size: int, bits: int) -> DataFrame:
    """Full sets of the pairs' ids, each made from one document (from any that lack a doc_id, besides)."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    chosen = rows.select("doc_id", "id").join(used, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    known = docs.join(chosen, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    made = store(sets_of(known, size, bits), "sets")
    release(docs.sparkSession)
    return made


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    rows, joined = links(docs, size, percent)
    rows = rows.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    full = rows.filter("n > 0")
    least = store(full.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    full = full.join(least, "component").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(alone)


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each component: that with the smallest doc_id (a null only if there is no other, ties by the
    text's hash); rows with an empty set all stay."""
    total, given = docs.agg(F.count("*"), F.count("doc_id")).first()
    if given == total and docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = classes(docs, size, percent).filter("doc_id = component_id").select("doc_id")
        return docs.join(kept.withColumnRenamed("doc_id", "_kept"), F.col("doc_id") == F.col("_kept"), "left_semi")
    # rows that share or lack an id are told apart by a number (rare, so the copy is borne)
    numbered = store(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    rows, joined = links(numbered.select(F.col("_row").alias("doc_id"), "text"), size, percent)
    rows = rows.withColumnRenamed("doc_id", "_row")
    full = rows.filter("n > 0").join(joined.withColumnRenamed("node", "id"), "id", "left").select("_row", F.coalesce("component", "id").alias("component"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long"), F.xxhash64("text"), "_row")
    kept = full.join(numbered.select("_row", order.alias("order")), "_row").groupBy("component").agg(F.min("order").getField("_row").alias("_row"))
    return numbered.join(kept.select("_row").union(rows.filter("n = 0").select("_row")), "_row", "left_semi").select(*docs.columns)
