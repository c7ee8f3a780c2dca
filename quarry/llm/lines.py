"""Line dedup: fuzzy lines by MinHash over character shingles (DataFrame functions only).

A text's lines are what stands between line feeds. Copies of a line are one line, known by a 64-bit hash. Each distinct
line's shingles (SHINGLE consecutive UTF-16 units; a shorter line is one shingle) are hashed; the two top bits of a hash
choose one of four parts, and each part keeps the minimum of its hashes under MINIMA exclusive-or masks. ROWS minima
make a band. Lines that share a band (4 parts x 2 bands) are candidates. A pair is linked if the exact Jaccard similarity
of its shingle sets is at least PERCENT / 100; linked lines are joined by distributed union-find; and of all occurrences
of a component's lines the first (by doc_id, then place) stays.

A line's signature is one byte of each of its 24 minima. Most lines that share a band do so by chance and share no further
minima, so a pair of which more than UNLIKE minima differ isn't tested, and a line without any partner in its bands is left
out early. At the threshold a minimum differs with probability 0.2; that more than 16 of 24 do has probability 2e-8, far
below the chance of sharing no band.

Bands are worked on in turns. In each, lines are put in an order of the turn's own; a line is paired with its bands' first and
previous lines of other components, a component keeps the TRIES pairs whose signatures are nearest, and these are verified and
joined, so a band of n lines costs n entries a turn. Bands of up to SMALL lines take no further turn once the pairs left that
their signatures allow number no more than FEW for each line and band, the larger once all their pairs left do, or once a turn
finds little.

Lines of the pairs left, if these number more than TESTS a line, and of larger bands with many, get a sketch: the parity of the
number of their different shingles in each of 2048 hash blocks. Two sets differ in as many shingles as parities at least, so
the sketches bound the similarity from above. Pairs are tested behind that bound, which never drops a linked pair: no pair
that shares a band goes untested unless it lies within a component, can't reach the threshold or has too different signatures.

At the threshold a pair shares a band with probability 1 - (1 - 0.8 ^ 3) ^ 8 = 0.997 (a little less for lines so short
that a part is empty); a pair is also found through other members of its component.

Blank lines stay and take no part. Null texts have no lines and stay null; a document whose lines all go keeps its row,
with an empty text. Very long texts are split like others; a very long line costs time in proportion to its length, and
its shingle set has to fit in a task. Rows that repeat both doc_id and text are one document and get the same result; null
doc_ids come first. Columns other than doc_id and text pass through, whatever their names; columns named n_lines or
n_removed are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import discard, release, spent, store
from quarry.llm.components import components

SHINGLE, PERCENT = 7, 80
ROWS, BANDS, PARTS = 3, 2, 4
#: 64-bit words of a sketch; partners that a line keeps in a turn, and turns at most.
WORDS, TRIES, TURNS = 32, 1, 8
#: Pairs a row of the open bands that cost no more than a turn.
FEW = 1
#: Pairs a line whose tests cost no more than the lines' sketches.
TESTS = 2
#: Of a pair's 24 minima, as many as may differ: for a turn, and for any test. At the threshold some 5 differ.
LIKELY, UNLIKE = 8, 16
#: Rows of a band that are compared each with each by their signatures.
SMALL = 64
_SIGNATURE = [f"s{k}" for k in range(PARTS)]
_SKETCH = [f"w{k}" for k in range(WORDS)]
_random = random.Random(7)
#: One mask a minimum; the top bits stay as they are, for they choose the part.
MASKS = [_random.getrandbits(62) for _ in range(ROWS * BANDS)]


def _units(line: Column) -> Column:
    """The line's UTF-16 units as bytes, so that cutting costs the same anywhere. Select it before it is cut: an
    expression within a lambda or beside an explode would be worked out again for each shingle."""
    return F.encode(line, "UTF-16BE")


def _places(units: Column) -> Column:
    """Bytes at which the shingles begin."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(units) - (2 * SHINGLE - 1)), F.lit(2))


def _shingle(units: Column, place: Column) -> Column:
    return F.substring(units, place, F.lit(2 * SHINGLE))


def _dealt(lines: DataFrame) -> DataFrame:
    """Lines by lid, once, as text. A line's shingles are some 30 times its bytes, so the parts are smaller than other shuffles'."""
    return lines.repartition(2 * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lid")


def _once(value: Column, work: Callable[[Column], Column]) -> Column:
    """`work` on the value as a lambda's variable. A lambda within it then refers to the value; a row's binary column would be
    copied whole for each shingle, at a cost of the square of the line's length."""
    return F.element_at(F.transform(F.array(value), work), 1)


def _shingles(units: Column, hash: Callable[[Column], Column]) -> Column:
    """The hashes of the units' shingles, within the row."""
    return _once(units, lambda u: F.transform(_places(u), lambda place: hash(_shingle(u, place))))


def _hashes(lines: DataFrame) -> DataFrame:
    """(lid, h) of every shingle of (lid, line)."""
    d = lines.select("lid", _units(F.col("line")).alias("units"))
    d = d.select("lid", "units", F.explode(_places(F.col("units"))).alias("place"))
    return d.select("lid", F.xxhash64(_shingle(F.col("units"), F.col("place"))).alias("h"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, th, no, lid, line) of every line that isn't blank; id and th know the document, lid the line."""
    d = docs.select(_id().alias("id"), F.xxhash64("text").alias("th"), "text")  # beside posexplode it would be hashed once a line
    d = d.select("id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return d.filter(F.btrim("line", F.lit(" \t\r\f\x0b")) != "").withColumn("lid", F.xxhash64("line"))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def distinct_lines(places: DataFrame) -> DataFrame:
    return places.groupBy("lid").agg(F.any_value("line").alias("line"))


def signatures(lines: DataFrame) -> DataFrame:
    """(lid, bands, s0, ...) of each line: its bands, and of each part the low bytes of its minima (-1: an empty part).
    `lines` is dealt by lid, so the minima need no further shuffle."""
    d = _hashes(lines).withColumn("part", F.shiftrightunsigned("h", 62).cast("int"))
    minima = d.groupBy("lid", "part").agg(*(F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(MASKS)))
    low = [F.shiftleft(F.col(f"m{i}").bitwiseAND(F.lit(255)), 8 * i) for i in range(len(MASKS))]
    bands = [F.xxhash64("part", F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))).alias(f"b{b}") for b in range(BANDS)]
    parts = minima.select("lid", "part", *bands, reduce(Column.bitwiseOR, low).alias("s"))
    of = lambda c, p: F.max(F.when(F.col("part") == p, F.col(c)))
    spread = [of(f"b{b}", p).alias(f"b{b}_{p}") for b in range(BANDS) for p in range(PARTS)]
    every = parts.groupBy("lid").agg(*spread, *(F.coalesce(of("s", p), F.lit(-1)).alias(s) for p, s in enumerate(_SIGNATURE)))
    return every.select("lid", F.array(*(f"b{b}_{p}" for b in range(BANDS) for p in range(PARTS))).alias("bands"), *_SIGNATURE)


def sketches(lines: DataFrame) -> DataFrame:
    """(lid, n, words) of each line: the number of its different shingles, and their parities by hash block."""
    d = _dealt(lines).select("lid", F.explode(F.array_distinct(_shingles(_units(F.col("line")), F.xxhash64))).alias("h"))
    # bits from the top: five for the word, six for its bit
    d = d.select("lid", F.shiftrightunsigned("h", 59).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 53).cast("int")).alias("bit"))
    words = [F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(_SKETCH)]
    return d.groupBy("lid").agg(F.count("*").cast("int").alias("n"), *words).select("lid", "n", F.array(*_SKETCH).alias("words"))


def banded(signed: DataFrame) -> DataFrame:
    """(lid, band) of lines that share a band with another."""
    rows = signed.select("lid", F.explode("bands").alias("band")).filter("band is not null").repartition("band")
    # nearly all bands have one line, and a window for each would cost more than the hashes do
    several = rows.groupBy("band").agg(F.min("lid").alias("low"), F.max("lid").alias("high")).filter("low <> high").select("band")
    return rows.join(several.hint("shuffle_hash"), "band", "left_semi").select("lid", "band")


def promising(marked: DataFrame) -> DataFrame:
    """The rows without those whose signatures are too different from all of other components in the band, with the band's size
    before. Rows of bands of more than SMALL stay, so that the cost is linear."""
    rows = store(marked.withColumn("size", F.count("*").over(W.partitionBy("band"))), "line-open")
    small = rows.filter(F.col("size") <= SMALL)
    other = small.select("band", *(F.col(c).alias(f"{c}_y") for c in ("component", *_SIGNATURE)))
    near = (F.col("component") != F.col("component_y")) & (_unlike(F.col, lambda s: F.col(f"{s}_y")) <= UNLIKE)
    kept = small.join(other.withColumnRenamed("band", "band_y"), (F.col("band") == F.col("band_y")) & near, "left_semi")
    found = store(kept.union(rows.filter(F.col("size") > SMALL)), "line-open")
    discard(rows)
    release(marked.sparkSession)
    return found


def _several(bands: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The rows with their components, in the bands that hold several."""
    if groups is None:
        return bands.withColumn("component", F.col("lid"))
    marked = bands.drop("component").join(groups, "lid", "left").withColumn("component", F.coalesce("component", "lid"))
    several = marked.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band")
    return marked.join(several, "band", "left_semi")


def _few(several: DataFrame) -> bool:
    """Whether the open bands hold at most FEW pairs of different components a row."""
    own = several.groupBy("band", "component").agg(F.count("*").cast("double").alias("k"))
    own = own.groupBy("band").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("inside"))
    with spent(several.sparkSession):
        rows, pairs = own.agg(F.sum("n"), F.sum(F.col("n") * F.col("n") - F.col("inside")) / 2).first()
    return (pairs or 0) <= FEW * (rows or 0)


def _unlike(x, y) -> Column:
    """Number of minima in which two signatures differ."""

    def of(s: str) -> Column:
        bits = x(s).bitwiseXOR(y(s))
        for k in (4, 2, 1):  # the lowest bit of each byte becomes whether any is set
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, k))
        return F.bit_count(bits.bitwiseAND(F.lit(sum(1 << 8 * i for i in range(len(MASKS))))))

    return reduce(Column.__add__, map(of, _SIGNATURE))


def _differ(x, y) -> Column:
    """Number of hash blocks of which one line's count is even and the other's odd."""
    # in arrays: as 32 columns, the code of a row was too long for the JVM to compile
    return F.aggregate(F.zip_with(x("words"), y("words"), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda n, k: n + k)


def _possible(x, y) -> Column:
    """Whether sketches and counts leave room for the threshold.

    Sets of sizes s and t that reach it differ in (100 - PERCENT) (s + t) / (100 + PERCENT) shingles at most.
    """
    return (100 + PERCENT) * _differ(x, y) <= (100 - PERCENT) * (x("n") + y("n"))


def _pairs(id: Column, other: Column) -> list[Column]:
    return [F.greatest(id, other).alias("a"), F.least(id, other).alias("b")]


def candidates(marked: DataFrame, tried: DataFrame | None, turn: int) -> DataFrame:
    """Distinct pairs (a, b) of each component's lines with their likeliest partners among their bands' first and previous lines."""
    mine = F.struct("lid", "component", *_SIGNATURE)
    w = W.partitionBy("band").orderBy(F.xxhash64("lid", F.lit(turn)), "lid")
    both = marked.select("lid", "component", *_SIGNATURE, F.lag(mine).over(w).alias("last"), F.first(mine).over(w).alias("first"))
    both = both.select("lid", "component", *_SIGNATURE, F.explode(F.array("last", "first")).alias("other"))
    of = lambda c: F.col("other").getField(c)
    apart = both.filter(of("component") != F.col("component")).select("component", "lid", of("lid").alias("other"), _unlike(F.col, of).alias("differ"))
    best = apart.filter(F.col("differ") <= LIKELY).withColumn("nth", F.dense_rank().over(W.partitionBy("component").orderBy("differ", "lid", "other")))
    pairs = best.filter(F.col("nth") <= TRIES).select(*_pairs(F.col("lid"), F.col("other"))).distinct()
    return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[Callable[[str], Column]]]:
    """The rows twice, with their columns named for the side, and for each side what gives a column of it."""
    x, y = (rows.select(*(F.col(c).alias(f"{c}_{side}") for c in rows.columns)) for side in "xy")
    return x, y, [lambda c, side=side: F.col(f"{c}_{side}") for side in "xy"]


def near(marked: DataFrame, tried: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different components in a band besides those tried, as far as their signatures allow."""
    x, y, of = _sides(marked.select("lid", "band", "component", *_SIGNATURE))
    both = x.join(y, F.col("band_x") == F.col("band_y")).filter((F.col("component_x") < F.col("component_y")) & (_unlike(*of) <= UNLIKE))
    return both.select(*_pairs(F.col("lid_x"), F.col("lid_y"))).distinct().join(tried, ["a", "b"], "left_anti")


def within(pairs: DataFrame, fine: DataFrame) -> DataFrame:
    """The pairs, as far as their lines' sketches allow."""
    x, y, of = _sides(fine)
    return pairs.join(x, F.col("a") == F.col("lid_x")).join(y, F.col("b") == F.col("lid_y")).filter(_possible(*of)).select("a", "b")


def crowded(marked: DataFrame, fine: DataFrame, tried: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different components besides those tried, as far as the bounds allow. A pair that also shares one
    of the one or two bands before is left to those."""
    before = W.partitionBy("lid").orderBy("band")
    open_ = store(marked.withColumns({f"p{k}": F.lag("band", k).over(before) for k in (1, 2)}).join(fine, "lid"), "line-open")
    x, y, of = _sides(open_)
    met = F.coalesce((F.col("p1_x") == F.col("p1_y")) | (F.col("p1_x") == F.col("p2_y")) | (F.col("p2_x") == F.col("p1_y")) | (F.col("p2_x") == F.col("p2_y")), F.lit(False))
    both = x.join(y, F.col("band_x") == F.col("band_y"))
    both = both.filter((F.col("component_x") < F.col("component_y")) & ~met & (_unlike(*of) <= UNLIKE) & _possible(*of))
    found = store(both.select(*_pairs(F.col("lid_x"), F.col("lid_y"))).distinct().join(tried, ["a", "b"], "left_anti"), "line-pairs")
    discard(open_)
    return found


def remaining(beside: DataFrame, wide: DataFrame, lines: DataFrame, tried: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) to test: those of small bands, `beside`, and those of the larger bands' rows, `wide`, as far as the
    bounds allow."""
    spark = lines.sparkSession
    ends = beside.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    with spent(spark):
        many, packed = beside.count() > TESTS * ends.count(), not _few(wide)
    held, parts = [], []
    if many or packed:
        which = ends if not packed else wide.select("lid") if not many else ends.union(wide.select("lid"))
        fine = store(sketches(lines.join(which.distinct(), "lid", "left_semi")), "line-sketches")
        held.append(fine)
        release(spark)
    parts.append(within(beside, fine) if many else beside)
    if packed:
        held.append(crowded(wide, fine, tried))
        parts.append(held[-1])
        release(spark)
    else:
        parts.append(near(wide, tried))
    found = store(parts[0].union(parts[1]).distinct(), "line-pairs")
    for gone in held:
        discard(gone)
    release(spark)
    return found


def linked(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold. Texts are sent, as a set takes four bytes a character; sets are
    made in the pair's row as 32 bits a shingle: of two lines with 250 shingles one pair in 100,000 has a shingle taken for another."""
    a, b = (lines.select(F.col("lid").alias(c), F.col("line").alias(f"l{c}")) for c in "ab")
    shingles = F.struct(*(_shingles(_units(F.col(f"l{c}")), F.hash).alias(c) for c in "ab"))
    # exploded, so that the filter can't be moved to where it would work them out for each use
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.explode(F.array(shingles)).alias("s"))
    alike = 100 * F.size(F.array_intersect("s.a", "s.b")) >= PERCENT * F.size(F.array_union("s.a", "s.b"))
    found = store(both.filter(alike).select("a", "b"), "line-links")
    release(pairs.sparkSession)
    return found


def _joined(groups: DataFrame | None, new: DataFrame) -> DataFrame:
    """(lid, component) of the groups and new links: a line's edge to its component's smallest stands for all links before."""
    if groups is not None:
        new = new.union(groups.select(F.col("lid").alias("a"), F.col("component").alias("b")))
    return components(new).select(F.col("node").alias("lid"), "component")


def groups_of(bands: DataFrame, lines: DataFrame) -> DataFrame:
    """(lid, component) of the lines that are linked with another, from their bands with signatures and their texts."""
    spark = bands.sparkSession
    groups = tried = beside = None
    held, known, open_ = [], 0, bands
    for turn in range(TURNS):
        pairs = store(candidates(open_, tried, turn), "line-pairs")
        held.append(pairs)
        release(spark)
        tried, new = pairs if tried is None else tried.union(pairs), linked(pairs, lines)
        count = new.count()
        known += count
        if count or groups is None:
            groups = _joined(groups, new)
        open_ = store(_several(open_, groups), "line-open")  # a band that holds one component stays so
        held.append(open_)
        release(spark)
        last = 10 * count < known or not count or turn == TURNS - 1  # what links remain are too few to be met this way
        if beside is None:
            beside = store(near(open_.filter(F.col("size") <= SMALL), tried), "line-near")  # out of SMALL / 2 a row at most
            held.append(beside)
            release(spark)
            if last or beside.count() <= FEW * open_.count():  # another turn would cost as much as these pairs
                open_ = open_.filter(F.col("size") > SMALL)
            else:
                beside = None
        if last or (beside is not None and _few(open_)):
            break
    rest = remaining(beside, open_, lines, tried)
    release(spark)
    if not rest.isEmpty():
        groups = _joined(groups, linked(rest, lines))
    for gone in (rest, *held):
        discard(gone)
    return groups


def removals(docs: DataFrame) -> DataFrame:
    """(id, th, gone): numbers of the lines to remove from each document that has any."""
    spark = docs.sparkSession
    texts = store(occurrences(docs), "line-texts")
    signed = store(signatures(distinct_lines(texts.select("lid", "line").repartition("lid"))), "line-signatures")
    release(spark)
    shared = store(banded(signed), "line-bands")
    release(spark)
    bands = promising(_several(shared, None).join(signed.drop("bands"), "lid"))
    for table in (shared, signed):
        discard(table)
    release(spark)
    # of the texts only those of lines that may have a partner are needed from here on
    lines = store(distinct_lines(texts.select("lid", "line").join(bands.select("lid").distinct(), "lid", "left_semi")), "lines")
    places = store(texts.drop("line"), "line-places")
    discard(texts)
    release(spark)
    groups = groups_of(bands, lines)
    for table in (bands, lines):
        discard(table)
    o = places.join(groups, "lid", "left").select("id", "th", "no", F.coalesce("component", "lid").alias("component"))
    first = store(o.groupBy("component").agg(F.min(F.struct("id", "th", "no")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("component", "first"), "line-firsts")
    gone = o.join(first, "component").filter(F.struct("id", "th", "no") != F.col("first"))
    gone = store(gone.groupBy("id", "th").agg(F.collect_list("no").alias("gone")), "line-removals")
    discard(places)
    discard(first)
    release(spark)
    return gone


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` without repeated lines, with n_lines and n_removed added (blank lines count as lines, and stay)."""
    made = ["n_lines", "n_removed"]
    kept = [c for c in docs.columns if c.lower() not in made]
    rows = docs.select(F.struct(*kept).alias("row"), _id().alias("id"), F.xxhash64("text").alias("th"))  # no name of the input is in reach
    gone = removals(docs.select("doc_id", "text"))
    d = rows.join(gone, ["id", "th"], "left").select("row", "gone", F.split("row.text", "\n").alias("lines"))
    # of numbers first and by hash, so that the cost stays linear in the lines
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in kept]
    return d.select(*columns, F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
