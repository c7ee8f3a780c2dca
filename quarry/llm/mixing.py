"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source is expected `rate = target / source size` times. Within a source the documents stand in a
fixed order; the running sum of expected copies (`rate x rank`), shifted by one pseudo-random offset of the source, is
cut at the whole numbers, and a document is emitted once for each whole number that its interval crosses. As rate is
at most the cap, no document is taken more often than ceil(cap) times, and the number of copies of every run of the
order is right within one. The order goes by size, so the words taken come near the target too.

The order is never sorted in one task: it is cut into blocks (source, size bin, hash bucket), whose counts are summed
first; the running sum over a source's blocks has at most BINS x BUCKETS rows, and ranks within a block are
counted per block. A source with a third of all rows is thus spread over as many tasks as it has blocks.

Null source is a source of its own and the last; null text has size 0; a source whose documents are all empty has
rate 0 and takes nothing; repeated rows are documents of their own (their order among themselves doesn't show in the
result); a very long text is counted like any other, where it is read; an empty table gives an empty table. Columns named
like the outputs are replaced, other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import WORD, store

#: Hash buckets of one size bin. A block holds about 1 / (bins in use x BUCKETS) of its source.
BUCKETS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash32(value: Column) -> Column:
    """Unsigned 32 bits of MD5: the same in every SQL engine."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def size_bin(size: Column) -> Column:
    """A bin that grows with the size, 8 to a doubling (whole numbers only, so every engine agrees)."""
    bits = F.length(F.bin(size)).cast("int")
    return (bits * 16 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0)))).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sizes(source, source_size): one row per source, with its target added.

    Water filling in closed form: with sources ordered by cap / weight, those before some point stop at their cap and
    the rest share what remains by weight; the point is the first at which the level is below the source's own cap.
    Resharing the excess again and again until none is above ends at the same targets. The windows without a
    partition run over one row per source, never over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.cast("double").alias("weight"))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("level", F.col("most") / F.col("weight"))
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy(F.lit(1))
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    s = s.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("full"),
        F.sum("weight").over(after).alias("open_weight"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("budget"),
    )
    s = s.withColumn("reached", (F.col("budget") - F.col("full")) / F.col("open_weight"))
    s = s.withColumn("nth", F.row_number().over(by_level))
    first = F.min(F.when(F.col("reached") <= F.col("level"), F.struct("nth", "reached"))).over(everything)
    return s.withColumn("water", F.coalesce(first["reached"], F.lit(float("inf")))).select(
        "source", "source_size", F.least(F.col("most"), F.col("weight") * F.col("water")).alias("target")
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", keep_text: bool = False) -> DataFrame:
    """Each document with size, source_size, target, copies (times it is emitted) and taken (words so taken).

    `keep_text` keeps all input columns (for emission); otherwise only doc_id and source go through the shuffle, from a table
    of sizes, so that texts are read once.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c.lower() not in made] if keep_text else ["doc_id", "source"]
    d = docs.select(F.struct(*kept).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))  # no name of the input is in reach
    if not keep_text:
        d = store(d, "mix-sizes")
    h = hash32(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = d.withColumn("h", h).withColumn("bin", size_bin(F.col("size"))).withColumn("bucket", F.col("h") % BUCKETS)
    blocks = d.groupBy("source", "bin", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    per_source = W.partitionBy("source")
    blocks = blocks.withColumn(
        "before",
        F.coalesce(F.sum("n").over(per_source.orderBy("bin", "bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    )
    rates = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), tuple(weights), share, cap)
    offset = hash32(F.concat_ws(":", F.lit(seed), F.lit("offset"), F.coalesce(F.col("source"), F.lit("")))) / F.lit(2.0**32)
    rates = rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    r = rates.select(F.col("source").alias("s"), "source_size", "target", "rate", offset.alias("offset"))
    b = blocks.join(r, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bin").alias("b"), F.col("bucket").alias("u"), "before", "source_size", "target", "rate", "offset")
    place = W.partitionBy("source", "bin", "bucket").orderBy("size", "h", F.col("doc_id").asc_nulls_first())
    d = d.withColumn("place", F.row_number().over(place))
    d = d.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")) & (F.col("bucket") == F.col("u")))
    rank = (F.col("before") + F.col("place")).cast("double")
    copies = F.floor(F.col("rate") * rank + F.col("offset")) - F.floor(F.col("rate") * (rank - 1) + F.col("offset"))
    d = d.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return d.select(*(F.col("row").getField(c).alias(c) for c in kept), *made)


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy."""
    return mixed.filter("copies > 0").select(*mixed.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("\x00copy")).drop("\x00copy")


#: The same rows in DuckDB's SQL, over the view documents.
ORACLE = f"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) as bigint) as size,
         cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h
  from documents),
b as (select *, h % {BUCKETS} as bucket, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) as size_bin from d),
p as (select *, row_number() over (partition by source order by size_bin, bucket, size, h, doc_id nulls first) as place from b),
s as (select source, sum(size)::double as source_size from d group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from s),
l as (select *, 2.0::double * source_size as most, 2.0::double * source_size / weight as level from w),
f as (select *, coalesce(sum(most) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0) as full_,
             sum(weight) over (order by level, source nulls last rows between current row and unbounded following) as open_weight,
             1.5::double * sum(source_size) over () as budget from l),
g as (select *, (budget - full_) / open_weight as reached, row_number() over (order by level, source nulls last) as nth from f),
t as (select source, source_size, least(most, weight * coalesce((select arg_min(reached, nth) from g where reached <= level), 'inf'::double)) as target from g),
r as (select *, case when source_size > 0 then target / source_size else 0 end as rate,
             cast('0x' || substr(md5('mix:offset:' || coalesce(source, '')), 1, 8) as bigint) / 4294967296.0::double as shift from t)
select doc_id, size, cast(source_size as bigint) as source_size, round(target, 6) as target,
       cast(floor(rate * place + shift) - floor(rate * (place - 1) + shift) as bigint) as copies,
       cast(floor(rate * place + shift) - floor(rate * (place - 1) + shift) as bigint) * size as taken
from p join r on p.source is not distinct from r.source
"""
