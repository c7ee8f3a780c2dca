"""Joins and reductions that need more than one DataFrame call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Largest side that is broadcast: by the optimizer's own estimate, never by a guess.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan (file sizes for scans; no job runs)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks `df` for broadcast only behind a check of its size; otherwise the join is left to adaptive execution."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str]) -> DataFrame:
    """Each left row with the latest right row of the same key at or before it.

    One union, one shuffle by key and a running last non-null value: no row pairs are made, however many rows match.
    A key with very many rows is one sorted partition; Spark spills it.
    """
    marks = [F.struct(*take).alias("_found")]
    l = left.select("*", F.lit(None).cast(right.select(*marks).schema["_found"].dataType).alias("_found"), F.lit(1).alias("_side"))
    r = right.select(*by, on, *marks, F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumn("_found", F.last("_found", ignorenulls=True).over(w)).filter("_side = 1")
    return filled.select(*left.columns, *(F.col(f"_found.{c}").alias(f"asof_{c}") for c in take))


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, levels: int = 24) -> DataFrame:
    """Points with the spans [start, end) that hold them: an equi-join on bins, then the exact test.

    Bins double in width from level to level, `width` at the first. A span goes to the level whose bins are as wide as itself
    at least, so it lies in two bins at most, however long it is; a point looks for its bin of each level that has spans.
    """
    length = (F.col(end) - F.col(start)) / F.lit(width)
    level = F.least(F.lit(levels), F.greatest(F.lit(0), F.ceil(F.log2(length)))).cast("int")
    s = spans.filter(F.col(end) > F.col(start)).withColumn("_level", level)
    scale = F.pow(F.lit(2.0), F.col("_level")) * F.lit(width)
    bins = F.sequence(F.floor(F.col(start) / scale), F.floor(F.col(end) / scale))
    s = s.withColumn("_bin", F.explode(bins))
    used = sorted(r[0] for r in s.select("_level").distinct().collect())  # `levels` + 1 numbers at most
    if not used:
        used = [0]
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, used)))).withColumn("_bin", F.floor(F.col(at) / (F.pow(F.lit(2.0), F.col("_level")) * F.lit(width))))
    return p.join(s, ["_level", "_bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin", "_level")


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in the given order."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def salted_sum(df: DataFrame, keys: list[str], value: str, salts: int = 16) -> DataFrame:
    """Sum by skewed keys in two steps, the first spread over salts (for aggregates that can't combine before the shuffle)."""
    part = df.groupBy(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(salts)).alias("_salt")).agg(F.sum(value).alias("_part"))
    return part.groupBy(*keys).agg(F.sum("_part").alias(f"sum_{value}"))
