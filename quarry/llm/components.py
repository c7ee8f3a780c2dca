"""Connected components of an edge table: distributed union-find with DataFrame operations only.

Alternates large-star and small-star rounds: every node hands its larger (then its not larger) neighbours to its
smallest one, until the edges are stars around the smallest node of each component. Rounds grow with the logarithm of
the component's size. Each round is written to the shared folder, so lineage stays short and lost executors cost one
round at most; the driver sees two numbers a round. A node with very many edges is the hot key of a join between
two shuffled tables, which adaptive execution splits; the minimum per node is aggregated before its shuffle.

Up to SMALL edges, the same rounds run in one task, CHAIN of them a job: without shuffles, a small table costs a few tasks
and not some in each partition of several shuffles a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import discard, spent, store

#: Edges that one task takes, and rounds of a job on them.
SMALL, CHAIN = 1 << 18, 3


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    large = both.join(_least(both).withColumnRenamed("a", "u"), F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a <> b").distinct()
    # every edge now leads from a larger to a smaller node
    m = _least(large).withColumnRenamed("a", "u")
    small = large.join(m, F.col("a") == F.col("u")).select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
    return small.filter("a <> b").distinct()


def _rounds(edges: DataFrame) -> DataFrame:
    """CHAIN rounds in one task: a single partition needs no shuffle, and a window in place of a join reads its rows once."""
    least = F.least(F.col("a"), F.min("b").over(W.partitionBy("a")))
    current = edges.coalesce(1)
    for _ in range(CHAIN):
        both = current.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        large = both.withColumn("m", least).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.withColumn("m", least).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        current = small.filter("a <> b").distinct()
    return current


def _state(edges: DataFrame):
    with spent(edges.sparkSession):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any integer type -> (node, component): the smallest node; only nodes with edges appear."""
    current = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(current)
    while state[0]:
        following = store(_rounds(current) if state[0] <= SMALL else _round(current), "edges")
        discard(current)
        current, before, state = following, state, _state(following)
        if state == before:
            break
    centres = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres)
