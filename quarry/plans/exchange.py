"""Explicit distribution: gather, hash repartition, replicate; and what a plan exchanges."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.relational import BROADCAST_BYTES, estimated_bytes
from quarry.plans.errors import QuarryError


def gather(df: DataFrame) -> DataFrame:
    """All rows in one partition (small results only); what comes before keeps its tasks."""
    return df.repartition(1)


def by_hash(df: DataFrame, keys: list, partitions: int | None = None) -> DataFrame:
    """Rows of equal key expressions together."""
    if not keys:
        raise QuarryError("NO_KEYS")
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def replicate(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a side for broadcast; refuses sides that the optimizer estimates above `most` bytes."""
    if (size := estimated_bytes(df)) > most:
        raise QuarryError("TOO_LARGE_TO_REPLICATE", bytes=size, most=most)
    return F.broadcast(df)


def exchanges(df: DataFrame) -> list[str]:
    """Kinds of exchange in the plan, from the root."""
    text = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Exchange (hashpartitioning|SinglePartition|rangepartitioning|RoundRobinPartitioning)|(BroadcastExchange)", text)
    return [a or b for a, b in found]
