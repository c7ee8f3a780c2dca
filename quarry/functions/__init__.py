"""Functions that Spark lacks or spells differently, as Column expressions (all stay in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def trunc(x: Column, digits: int = 0) -> Column:
    """Towards zero, to a number of decimals."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale).cast("double") / scale


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers: Euclid's steps folded over the most that 64 bits can need."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"]


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; 0 if either is 0."""
    divisor = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(a.cast("long")) * F.floor(F.abs(b) / divisor))


def date_bin(minutes: int, ts: Column) -> Column:
    """Start of the bin of `minutes` that a timestamp lies in, counted from the epoch."""
    return F.window(ts, f"{minutes} minutes")["start"]


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def is_zero(x: Column) -> Column:
    return x == 0


def nth_value(order: Column, x: Column, n: int) -> Column:
    """Aggregate: the n-th x by order (null if there are fewer)."""
    return F.get(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x")))), F.lit(n - 1))["x"]


def weighted_percentile(x: Column, weight: Column, p: float) -> Column:
    """Aggregate: exact percentile of x with whole-number weights."""
    return F.percentile(x, F.lit(p), weight)
