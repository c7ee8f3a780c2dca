"""Event-time windows that give the same rows on a batch and on a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """With a watermark on a stream (which Spark keeps for timestamps with a zone only)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if df.isStreaming else df


def tumble(df: DataFrame, ts: str, size: str, keys: list[str], *aggs, delay: str = "10 minutes") -> DataFrame:
    w = _late(df, ts, delay).groupBy(F.window(ts, size).alias("w"), *keys).agg(*aggs)
    return w.select(F.col("w.start").cast(df.schema[ts].dataType).alias("window_start"), *[c for c in w.columns if c != "w"])


def slide(df: DataFrame, ts: str, size: str, step: str, keys: list[str], *aggs, delay: str = "10 minutes") -> DataFrame:
    w = _late(df, ts, delay).groupBy(F.window(ts, size, step).alias("w"), *keys).agg(*aggs)
    return w.select(F.col("w.start").cast(df.schema[ts].dataType).alias("window_start"), *[c for c in w.columns if c != "w"])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggs, delay: str = "10 minutes") -> DataFrame:
    w = _late(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return w.select(F.col("w.start").cast(df.schema[ts].dataType).alias("session_start"), *[c for c in w.columns if c != "w"])


def first_seen(df: DataFrame, key: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Rows of new keys only; on a stream, keys are remembered as long as the watermark asks."""
    return _late(df, ts, delay).dropDuplicatesWithinWatermark(key) if df.isStreaming else df.dropDuplicates(key)


def join_within(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, before: str, after: str, delay: str = "10 minutes") -> DataFrame:
    """Rows of both sides with equal keys whose times lie within [left - before, left + after]; streams keep no row longer than
    that and the delay ask for. Times and other columns of the sides have different names."""
    l, r = _late(left, left_ts, delay), _late(right, right_ts, delay)
    r = r.withColumnsRenamed({k: f"_{k}" for k in keys})
    near = (F.col(right_ts) >= F.col(left_ts) - F.expr(f"interval {before}")) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {after}"))
    for k in keys:
        near = near & (F.col(k) == F.col(f"_{k}"))
    kinds = {c: left.schema[c].dataType for c in (left_ts,)} | {c: right.schema[c].dataType for c in (right_ts,)}
    return l.join(r, near).drop(*(f"_{k}" for k in keys)).withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})


def totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows and sum of `value` so far per key: state of the user's own kind on a stream (a row a key and batch), a plain
    aggregate on a table, with which the stream's last row of each key agrees."""
    if not df.isStreaming:
        return df.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"))
    kind = df.schema[key].dataType.simpleString()

    def step(k, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return df.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def changes(df: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key of a change log (columns key, order, op: I, U or D, and values); deleted keys are left out."""
    rest = [c for c in df.columns if c not in (key,)]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return last.select(key, "row.*").filter("op <> 'D'")


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_end(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream gives once its present input is used up."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
