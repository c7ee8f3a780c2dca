"""Sources and sinks by format name: a registry in front of Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.plans.errors import QuarryError

_readers: dict[str, Callable] = {}
_writers: dict[str, Callable] = {}
FILES = ("parquet", "orc", "csv", "json", "text")
#: Table formats whose readers come as jars; used if the session has them.
JARS = ("paimon", "iceberg", "delta")


def register(name: str, reader: Callable[[SparkSession, str, dict], DataFrame], writer: Callable[[DataFrame, str, str, dict], None] | None = None) -> None:
    """A storage engine: how its tables are read and, if they can be, written."""
    if name in _readers:
        raise QuarryError("DUPLICATE_FORMAT", name=name)
    _readers[name] = reader
    if writer:
        _writers[name] = writer


def register_source(spark: SparkSession, source: type) -> None:
    """A storage engine of Spark's Python data source interface: read in partitions, written if it has a writer."""
    spark.dataSource.register(source)
    name = source.name()
    register(name, _files(name), lambda df, path, mode, options: df.write.format(name).mode("append" if mode == "append" else "overwrite").options(**options).save(path))


def formats() -> list[str]:
    return sorted(_readers)


def read(spark: SparkSession, kind: str, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    if kind not in _readers:
        raise QuarryError("UNSUPPORTED_FORMAT", name=kind)
    options = dict(options)
    if schema is not None:
        options["_schema"] = schema
    return _readers[kind](spark, path, options)


def write(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    if kind in _writers:
        return _writers[kind](df, path, mode, options)
    if kind not in FILES + JARS:
        raise QuarryError("UNSUPPORTED_FORMAT", name=kind)
    w = df.write.format(kind).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """The relation without rows."""
    return spark.createDataFrame([], schema)


def _files(kind: str) -> Callable:
    def load(spark: SparkSession, path: str, options: dict) -> DataFrame:
        options = dict(options)
        schema = options.pop("_schema", None)
        r = spark.read.format(kind).options(**options)
        return (r.schema(schema) if schema is not None else r).load(path)

    return load


def _versioned(spark: SparkSession, path: str, options: dict) -> DataFrame:
    from quarry.operators.mutate import Table

    return Table(spark, path).read(options.get("version"))


#: Tables that the driver's memory holds, by name: for small inputs and tests (at most MEMORY_ROWS rows each).
_memory: dict[str, tuple[T.StructType, list]] = {}
MEMORY_ROWS = 100_000


def _from_memory(spark: SparkSession, name: str, options: dict) -> DataFrame:
    if name not in _memory:
        raise QuarryError("TABLE_NOT_FOUND", name=name)
    schema, rows = _memory[name]
    return spark.createDataFrame(rows, schema)


def _to_memory(df: DataFrame, name: str, mode: str, options: dict) -> None:
    if name in _memory and mode == "errorifexists":
        raise QuarryError("TABLE_EXISTS", name=name)
    rows = df.limit(MEMORY_ROWS + 1).collect()
    rows = [*_memory[name][1], *rows] if mode == "append" and name in _memory else rows
    if len(rows) > MEMORY_ROWS:
        raise QuarryError("TOO_LARGE_FOR_MEMORY", name=name, most=MEMORY_ROWS)
    _memory[name] = (df.schema, rows)


for _kind in FILES + JARS:
    register(_kind, _files(_kind))
register("versioned", _versioned)
register("memory", _from_memory, _to_memory)
