"""SQL type names and Spark types, both ways."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from quarry.plans.errors import QuarryError

#: Fixed spellings.
SIMPLE = {
    "BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(),
    "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(), "BLOB": T.BinaryType(), "TEXT": T.StringType(), "STRING": T.StringType(),
    "VARCHAR": T.StringType(), "CHAR": T.StringType(), "CHARACTER": T.StringType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP WITH TIME ZONE": T.TimestampType(),
}


def parse(name: str) -> T.DataType:
    """Type of a SQL spelling; lengths of strings are dropped, decimals default to (38, 0)."""
    m = re.fullmatch(r"\s*([A-Za-z ]+?)\s*(?:\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\))?((?: +WITH +TIME +ZONE)?)\s*", name, re.I)
    if not m:
        raise QuarryError("UNSUPPORTED_TYPE", name=name)
    word = re.sub(" +", " ", (m[1] + m[4]).upper())
    if word in ("DECIMAL", "NUMERIC", "DEC"):
        return T.DecimalType(int(m[2] or 38), max(0, int(m[3] or 0)))
    if word == "TIME" and hasattr(T, "TimeType"):
        return T.TimeType(int(m[2] or 0))
    if word not in SIMPLE:
        raise QuarryError("UNSUPPORTED_TYPE", name=name)
    return SIMPLE[word]


def spell(kind: T.DataType) -> str:
    """The name that `parse` reads back as this type."""
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    for word, known in SIMPLE.items():
        if kind == known:
            return word
    raise QuarryError("UNSUPPORTED_TYPE", name=kind.simpleString())


def schema(columns: list[tuple[str, str, bool]]) -> T.StructType:
    return T.StructType([T.StructField(n, parse(t), nullable) for n, t, nullable in columns])
