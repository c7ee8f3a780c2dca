"""Functions of a user's own, by name in SQL: scalar, aggregate and table functions, worked out on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.plans.errors import QuarryError


class Functions:
    """A registry of one session; a name is given once, and never that of a function that Spark has."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kinds = spark, {}

    def _claim(self, name: str, kind: str) -> None:
        if name.lower() in self.kinds or self.spark.catalog.functionExists(name):
            raise QuarryError("DUPLICATE_FUNCTION", name=name)
        self.kinds[name.lower()] = kind

    def scalar(self, name: str, result: str, f: Callable[..., pd.Series]) -> None:
        """f: series of the arguments -> series of the results."""
        self._claim(name, "scalar")
        self.spark.udf.register(name, F.pandas_udf(f, result))

    def aggregate(self, name: str, result: str, f: Callable[..., object]) -> None:
        """f: all values of a group -> one value. A group is held by one task: for aggregates that can't be combined only."""
        self._claim(name, "aggregate")
        self.spark.udf.register(name, F.pandas_udf(f, result))

    def table(self, name: str, result: str, f: type) -> None:
        """f: a class whose eval(arguments) yields rows of the schema."""
        self._claim(name, "table")
        self.spark.udtf.register(name, F.udtf(f, returnType=result))
