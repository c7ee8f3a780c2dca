"""The star-schema tables by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> SparkSession:
    """Temporary views of the tables that a query names (plans made later keep the files they were made with)."""
    for name in NAMES:
        if re.search(rf"\b{name}\b", text):
            read(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark
