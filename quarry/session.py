"""One place for the session settings every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results or plans; the cluster decides the rest.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "quarry", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the shared settings; `master` only where no cluster sets it."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = os.cpu_count() or 4
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(2 * cores))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
        )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
