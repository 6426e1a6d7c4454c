"""Session factory with the settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "meshspan", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
