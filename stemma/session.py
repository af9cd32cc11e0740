"""A session with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "stemma", **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, Kryo; partitions sized for executors with a few GB a core."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.ui.enabled": "false",
    } | conf
    b = SparkSession.builder.appName(name).config(map=settings)
    return (b.master(master or f"local[{cpus}]")).getOrCreate()
