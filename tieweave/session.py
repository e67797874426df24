"""The session that the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tieweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings as keyword arguments with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
