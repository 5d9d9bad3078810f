"""A session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution stays on; times are UTC; further settings override."""
    builder = SparkSession.builder.appName("panelforge").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    return builder.config(map=conf).getOrCreate() if conf else builder.getOrCreate()
