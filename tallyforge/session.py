"""A session with the settings that this engine's plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf: further settings, dots written as two underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
