"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallywright", **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution; further settings as keywords with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
