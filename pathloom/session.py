"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "pathloom", **conf: str) -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution; ``conf`` overrides or adds settings."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    builder = SparkSession.builder.appName(app)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
