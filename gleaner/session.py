"""Session settings the engine expects; callers with a session of their own keep it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "gleaner", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC time, adaptive execution and ANSI semantics.

    ``master`` is only for tests and benches; on a cluster spark-submit names it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
    } | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
