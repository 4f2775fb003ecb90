"""Session with the settings that the engine's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC dates, ANSI errors and adaptive execution; anything else is the cluster's own."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
