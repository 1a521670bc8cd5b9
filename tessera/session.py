"""Sessions and what Python workers need to import this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; conf adds or overrides settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workers_find(spark: SparkSession, root: str) -> None:
    """Let Python workers import from ``root``. On a cluster install the package there instead."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":")
    if root not in have:
        env["PYTHONPATH"] = ":".join([root, *filter(None, have)])
