"""Session defaults and scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with what every job relies on: UTC, ANSI, adaptive plans."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return pin(builder.getOrCreate())


def pin(spark: SparkSession) -> SparkSession:
    """Event time is UTC, whatever the session was started with."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir where the cluster names it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base}/tideline/{name}-{uuid.uuid4().hex}"
