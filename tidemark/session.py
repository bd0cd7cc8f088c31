"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, app: str = "tidemark", **conf: str) -> SparkSession:
    """Builds (or returns) a session; ``master`` stays unset under spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which the cluster names.

    Only a local session, whose tasks all see this machine's disk, may fall back
    to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        fresh = spark.sql("SELECT uuid()").first()[0]
        return f"{root.rstrip('/')}/{name}-{fresh}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix=f"{name}-")
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
