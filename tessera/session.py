"""Session settings the engine relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: What the engine sets on any session it is given; all are runtime settings.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def build_session(app: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Applies the settings that results depend on to an existing session."""
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        if spark.conf.get(k, None) != SETTINGS[k]:
            spark.conf.set(k, SETTINGS[k])
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``,
    or else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
