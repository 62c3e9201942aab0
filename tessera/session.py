"""Sessions and fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
