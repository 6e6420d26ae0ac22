"""Session building and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quarrymill", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings this library expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("QUARRYMILL_SHUFFLE", "8"))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One input table; schema from the Parquet footer, columns pruned by the caller's plan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
