"""Session defaults for clusters and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(app: str = "millrace", shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """AQE with skew handling, UTC, Arrow; the number of shuffle partitions only where one is given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else b


def local(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        builder(shuffle_partitions=shuffle_partitions).master(f"local[{cores}]")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").getOrCreate()
    )
