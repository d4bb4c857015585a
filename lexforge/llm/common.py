"""What the operators share: table access and scratch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import bucketed, release, scratch_dir, scratch_path, stored
from ..session import ship

__all__ = ["bucketed", "partitions", "release", "scratch_dir", "scratch_path", "ship", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
