"""State of an earlier run: tables with a version, read only if the version fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import STATE_VERSION


def save(df: DataFrame, path: str, version: int = STATE_VERSION) -> None:
    df.withColumn("state_version", F.lit(version)).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, version: int = STATE_VERSION) -> DataFrame:
    """Rows of the version; those of another are ignored, not converted."""
    return spark.read.parquet(path).where(F.col("state_version") == version).drop("state_version")


def without(kept: DataFrame, reread: DataFrame) -> DataFrame:
    """What was kept, less the URLs that are read again: a page is no duplicate of its own earlier copy."""
    return kept.join(reread.select("url").distinct(), "url", "left_anti")
