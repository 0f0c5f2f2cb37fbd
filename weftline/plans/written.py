"""Tables written in the cluster's shared folder, where a plan is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names. Where none is named, a local one does for a local master only: executors elsewhere would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"file://{tempfile.gettempdir()}/weftline-checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: lineage ends there and any executor may be lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no plan reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as a shuffle has, if it has fewer: small files are one task, too few for work on each row."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
