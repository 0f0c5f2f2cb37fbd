"""Incremental runs over files as they arrive: latest-wins registries, and duplicates against what was kept before.

A run has a folder: the stream's checkpoint, and tables whose parts are named by the batch that wrote them. A batch reads what
earlier batches wrote and writes a part of its own, so one that runs again finds the state it started from, and a run that is
started again goes on where the last one stopped. Results and kept pages are appended; a registry, as large as its keys are
many, is written anew and its older parts go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import changes, dedupe
from ..plans.written import shared_folder, written


class Parts:
    """A table in parts, one for each batch; a part counts when it is written whole."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, T.StructType.fromDDL(schema)

    def _files(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        """Batches whose parts are whole."""
        fs, path = self._files()
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        whole = lambda p: fs.exists(p.suffix("/_SUCCESS"))
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and whole(p))

    def read(self, numbers: list[int]) -> DataFrame:
        paths = [f"{self.folder}/{n}" for n in numbers]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, number: int) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/{number}")

    def drop(self, numbers: list[int]) -> None:
        fs, path = self._files()
        for n in numbers:
            fs.delete(path.suffix(f"/{n}"), True)


def _run(stream: DataFrame, fold, folder: str) -> None:
    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()


def _source(spark: SparkSession, path: str) -> DataFrame:
    """Files of a table, or the one file that is the table, as a stream."""
    now = spark.read.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    stream = spark.readStream.schema(now.schema)
    if all(f.rstrip("/").endswith(f"/{name}") for f in now.inputFiles()):
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def registry(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Latest event of each user, from a stream of events read to its present end; started again on the same folder it reads what is new."""
    parts = Parts(spark, f"{folder}/registry", "user_id bigint, event_type string, event_id bigint, ts timestamp")

    def fold(batch: DataFrame, number: int) -> None:
        before = [n for n in parts.numbers() if n < number]
        both = batch.select(*parts.schema.names).unionByName(parts.read(before[-1:]))
        parts.write(changes.latest(both, ["user_id"], [F.desc("ts"), F.desc("event_id")]), number)
        parts.drop(before[:-1])

    _run(_source(spark, path), fold, folder)
    return parts.read(parts.numbers()[-1:]).select("user_id", "event_type", "event_id")


def dedupe_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Documents kept by digest and signature against those kept by earlier batches, from a stream read to its present end; started again on the same folder it reads what is new."""
    kept = Parts(spark, f"{folder}/kept", "site string, ord bigint, digest string, signature array<bigint>")
    fates = Parts(spark, f"{folder}/fates", "site string, ord bigint, kept boolean, reason string")

    def fold(batch: DataFrame, number: int) -> None:
        before = [n for n in kept.numbers() if n < number]
        rows = batch.select(F.lit("all").alias("site"), F.col("doc_id").alias("ord"), "text")
        fate = written(dedupe.greedy(rows, kept_before=kept.read(before) if before else None), "fate")
        own = rows.join(fate.where("kept").select("site", "ord"), ["site", "ord"], "left_semi")
        fates.write(fate, number)
        kept.write(own.select("site", "ord", X.content_digest(F.coalesce("text", F.lit(""))).alias("digest"), X.minhash(F.col("text")).alias("signature")), number)

    _run(_source(spark, path), fold, folder)
    return fates.read(fates.numbers()).select(F.col("ord").alias("doc_id"), "kept", "reason")


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def registry_once(spark: SparkSession, path: str) -> DataFrame:
    return registry(spark, path, _fresh(spark, "registry"))


def dedupe_once(spark: SparkSession, path: str) -> DataFrame:
    return dedupe_files(spark, path, _fresh(spark, "dedupe"))


def first_seen(urls: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of urls(url, ts) with each URL once within the delay: the seen set of a frontier."""
    return urls.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url"])


def pace(throttled: DataFrame, most_delay: float = 8.0, first_delay: float = 0.5) -> DataFrame:
    """throttled(site, seq): delay after each throttled answer, doubling up to a limit, and the width that is left."""
    n = F.row_number().over(Window.partitionBy("site").orderBy("seq"))
    return throttled.withColumn("n", n).select("site", "seq", F.least(F.lit(most_delay), F.lit(first_delay) * F.pow(F.lit(2.0), F.col("n"))).alias("delay"), F.lit(1).alias("width"))
