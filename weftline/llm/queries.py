"""The ten operators with production parameters over whole tables, as named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, language_id, near_dup, packing, quality_knn, quality_rules, sharding, substring_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one in fewer pieces than there are cores is dealt out, so that work on each row is shared."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"], with_text=False)
    return kept.select("own.doc_id", "n_words", "n_removed", "kept_sha256")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_kept", "n_lines_failed")
    return judged.select("doc_id", *[F.col(f"_q_.{c}").alias(c) for c in columns])


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    docs = docs.select("doc_id", (F.length("raw") + 16).cast("long").alias("size"), F.crc32("raw").alias("text_crc32"))
    dealt = sharding.shard(docs, ["doc_id", "size", "text_crc32"], 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_s_shard").alias("shard"), F.col("_s_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(divisor))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(5) == 0)
    model = language_id.fit(docs.where("not held_out"), "text", "lang")
    said = language_id.predict(docs.select("doc_id", "text", "held_out"), model)
    return said.select("doc_id", "held_out", F.col("_l_language").alias("lang_pred"), F.col("_l_score").alias("score"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(3) == 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_knn.fit(docs.where("not held_out").join(labels, "doc_id"), "text", "quality")
    return quality_knn.score(docs, model).select("doc_id", "held_out", F.col("_k_score").alias("score"), (F.col("_k_score") >= 0.5).cast("int").alias("predicted"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", F.col("_u_host").alias("host"), F.col("_u_path").alias("path"), F.col("_u_rule").alias("rule"), F.col("_u_verdict").alias("verdict"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_html_extraction, op3_quality_rules, op4_sharding, op5_decontamination, op6_packing, op7_language_id, op8_quality_classifier, op9_near_dup, op10_url_filter)}
