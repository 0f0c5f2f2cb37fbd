"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, near_dup, packing, quality_rules, substring_dedup
from weftline.llm.common import discard, stash
from weftline.llm.queries import table, tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules reject go; lines that fail go from the others. Null and empty texts are rejected; equal rows fare alike."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, the one with the least id; rows without id and repeated rows count like any other. A null text is an empty one, and all of these are one class."""
    return near_dup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that repeat go; what is left, joined by spaces, is the document's text. Texts that lose nothing, null ones too, stay as they are; one that loses all is empty."""
    kept = substring_dedup.dedupe(docs)
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("own.text"))}
    text = changed["text"]
    return kept.select(*[text.alias(c) if c == "text" else F.char_length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, equal rows together; null and empty texts stay."""
    leaked = decontamination.leaking_rows(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).withColumnRenamed("row", "_c_row")
    return docs.join(leaked, decontamination.row_key("doc_id", "text") == F.col("_c_row"), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null text is an empty one and has the end id only."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]

#: SQL has no tokenizer, so the last stage's rows are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again by the next, and dropped when that has written its own."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        out = stash(stage(spark, docs, sf_dir), name)
        if at:
            discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
