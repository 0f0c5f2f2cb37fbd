"""What changed between two runs, and registries where the latest entry wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def status(now: DataFrame, before: DataFrame) -> DataFrame:
    """now(url, hash), before(url, hash): each URL as new, changed, same, or earlier (read before, not now)."""
    both = now.select("url", F.col("hash").alias("now")).join(before.select("url", F.col("hash").alias("old")), "url", "full")
    change = F.when(F.col("now").isNull(), "earlier").when(F.col("old").isNull(), "new").when(F.col("now") == F.col("old"), "same").otherwise("changed")
    return both.select("url", change.alias("change"))


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def upsert(registry: DataFrame, entries: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """registry and entries (key, updated, attrs): an entry's attributes cover those of the row it replaces, which cover the defaults."""
    given = F.create_map(*[F.lit(x) for kv in (defaults or {}).items() for x in kv]) if defaults else F.create_map().cast("map<string,string>")
    none = F.create_map().cast("map<string,string>")
    both = registry.select("key", F.col("updated").alias("old_updated"), F.col("attrs").alias("old")).join(entries, "key", "full")
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)
    old, new = F.coalesce("old", none), F.coalesce("attrs", none)
    merged = F.when(F.col("attrs").isNull(), old).otherwise(over(over(given, old), new))
    return both.select("key", F.coalesce("updated", "old_updated").alias("updated"), merged.alias("attrs"))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The latest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def not_yet_known(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(known.select(*on).distinct(), on, "left_anti")


def filled(rows: DataFrame, known: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns that an earlier run knows, where this one has none."""
    old = known.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(old, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])
