"""Computed styles of pages folded into one picture of a site's look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R

FONTS, COLORS, BUTTONS, LOGOS = 8, 16, 8, 6
ROLES = ("body", "h1", "h2", "h3", "p", "a")


def _top(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` keys of each site with the greatest n; of equals the first met."""
    order = Window.partitionBy("site").orderBy(F.desc("n"), "first")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("site", key, "n", "rank")


def fonts(readings: DataFrame) -> DataFrame:
    """readings(site, ord, fonts, colors, roles, buttons, logos): first families by number of uses."""
    each = readings.select("site", "ord", F.posexplode("fonts").alias("pos", "families")).withColumn("font", F.get(R.family_names(F.col("families")), 0)).where("font is not null")
    return _top(each.groupBy("site", "font").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first")), "font", FONTS)


def colors(readings: DataFrame) -> DataFrame:
    each = readings.select("site", "ord", F.posexplode("colors").alias("pos", "c")).select("site", "ord", "pos", R.normalize_color(F.col("c.value")).alias("color"), F.col("c.n").alias("c")).where("color is not null")
    return _top(each.groupBy("site", "color").agg(F.sum("c").cast("bigint").alias("n"), F.min(F.struct("ord", "pos")).alias("first")), "color", COLORS)


def roles(readings: DataFrame) -> DataFrame:
    """First reading of each text role."""
    each = readings.select("site", "ord", F.explode("roles").alias("role", "r")).where(F.col("role").isin(*ROLES) & F.col("r").isNotNull())
    one = each.groupBy("site", "role").agg(F.min_by("r", "ord").alias("r"))
    return one.select("site", "role", F.coalesce(F.get(R.family_names(F.col("r.font")), 0), F.lit("")).alias("font"), "r.size", "r.weight", "r.lineHeight", "r.letterSpacing", R.normalize_color(F.col("r.color")).alias("color"), R.normalize_color(F.col("r.background")).alias("background"))


def _first_distinct(readings: DataFrame, column: str, shape, most: int) -> DataFrame:
    each = readings.select("site", "ord", F.posexplode(column).alias("pos", "x")).withColumn("x", shape(F.col("x")))
    once = each.groupBy("site", "x").agg(F.min(F.struct("ord", "pos")).alias("first"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("first"))).where(F.col("rank") <= most).select("site", "rank", "x.*")


def buttons(readings: DataFrame) -> DataFrame:
    def shape(b):
        font = F.coalesce(F.get(R.family_names(b["font"]), 0), F.lit(""))
        return F.struct(b["text"].alias("text"), R.normalize_color(b["background"]).alias("background"), R.normalize_color(b["color"]).alias("color"), b["radius"].alias("radius"), font.alias("font"), b["weight"].alias("weight"), b["padding"].alias("padding"))

    return _first_distinct(readings, "buttons", shape, BUTTONS)


def logos(readings: DataFrame) -> DataFrame:
    return _first_distinct(readings, "logos", lambda l: l, LOGOS)
