"""Tables as the files a reader expects: page markdown with its head, report tables, JSON lines. Writers commit whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def page_files(pages: DataFrame) -> DataFrame:
    """pages(file, url, title, meta_description, template, word_count, noindex, markdown): (file, content)."""
    head = X.frontmatter([("url", F.col("url"), "string"), ("title", F.col("title"), "string"), ("description", F.nullif(F.col("meta_description"), F.lit("")), "string"), ("template", F.col("template"), "string"), ("words", F.col("word_count"), "json"), ("noindex", F.col("noindex"), "bool")])
    return pages.where("file is not null").select(F.concat("file", F.lit(".md")).alias("file"), F.concat(head, F.lit("\n"), F.coalesce("markdown", F.lit(""))).alias("content"))


def common_lines(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """(site, ord, line): lines removed from every page, each once, as first seen."""
    lines = blocks.where("tag != 'img' and text != ''").select("site", "ord", "pos", "text", X.norm_line(F.col("text")).alias("line"))
    met = lines.join(repeated.select("site", "line"), ["site", "line"])
    return met.groupBy("site", "line").agg(F.min(F.struct("ord", "pos")).alias("at"), F.min_by("text", F.struct("ord", "pos")).alias("text")).select("site", "at", "text")


def reviews_lines(reviews: DataFrame) -> DataFrame:
    """(site, ord, pos, line): a review as a quote, its name with what its card says, and its page."""
    said = F.array_join(F.filter(F.array("date", "platform", F.when(F.col("stars").isNotNull(), F.concat(F.col("stars"), F.lit(" stars")))), lambda x: x.isNotNull()), ", ")
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("unnamed"))
    line = F.concat(F.lit("> "), F.col("quote"), F.lit("\n> — "), name, F.when(said != "", F.concat(F.lit(" ("), said, F.lit(")"))).otherwise(""), F.lit("  \n> "), F.col("url"), F.lit("\n"))
    return reviews.select("site", "ord", "pos", line.alias("line"))


def template_lines(report: DataFrame) -> DataFrame:
    cells = [F.col("template"), F.col("count").cast("string"), F.col("read").cast("string"), F.col("not_read").cast("string"), F.when(F.col("shapes") > 0, F.col("shapes").cast("string")).otherwise(""), F.coalesce(F.col("avg_words").cast("string"), F.lit("")), F.coalesce(F.get("examples", 0), F.lit(""))]
    return report.where("collection or count > 1").select("site", "template", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def issue_lines(issues: DataFrame) -> DataFrame:
    return issues.select("site", "kind", "subject", F.concat(F.lit("- "), F.col("subject"), F.lit(": "), F.col("detail")).alias("line"))


def launch_lines(rows: DataFrame) -> DataFrame:
    cells = [F.col("old_url"), F.col("verdict"), F.coalesce(F.col("status").cast("string"), "error", F.lit("")), F.coalesce("final_url", F.lit("")), F.replace(F.substring("title", 1, 60), F.lit("|"), F.lit("/")), F.array_join("findings", ", ")]
    return rows.select("old_url", "verdict", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines at path; what was there is replaced when the new files are whole."""
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def place_lines(places: DataFrame) -> DataFrame:
    """(place_id, ord, line): a place's facts as a list."""
    hours = F.array_join("opening_hours", ", ")
    rating = F.when(F.col("rating").isNotNull(), F.concat(F.col("rating").cast("string"), F.lit(" from "), F.coalesce(F.col("review_count").cast("string"), F.lit("None")), F.lit(" reviews")))
    facts = [("Address", F.col("formatted_address")), ("Phone", F.nullif(F.col("telephone"), F.lit(""))), ("Website", F.nullif(F.col("website"), F.lit(""))), ("Type", F.nullif(F.col("primary_type"), F.lit(""))), ("Status", F.nullif(F.col("status"), F.lit(""))), ("Rating", rating), ("Hours (schema.org)", F.nullif(hours, F.lit(""))), ("Time zone", F.nullif(F.col("time_zone"), F.lit("")))]
    lines = F.filter(F.array(*[F.concat(F.lit(f"- **{name}:** "), value) for name, value in facts]), lambda x: x.isNotNull())
    return places.select("place_id", F.posexplode(lines).alias("ord", "line"))
