"""Blocks as content: repeated furniture, markdown, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

SHARE, LEAST_PAGES = 0.6, 3
_LEVELS = {f"h{i}": "#" * i for i in range(1, 7)}


def repeated_lines(lines: DataFrame, share: float = SHARE) -> DataFrame:
    """lines(site, page, line): normalised lines on `share` of a site's pages or more, and on three at least. A page counts a line once."""
    pages = lines.groupBy("site").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    keyed = lines.where("line is not null and line != ''").select("site", "page", X.norm_line(F.col("line")).alias("line")).distinct()
    counted = keyed.groupBy("site", "line").agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("pages") * F.lit(float(share))))
    return counted.join(pages, "site").where(F.col("n") >= need).select("site", "line", "n", "pages")


def block_lines(blocks: DataFrame) -> DataFrame:
    return blocks.where("tag != 'img' and not chrome and text != ''").select("site", F.col("url").alias("page"), F.col("text").alias("line"))


def mark_repeated(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """Blocks whose text repeats over the site count as chrome."""
    flag = repeated.select("site", F.col("line").alias("_line"), F.lit(True).alias("_again"))
    joined = blocks.withColumn("_line", X.norm_line(F.coalesce("text", F.lit("")))).join(flag, ["site", "_line"], "left")
    return joined.withColumn("chrome", F.col("chrome") | (F.coalesce("_again", F.lit(False)) & (F.col("tag") != "img"))).drop("_line", "_again")


def _line(b: Column) -> Column:
    text = F.coalesce(b["text"], F.lit(""))
    one = F.replace(text, F.lit("\n"), F.lit(" "))
    head = F.when(b["href"].isNotNull() & (b["href"] != "") & ~one.contains("]("), F.concat(F.lit("["), one, F.lit("]("), b["href"], F.lit(")"))).otherwise(one)
    out = F.when(b["tag"] == "img", F.concat(F.lit("!["), F.replace(F.coalesce(b["alt"], F.lit("")), F.lit("]"), F.lit(")")), F.lit("]("), b["src"], F.lit(")")))
    for tag, marks in _LEVELS.items():
        out = out.when(b["tag"] == tag, F.concat(F.lit(marks + " "), head))
    out = out.when(b["tag"] == "li", F.concat(F.lit("- "), F.replace(text, F.lit("\n"), F.lit("\n  "))))
    out = out.when(b["tag"] == "blockquote", F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
    out = out.when(b["tag"] == "figcaption", F.concat(F.lit("*"), one, F.lit("*"))).when(b["tag"] == "pre", F.concat(F.lit("```\n"), text, F.lit("\n```")))
    return out.otherwise(F.replace(text, F.lit("\n"), F.lit("  \n")))


def markdown(blocks: Column) -> Column:
    """Markdown of an array of blocks in order; chrome is left out, list items sit together, all else is a paragraph."""

    def build(kept: Column) -> Column:
        gap = lambda b, i: F.when(i == 0, F.lit("")).when((b["tag"] == "li") & (F.get(kept, i - 1)["tag"] == "li"), F.lit("\n")).otherwise(F.lit("\n\n"))
        body = F.array_join(F.transform(kept, lambda b, i: F.concat(gap(b, i), _line(b))), "")
        body = F.regexp_replace(F.regexp_replace(body, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")
        return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.concat(body, F.lit("\n")))

    return F.get(F.transform(F.array(F.filter(blocks, lambda b: ~b["chrome"])), build), 0)


def page_markdown(blocks: DataFrame) -> DataFrame:
    """(site, url, markdown) from a table of blocks."""
    listed = blocks.groupBy("site", "url").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", "text", "chrome", "href", "src", "alt"))).alias("blocks"))
    return listed.select("site", "url", markdown(F.col("blocks")).alias("markdown"))


def fingerprint(blocks: Column, runs: int = 8) -> Column:
    """Shape of the top of a page: tags of its own blocks, repeats as one, the first `runs`, hashed."""
    tags = F.transform(F.filter(blocks, lambda b: ~b["chrome"]), lambda b: F.when(b["tag"].rlike("^h[1-6]$"), "h").otherwise(b["tag"]))
    shape = lambda t: F.slice(F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1))), 1, runs)
    made = F.get(F.transform(F.array(tags), lambda t: F.when(F.size(t) > 0, F.substring(F.sha1(F.array_join(shape(t), " ")), 1, 10)).otherwise("")), 0)
    return made


def with_context(blocks: DataFrame) -> DataFrame:
    """Picture blocks with the heading above and the words beside: the first text among the next two blocks."""
    page = Window.partitionBy("site", "url").orderBy("pos")
    heading = F.last(F.when(F.col("tag").rlike("^h[1-6]$"), X.plain_links(F.col("text"))), True).over(page.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    words = lambda n: F.lead(F.when((F.col("tag") != "img") & (F.col("text") != ""), F.col("text")), n).over(page)
    beside = F.substring(F.coalesce(words(1), words(2), F.lit("")), 1, 200)
    return blocks.withColumns({"heading": heading, "beside": beside}).where("tag = 'img'")
