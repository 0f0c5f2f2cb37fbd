"""Functions for SQL: table functions over a page's HTML, and views of the tables of a run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import minhash_of
from .parse.a11y import findings
from .parse.page_parser import parse_page


class HtmlBlocks:
    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for pos, b in enumerate(parse_page(html, url)["blocks"]):
            yield pos, b["tag"], b["text"], b["chrome"], b.get("href"), b.get("src")


class HtmlLinks:
    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for pos, x in enumerate(parse_page(html, url)["links"]):
            yield pos, x["href"], x["text"], x["landmark"], x["in_main"], x["depth"]


class A11yFindings:
    def eval(self, html: str) -> Iterator[tuple]:
        page = parse_page(html, "")
        for pos, f in enumerate(findings(html, page["title"], page["meta_description"])):
            yield pos, f


def _signatures(text: pd.Series) -> pd.Series:
    return text.fillna("").map(minhash_of)


def register(spark: SparkSession) -> None:
    """html_blocks(html, url), html_links(html, url) and a11y_findings(html) for LATERAL joins, and minhash(text)."""
    for name, cls, schema in (
        ("html_blocks", HtmlBlocks, "pos int, tag string, text string, chrome boolean, href string, src string"),
        ("html_links", HtmlLinks, "pos int, href string, text string, landmark string, in_main boolean, depth int"),
        ("a11y_findings", A11yFindings, "pos int, finding string"),
    ):
        spark.udtf.register(name, F.udtf(cls, returnType=schema))
    spark.udf.register("minhash", F.pandas_udf(_signatures, "array<bigint>"))
