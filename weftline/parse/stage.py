"""The parse stage: pages(url, html) to one nested row per page, in Arrow batches; everything else explodes it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..functions.vectorised import vectorised
from .a11y import findings
from .page_parser import parse_page
from .reviews import jsonld_reviews, page_reviews

_LINK = "href string, text string, landmark string, in_main boolean, depth int, `group` string, classes array<string>, rel string"
_SRCSET = "array<struct<url:string,w:int>>"
BLOCK = f"tag string, text string, chrome boolean, href string, src string, alt string, srcset {_SRCSET}, shown int, row int, background boolean"
IMAGE = f"src string, srcset array<string>, srcset_w {_SRCSET}, alt string, alt_missing boolean, width int, height int, landmark string, in_link boolean, link_href string, classes array<string>, row int, video boolean, autoplay boolean"


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


_HEAD = "title string, lang string, meta map<string,string>, meta_description string, canonical string, hreflang array<struct<lang:string,href:string>>, noindex boolean, h1 string, h1_count int, headings array<struct<tag:string,text:string>>"
_TAIL = "forms array<struct<action:string,method:string,fields:array<struct<name:string,type:string,required:boolean>>,landmark:string>>, iframes array<string>, scripts array<string>, script_text array<string>, jsonld_raw array<string>, microdata array<struct<type:string,props:map<string,string>>>, landmark_lines map<string,array<string>>, body_word_count int, has_landmarks boolean"


def page_type() -> T.StructType:
    """The fields of a parsed page."""
    listed = lambda name, ddl: T.StructField(name, T.ArrayType(_struct(ddl)))
    return T.StructType([*_struct(_HEAD).fields, listed("links", _LINK), listed("internal_links", _LINK), listed("images", IMAGE), *_struct(_TAIL).fields, listed("blocks", BLOCK)])


REVIEW = "array<struct<quote:string,name:string,date:string,platform:string,stars:string,url:string,origin:string>>"


def _shaped(value: object, kind: T.DataType) -> object:
    """value with every field its type names; what is missing is null."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _shaped(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return [_shaped(v, kind.elementType) for v in value]
    return value


def parse(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with the fields of page_type(); columns of pages that clash with them are replaced. Null html is an empty page."""
    page = page_type()
    carried = [c for c in pages.columns if c not in page.names]
    schema = T.StructType([pages.schema[c] for c in carried] + page.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256].reset_index(drop=True)
                rows = [_shaped(parse_page(h, u), page) for u, h in zip(part[url], part[html])]
                own = pd.DataFrame({f.name: pd.Series([r[f.name] for r in rows], dtype=object) for f in page})
                for f in page:
                    if isinstance(f.dataType, (T.BooleanType, T.IntegerType)):
                        own[f.name] = own[f.name].astype("bool" if isinstance(f.dataType, T.BooleanType) else "int32")
                yield pd.concat([part[carried], own], axis=1)

    return pages.mapInPandas(run, schema)


@vectorised("array<string>")
def _findings(html: pd.Series, title: pd.Series, description: pd.Series) -> pd.Series:
    return pd.Series([findings(h, t or "", d or "") for h, t, d in zip(html, title, description)])


def a11y_findings(html: Column, title: Column, description: Column) -> Column:
    return _findings(html, title, description)


@vectorised(REVIEW)
def _reviews(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([page_reviews(h, u) for h, u in zip(html, url)])


def reviews(html: Column, url: Column) -> Column:
    return _reviews(html, url)


@vectorised(f"struct<reviews:{REVIEW},ratings:array<struct<value:string,count:string,best:string,url:string>>>")
def _stated(items: pd.Series, url: pd.Series) -> pd.DataFrame:
    both = [jsonld_reviews(list(i) if i is not None else [], u) for i, u in zip(items, url)]
    return pd.DataFrame({"reviews": [r for r, _ in both], "ratings": [r for _, r in both]})


def stated_reviews(items: Column, url: Column) -> Column:
    """Reviews and ratings in JSON-LD items."""
    return _stated(items, url)
