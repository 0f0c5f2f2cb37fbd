"""Answers of servers: waits, bodies, and why a page cannot be used; as Column functions."""

from __future__ import annotations

import gzip
import zlib
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import url as U
from .vectorised import vectorised


def seconds_until(header: str | None, now: float) -> float | None:
    """Seconds that a Retry-After header asks for: a number, or a date against `now` (seconds since 1970)."""
    text = (header or "").strip()
    try:
        return max(0.0, float(text)) if text else None
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(text).timestamp() - now)
    except (TypeError, ValueError, IndexError):
        return None


@vectorised("double")
def retry_after(header: pd.Series, now: pd.Series) -> pd.Series:
    return pd.Series([seconds_until(h, n) for h, n in zip(header, now)], dtype="float64")


def body_text(body: bytes | None, encoding: str | None, cap: int) -> str | None:
    """A body as text: decompressed as its header says, cut at `cap` bytes, bytes that are not UTF-8 replaced. A broken stream gives what could be read."""
    if body is None:
        return None
    kind = (encoding or "").lower()
    if kind in ("gzip", "deflate"):
        for bits in (47, -15):
            try:
                body = zlib.decompressobj(bits).decompress(body, cap)
                break
            except zlib.error:
                continue
        else:
            try:
                body = gzip.decompress(body)
            except (OSError, EOFError, zlib.error):
                pass
    return body[:cap].decode("utf-8", "replace")


@vectorised("string")
def decode_body(body: pd.Series, encoding: pd.Series, cap: pd.Series) -> pd.Series:
    return pd.Series([body_text(b, e, int(c)) for b, e, c in zip(body, encoding, cap)])


def fits(content_type: Column, length: Column, kinds: tuple[str, ...], cap: int) -> Column:
    """Whether a file is of one of the kinds and not over the cap."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.array_contains(F.array(*[kind.startswith(k) for k in kinds]), True) & (F.coalesce(length, F.lit(0)) <= cap)


def why_not(url: Column, status: Column) -> Column:
    """Why a page is neither shown nor measured; null where it can be."""
    return F.when(status.isNull(), F.concat(F.lit("nothing answered at "), url)).when(status >= 400, F.concat(url, F.lit(" answered "), status.cast("string")))


def page_url(page: Column, dev: str = "http://localhost:3000") -> Column:
    """A full address as it is, a path on this machine's server, null for anything else."""
    return F.when(page.rlike("^https?://"), page).when(page.startswith("/"), F.concat(F.lit(dev), page))


def name_for(url: Column) -> Column:
    """`home` for the root, else the path with dashes."""
    name = F.regexp_replace(F.regexp_replace(F.lower(U.path(url)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(name == "", "home").otherwise(name)
