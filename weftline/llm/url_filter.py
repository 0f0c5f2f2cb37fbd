"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

Every glob rule owns a run of bits in a multiword Shift-And mask: one bit per literal character or `?`, and a self-loop
where a `*` stands; `[c]` is the character c itself; the `*` before the host of a site rule stops at the first `/`. One pass
over a URL's bytes simulates all rules at once; a batch of URLs advances together, one byte position at a time, on arrays of
64-bit words. Site rules run over host and path as they stand, block globs over the canonical URL: host without user, port and
final dots, path without dot segments and needless escapes, and the query.

Defined results: a null URL or one without `://` has an empty host and path and matches only rules that match the empty
string; long URLs are read whole; equal URLs get equal verdicts; an empty table gives an empty table. Own columns start
with `_u_`, other columns are carried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_buffers


@dataclass(frozen=True)
class SiteRule:
    """Fits `host` and its subdomains where the path starts with `path`. The longest rule wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.name}*", f"*.{self.name}*"]


SITE_RULES = (
    SiteRule("allow", "org", "/"),
    SiteRule("block", "example.org", "/es/"),
    SiteRule("block", "example.org", "/en/1"),
    SiteRule("allow", "com", "/fr/"),
    SiteRule("block", "com", "/de/"),
)


def segment(name: str) -> tuple[str, ...]:
    """Globs for a path segment of this name."""
    return f"*/{name}", f"*/{name}/*", f"*/{name}[?]*"


#: Globs over the canonical URL for pages that no site rule fits; one hit blocks.
BLOCK_GLOBS = (
    *(f"*{word}*" for word in ("casino", "porn", "xxx", "viagra", "betting", "escort", "torrent", "doubleclick")),
    *(g for name in ("login", "signin", "signup", "cart", "checkout", "wp-admin") for g in segment(name)),
    *("*/search[?]*", "*.exe", "*.zip", "ads.*", "*.ads.*", "*/tag/*/page/*"),
)
#: Rules of a table, at most: they go to every task.
MOST_RULES = 100_000


def globs_of(rules: DataFrame, glob: str = "glob") -> tuple[str, ...]:
    """The block globs of a table of rules; a table of more than MOST_RULES is refused, not cut."""
    got = [r[0] for r in rules.where(F.col(f"`{glob}`").isNotNull()).select(glob).distinct().orderBy(glob).limit(MOST_RULES + 1).collect()]
    if len(got) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(got)


_ESCAPE = re.compile(rb"%([0-9a-fA-F]{2})")
_PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~")


def canonical(url: str, host: str, path: str) -> str:
    """The URL that block globs are matched with; empty for a URL without host and path."""
    host = re.sub(r":[0-9]*$", "", host.rpartition("@")[2]).rstrip(".")
    if "%" in path:
        path = _ESCAPE.sub(lambda m: bytes([c]) if (c := int(m[1], 16)) in _PLAIN else m[0].upper(), path.encode()).decode()
    if "/." in path:
        kept: list[str] = []
        for part in path.split("/"):
            if part == "..":
                kept[1:] = kept[1:-1]
            elif part != ".":
                kept.append(part)
        path = "/".join(kept) + "/" * (path.endswith(("/.", "/..")))
    rest = url.partition("://")[2].partition("#")[0]
    return host + path + "".join(rest.partition("?")[1:])


class Automaton:
    """Globs packed into words of 64 bits. A glob is cut at each `*`; `?` stands for one byte. A leading `*` of the first `in_host` globs runs over a host only, so not over `/`."""

    def __init__(self, globs: list[str] | tuple[str, ...], in_host: int = 0):
        states: list[tuple[int, bool]] = []  # a byte or -1 for any; whether this state loops on every byte
        self.final, self.empty, entry, self.loops_final = [], [], [], []
        hosts = set()  # states whose loop ends with the host
        for k, g in enumerate(globs):
            raw, start = g.encode(), len(states)
            lead, loop = raw.startswith(b"*"), False
            states.append((-2, lead))  # the state before any byte
            entry.append(start)
            if k < in_host:
                hosts.add(start)
            at = 0
            while at < len(raw):
                b, named = raw[at], raw[at : at + 1] == b"[" and raw[at + 2 : at + 3] == b"]"
                if named:
                    states.append((raw[at + 1], loop))
                elif b == 0x2A:
                    states[-1] = (states[-1][0], True)
                else:
                    states.append((-1 if b == 0x3F else b, loop))
                at += 3 if named else 1
            self.final.append(len(states) - 1)
        self.words = -(-len(states) // 64)
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop, self.start = np.zeros((256, self.words), np.uint64), np.zeros(self.words, np.uint64)
        for i, (b, loop) in enumerate(states):
            bit = np.uint64(1 << (i % 64))
            if b >= 0:
                self.step[b, i // 64] |= bit
            elif b == -1:
                self.step[:, i // 64] |= bit
            if loop:
                self.loop[:, i // 64] |= bit
            if i in hosts:
                self.loop[0x2F, i // 64] &= ~bit
        for i in entry:
            self.start[i // 64] |= np.uint64(1 << (i % 64))

    def matches(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x globs."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        at, sizes = offsets[:-1][order], length[order]
        state = np.repeat(self.start[None, :], len(order), 0)
        live = len(order)
        one, carry = np.uint64(1), np.uint64(63)
        for i in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes[:live], -i, "left"))
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> carry
            byte = buf[at[:live] + i]
            state[:live] = (moved & self.step[byte]) | (now & self.loop[byte])
        out = np.empty((len(order), len(self.final)), bool)
        for k, f in enumerate(self.final):
            out[order, k] = (state[:, f // 64] >> np.uint64(f % 64)) & one == one
        return out


def host_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, url: str = "url", rules: tuple[SiteRule, ...] = SITE_RULES, block: tuple[str, ...] = BLOCK_GLOBS) -> DataFrame:
    """pages with `_u_host`, `_u_path`, `_u_rule` (the longest that fits, else null) and `_u_verdict`."""
    ranked = sorted(rules, key=lambda r: -len(r.name))
    sites, blocks = Automaton([g for r in ranked for g in r.globs()], 2 * len(ranked)), Automaton(block)
    names, verdicts = [r.name for r in ranked], [r.verdict for r in ranked]

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def verdict(whole, host, path):
        import pandas as pd

        hits = sites.matches(*text_buffers(pa.array(host + path, pa.large_string())))
        fits = hits[:, 0::2] | hits[:, 1::2]
        any_rule, best = fits.any(1), fits.argmax(1) if ranked else np.zeros(len(hits), int)
        blocked = blocks.matches(*text_buffers(pa.array([canonical(u or "", h, p) for u, h, p in zip(whole, host, path)], pa.large_string()))).any(1)
        rule = [names[b] if a else None for a, b in zip(any_rule, best)]
        said = [verdicts[b] if a else "block" if x else "allow" for a, b, x in zip(any_rule, best, blocked)]
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": said})

    split = pages.withColumns({"_u_host": host_of(F.col(f"`{url}`")), "_u_path": path_of(F.col(f"`{url}`"))})
    said = split.withColumn("_u_said", verdict(F.col(f"`{url}`").cast("string"), "_u_host", "_u_path"))
    return said.withColumns({"_u_rule": F.col("_u_said.rule"), "_u_verdict": F.col("_u_said.verdict")}).drop("_u_said")
