"""Exact and near duplicates as a reader in order would drop them: a page goes if its text equals a kept one's, or if nine in ten of its signature match a kept one's that shares a band.

Copies of one text share the fate of the first, and so do texts of equal signatures. Two signatures that match in `threshold` of
their slots differ in few of them; cut into one more group of slots than that, they have one group that is equal. Groups of slots
are the keys by which pages meet: no pair is lost, and pages that are not alike seldom meet.

Among the pages of a key the rule runs in rounds. Each round takes the first undecided pages of a key as leads (all of a small key,
of a large one more from round to round), compares them with its other pages in cells of bounded size, and settles what then
depends on nothing undecided. So a large key of copies loses them to a few leads before many are compared, one of unlike pages is
through in a few rounds, and no key is spread out into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..plans.written import discard, spread, written

#: Leads of a key in the first round, if it has so many pages; leads of larger ones, and how these grow; pages beside them in one cell.
SMALL_BAND, LEADS, GROWTH, CELL = 64, 1, 8, 4096


def exact(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages(site, ord, text): (site, ord, digest, first_ord, kept)."""
    digested = pages.select("site", "ord", X.content_digest(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    first = digested.groupBy("site", "digest").agg(F.min("ord").alias("first_ord"))
    return digested.join(first, ["site", "digest"]).withColumn("kept", F.col("ord") == F.col("first_ord"))


def signatures(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.withColumn("signature", X.minhash(F.coalesce(F.col(text), F.lit(""))))


def slots_needed(threshold: float) -> int:
    """Equal slots that make a match."""
    return int(np.ceil(X.SIGNATURE * threshold - 1e-9))


def keys(signature: Column, threshold: float) -> Column:
    """Keys of which two signatures have one in common if they match: groups of slots where matching implies an equal band, else the bands themselves."""
    groups = X.SIGNATURE - slots_needed(threshold) + 1
    if groups > X.BANDS:
        return F.transform(X.bands(signature), lambda b: F.xxhash64(b["band"], b["rows"]))
    cuts = [X.SIGNATURE * i // groups for i in range(groups + 1)]
    return F.array(*[F.xxhash64(F.lit(i), F.slice(signature, a + 1, b - a)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def candidate_pairs(signed: DataFrame, threshold: float = X.THRESHOLD) -> DataFrame:
    """(site, a, b, agreement) of pages a before b that share a band and agree in `threshold` of their signature. Only numbers meet; signatures are looked up for distinct pairs. greedy() needs no pairs."""
    rows = signed.select("site", "ord", F.explode(F.array_distinct(keys(F.col("signature"), threshold))).alias("key"))
    met = rows.withColumnRenamed("ord", "a").join(rows.withColumnRenamed("ord", "b"), ["site", "key"]).where("a < b").select("site", "a", "b").distinct()
    of = lambda n: signed.select("site", F.col("ord").alias(n), F.col("signature").alias("s" + n))
    both = met.join(of("a"), ["site", "a"]).join(of("b"), ["site", "b"]).withColumn("agreement", X.agreement(F.col("sa"), F.col("sb")))
    return both.where(F.col("agreement") >= threshold).select("site", "a", "b", "agreement")


def _matches(need: int):
    """(a, b) for leads a and pages b behind them that match, from rows sorted by cell."""

    def of_cell(rows: pa.Table) -> pa.RecordBatch:
        order, lead = rows.column("ord").to_numpy(), rows.column("lead").to_numpy()
        signature = rows.column("signature").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        rest, found = np.flatnonzero(~lead), []
        for at in np.flatnonzero(lead):
            equal = (signature[rest] == signature[at]).sum(1)
            hit = rest[(equal >= need) & (order[rest] > order[at])]
            found.append(np.stack([np.full(len(hit), order[at]), order[hit]]))
        a, b = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        site = pa.array([rows.column("site")[0].as_py()] * len(a), pa.string())
        return pa.RecordBatch.from_arrays([site, pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["site", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if held and b > a and held[-1].column("cell")[0].as_py() != cell[a]:
                    yield of_cell(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield of_cell(pa.Table.from_batches(held))

    return run


def _settle(open_: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Tables (site, ord, kept) of what open_(site, ord, covered) and edges(site, a, b) decide: a covered page without an earlier undecided match is kept, and its matches are dropped."""
    out: list[DataFrame] = []
    while True:
        keep = open_.where("covered").join(edges.select("site", F.col("b").alias("ord")).distinct(), ["site", "ord"], "left_anti").select("site", "ord")
        drop = edges.join(keep.withColumnRenamed("ord", "a"), ["site", "a"], "left_semi").select("site", F.col("b").alias("ord")).distinct()
        step = written(keep.withColumn("kept", F.lit(True)).unionByName(drop.withColumn("kept", F.lit(False))), "settled")
        if step.isEmpty():
            discard(step)
            return out
        out.append(step)
        gone = lambda c: step.select("site", F.col("ord").alias(c))
        edges = written(edges.join(gone("a"), ["site", "a"], "left_anti").join(gone("b"), ["site", "b"], "left_anti"), "edges")
        if edges.isEmpty() and step.where("not kept").isEmpty():
            return out
        open_ = open_.join(gone("ord"), ["site", "ord"], "left_anti")


def greedy(pages: DataFrame, text: str = "text", threshold: float = X.THRESHOLD, kept_before: DataFrame | None = None) -> DataFrame:
    """(site, ord, kept, reason) for each page; reason is exact_duplicate, near_duplicate or null. kept_before(site, ord, digest, signature) are pages kept by an earlier run: they come first and are not returned."""
    firsts = written(exact(pages, text), "firsts")
    body = pages.select("site", "ord", F.coalesce(F.col(text), F.lit("")).alias("body"))
    nodes = spread(firsts.where("kept").join(body, ["site", "ord"])).select("site", "ord", "digest", X.minhash(F.col("body")).alias("signature"))
    if kept_before is not None:
        old = kept_before.select("site", (F.col("ord") - F.lit(1 << 60)).alias("ord"), "digest", "signature")
        known = old.select("site", "digest").distinct().withColumn("known", F.lit(True))
        nodes = nodes.join(known, ["site", "digest"], "left_anti").unionByName(old)
    nodes = written(nodes, "signatures")
    # of equal signatures the first one counts
    heads = written(nodes.groupBy("site", "signature").agg(F.min("ord").alias("ord")), "heads")
    rows = heads.select("site", "ord", F.explode(F.array_distinct(keys(F.col("signature"), threshold))).alias("key"))
    crowded = rows.groupBy("site", "key").count().where("count > 1").select("site", "key")
    members = written(rows.join(crowded, ["site", "key"]), "members")
    signature = heads.select("site", "ord", "signature")
    decided = heads.select("site", "ord").join(members.select("site", "ord").distinct(), ["site", "ord"], "left_anti").withColumn("kept", F.lit(True))
    leads = LEADS
    while not members.isEmpty():
        here = Window.partitionBy("site", "key")
        ranked = members.withColumns({"rank": F.row_number().over(here.orderBy("ord")), "size": F.count("*").over(here)})
        ranked = written(ranked.withColumn("leads", F.when(F.col("size") <= SMALL_BAND, SMALL_BAND).otherwise(leads)), "ranked")
        blocks = F.floor((F.col("size") - 1) / CELL).cast("int")
        place = F.xxhash64("site", "key", F.col("block"))
        beside = ranked.where("size > 1").withColumn("block", F.floor((F.col("rank") - 1) / CELL).cast("int")).select("site", "ord", F.lit(False).alias("lead"), place.alias("cell"))
        ahead = ranked.where("size > 1 and rank <= leads").withColumn("block", F.explode(F.sequence(F.floor((F.col("rank") - 1) / CELL).cast("int"), blocks))).select("site", "ord", F.lit(True).alias("lead"), place.alias("cell"))
        cells = beside.unionByName(ahead).join(signature, ["site", "ord"]).repartition("cell").sortWithinPartitions("cell", "ord")
        edges = written(cells.select("site", "ord", "lead", "cell", "signature").mapInArrow(_matches(slots_needed(threshold)), "site string, a long, b long").distinct(), "edges")
        open_ = ranked.groupBy("site", "ord").agg((F.max(F.col("rank") - F.col("leads")) <= 0).alias("covered"))
        for step in _settle(open_, edges):
            decided = decided.unionByName(step)
            members = members.join(step.select("site", "ord"), ["site", "ord"], "left_anti")
        members = written(members, "members")
        discard(ranked, edges)
        leads *= GROWTH
    decided = nodes.select("site", "ord").join(heads.select("site", "ord"), ["site", "ord"], "left_anti").withColumn("kept", F.lit(False)).unionByName(decided)
    fate = firsts.join(decided.select("site", F.col("ord").alias("first_ord"), F.col("kept").alias("first_kept")), ["site", "first_ord"], "left")
    # a first text that an earlier run kept is an exact duplicate itself
    known_text = F.col("first_kept").isNull()
    reason = F.when(known_text, "exact_duplicate").when(F.col("kept") & F.col("first_kept"), None).when(F.col("first_kept"), "exact_duplicate").otherwise("near_duplicate")
    return fate.select("site", "ord", reason.alias("reason")).select("site", "ord", F.col("reason").isNull().alias("kept"), "reason")
