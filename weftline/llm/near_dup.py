"""Near-duplicates: ProbMinHash signatures of weighted word shingles, banding, exact verification, connected classes.

A text is the weighted set of its `WORDS`-word shingles, weighted by one plus the logarithm of how often each occurs (a
text with fewer words is one shingle). Every shingle is a Poisson process: its arrivals, exponential steps divided by its weight, hit random signature
slots, and a slot keeps the shingle that came first. A text's processes stop as soon as they pass its latest slot, so long
texts take little more than one arrival a shingle. Two signatures agree in a slot with the probability Jaccard similarity.

Signatures are cut into bands; texts with an equal band are candidates. Links are defined by the shingle sets, so a text with
repeated shingles also has the bands of its signature with unit weights. A bucket is never spread out into all its pairs:
its members are compared with a hub, the member that meets the most others over all bands (each text with the best of its
buckets' hubs). What is left is decided class by class: all texts outside a bucket's main class are laid beside that class,
once for all buckets, and counted against it and each other, in cells of bounded size.
So every candidate pair between classes is decided, no link is missed for the size of its bucket, and only links come out.
A candidate is a link if the shingle sets' Jaccard similarity, counted exactly, is `SIMILARITY` or more; classes are the
connected components of the links. So a link can be missed only if its texts share no band. Their signatures with
unit weights agree in a slot with the probability of that similarity, so for 0.8 this has a probability of 3e-6, however
often shingles repeat.

Equal texts are one node from the start. Steps end in written tables; labels spread with pointer jumping.

Defined results: a null text is an empty one; texts without words are copies only of equal texts; the class id is the least
id of its members (an id that is null or no integer counts as a hash of the text); equal rows share their class; an empty table gives an empty
table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gram_hashes, mix, parallelism, slabs, span_hashes, spans, stash, text_buffers, tidy

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Texts of a class, and outsiders, that are compared in one cell, about.
CELL = 1024
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, text, count."""
    starts, ends, first = spans(buf, offsets)
    words, n = span_hashes(buf, starts, ends), np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    gram, at = gram_hashes(words, k), np.arange(max(0, len(words) - k + 1))
    whole = at + k <= first[1:][text[: len(at)]]
    gram, text = gram[whole], text[: len(at)][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        small = np.array([gram_hashes(words[first[t] : first[t + 1]], int(n[t]))[0] + np.uint64(n[t]) for t in short], np.uint64)
        gram, text = np.concatenate([gram, small]), np.concatenate([text, short])
    own = mix(gram + text.astype(np.uint64) * _STEP)
    _, index, count = np.unique(own, return_index=True, return_counts=True)
    return gram[index], text[index], count


def signatures(gram: np.ndarray, text: np.ndarray, count: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """texts x slots of 32-bit shingle hashes (0 for texts without shingles)."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    kept = np.full(texts * slots, none, np.uint64)
    latest = np.full(texts, np.inf)
    time, step, rate = np.zeros(len(gram)), 0, 1.0 / (1.0 + np.log(count))
    while len(gram):
        block = max(1, min(32, 20_000 // len(gram)))
        for s in range(step + 1, step + block + 1):
            draw = mix(gram + np.uint64(s * int(_STEP) % 2**64))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
            slot = (mix(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(33)).astype(np.int64) % slots
            value = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (gram >> np.uint64(32))
            np.minimum.at(kept, text * slots + slot, value)
        step += block
        worst = kept.reshape(texts, slots).max(1)
        latest = np.where(worst == none, np.inf, (worst >> np.uint64(32)).astype(np.uint32).view(np.float32).astype(np.float64))
        live = time < latest[text]
        gram, text, time, rate = gram[live], text[live], time[live], rate[live]
    out = (kept & np.uint64(0xFFFFFFFF)).reshape(texts, slots)
    out[kept.reshape(texts, slots).max(1) == none] = 0
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + signature.reshape(len(signature), bands, rows)[:, :, r] + np.uint64(1))
    return mix(out + (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * _STEP)


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffers(batch.column("text"))
            for a, b in slabs(offsets):
                gram, text, count = shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                signature = signatures(gram, text, count, b - a, bands * rows)
                hashes = np.repeat(band_hashes(signature, bands, rows)[:, None], 2, 1)
                # where no shingle repeats, the signature with unit weights is the same
                again = np.bincount(text, count > 1, minlength=b - a) > 0
                own, number = again[text], np.cumsum(again) - 1
                unit = signatures(gram[own], number[text[own]], np.ones(int(own.sum()), np.int64), int(again.sum()), bands * rows)
                hashes[again, 1] = band_hashes(unit, bands, rows)
                filled = np.bincount(text, minlength=b - a) > 0
                listed = np.stack([np.repeat(filled[:, None], bands, 1), hashes[:, 0] != hashes[:, 1]], 1)
                part = batch.slice(a, b - a)
                begin = np.concatenate([[0], np.cumsum(listed.sum((1, 2)))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(begin), pa.array(hashes[listed].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h1"), part.column("h2"), listed], names=["id", "h1", "h2", "bands"])

    return tidy(run)


def _verify(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.concatenate([[0], np.diff(text_buffers(batch.column("ta"))[1]) + np.diff(text_buffers(batch.column("tb"))[1])]))
            for a, b in slabs(size):
                part = batch.slice(a, b - a)
                sets = [shingles(*text_buffers(part.column(c)), k) for c in ("ta", "tb")]
                own = [mix(g + t.astype(np.uint64) * _STEP) for g, t, _ in sets]
                n = [np.bincount(t, minlength=b - a) for _, t, _ in sets]
                both = np.bincount(sets[0][1][np.isin(own[0], own[1])], minlength=b - a)
                yield part.filter(pa.array((both > 0) & (both >= least * (n[0] + n[1] - both)))).select(["a", "b"])

    return tidy(run)


def _across(k: int, least: float):
    """Links (a, b) in rows sorted by cell: each text of the side 1 against all texts of the cell that have another label."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        buf, offsets = text_buffers(rows.column("text"))
        grams, owner = [], []
        for a, b in slabs(offsets):
            gram, text, _ = shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
            grams.append(gram)
            owner.append(text + a)
        ids, owner = np.unique(np.concatenate(grams), return_inverse=True)[1], np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        size = np.bincount(owner, minlength=len(rows))
        begin = np.concatenate([[0], np.cumsum(size)])
        label, node, side = (rows.column(c).to_numpy() for c in ("label", "node", "side"))
        met, found = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool), []
        for x in np.flatnonzero(side == 1):
            own = ids[begin[x] : begin[x + 1]]
            met[own] = True
            both = np.bincount(owner[met[ids]], minlength=len(rows))
            met[own] = False
            good = (both > 0) & (label != label[x]) & (both >= least * (size + size[x] - both))
            found += [(int(node[x]), int(n)) for n in node[good]]
        ends = list(zip(*found)) if found else [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and held and held[-1].column("cell")[0].as_py() != cell[a]:
                    yield links(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield links(pa.Table.from_batches(held))

    return tidy(run)


def _cells(dealt: DataFrame, most: int) -> DataFrame:
    """dealt(key, node, label) as (cell, node, label, side): a key's outsiders (label other than the key; side 1) meet its insiders and each other. Large keys are cut into blocks of about `most` rows by a hash of the node."""
    rows = dealt.withColumn("out", F.col("label") != F.col("key"))
    blocks = lambda side: F.greatest(F.lit(1), F.ceil(F.count_if(side) / most)).cast("int")
    plan = rows.groupBy("key").agg(blocks(~F.col("out")).alias("ins"), blocks(F.col("out")).alias("outs"))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    i = own(F.col("outs"))
    with_insiders = F.transform(upto(F.col("ins")), lambda j: F.struct(F.xxhash64("key", F.lit(0), i, j).alias("cell"), F.lit(1).alias("side")))
    with_outsiders = F.transform(upto(F.col("outs")), lambda j: F.struct(F.xxhash64("key", F.lit(1), F.least(i, j), F.greatest(i, j)).alias("cell"), F.lit(1).alias("side")))
    inside = F.transform(upto(F.col("outs")), lambda j: F.struct(F.xxhash64("key", F.lit(0), j, own(F.col("ins"))).alias("cell"), F.lit(0).alias("side")))
    several = F.when(F.col("outs") > 1, F.concat(with_insiders, with_outsiders)).otherwise(with_insiders)
    placed = rows.join(plan, "key").select("node", "label", F.explode(F.when(F.col("out"), several).otherwise(inside)).alias("c"))
    return placed.select("c.cell", "node", "label", "c.side")


#: Rows of a small table in one task.
ROWS_IN_TASK = 50_000


def snug(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows, in as few tasks as they need: an iteration over a small table is not dealt out as widely as the corpus."""
    return df.coalesce(max(1, rows // ROWS_IN_TASK))


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) for the nodes of links (a, b): the least node that each is connected with."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    edges = stash(ends, f"{name}-edges")
    n = edges.count()
    table = labels = stash(snug(edges.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), n), name)
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("m"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = stash(snug(least.join(jump, "via").select("node", "old", F.least("via", "far").alias("label")), n), name)
        discard(table)
        table, labels = step, step.select("node", "label")
        if step.where("old != label").isEmpty():
            discard(edges)
            return labels


def _labelled(docs: DataFrame, id: str, text: str, k: int, least: float, bands: int, rows: int) -> DataFrame:
    """(own_id, h1, h2, class_id) for each row of docs; h1 and h2 are hashes of its text."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{id}`").alias("own_id"), body.alias("text")).select("own_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    own = own.select("own_id", F.coalesce(F.col("own_id").try_cast("long"), "h2").alias("id"), "h1", "h2", "text")
    sketch = stash(own.select("id", "h1", "h2", "text").mapInArrow(_sketch(k, bands, rows), "id long, h1 long, h2 long, bands array<long>"), "sketches")
    nodes = stash(sketch.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.first("bands").alias("bands")), "nodes")
    discard(sketch)
    cut = nodes.select("node", F.explode("bands").alias("band"))
    met = cut.join(cut.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band")
    buckets = stash(met, "buckets")
    n_members = buckets.count()
    members = stash(snug(buckets.join(buckets.groupBy("node").agg(F.sum("n").alias("score")), "node").select("band", "node", "score"), n_members), "members")
    discard(buckets)
    involved = nodes.select("node", "h1", "h2").join(members.select("node").distinct(), "node")
    texts = own.join(involved, ["h1", "h2"]).where("id = node").select("node", "text").dropDuplicates(["node"])
    texts = stash(texts, "texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return stash(both.select("a", "b", "ta", "tb").mapInArrow(_verify(k, least), "a long, b long"), name)

    hub = members.groupBy("band").agg(F.max(F.struct("score", "node")).alias("h")).select("band", F.col("h.node").alias("b"), F.col("h.score").alias("hub_score"))
    met = members.join(hub, "band").where("node != b")
    # each text is compared with the best of its buckets' hubs; a text linked to a hub takes its label from there
    pairs = met.groupBy(F.col("node").alias("a")).agg(F.max_by("b", F.struct("hub_score", "b")).alias("b"))
    links = verified(pairs, "links")
    above = links.select(F.col("a").alias("b"), F.col("b").alias("top"))
    labels = stash(snug(links.join(above, "b", "left").select(F.col("a").alias("node"), F.coalesce("top", "b").alias("label")), n_members), "hub-labels")
    # a hub under another one is labelled like its texts
    now = members.join(labels, "node", "left").select("band", "node", "score", F.coalesce("label", "node").alias("label"))
    split = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("label", F.struct("score", "node")).alias("key")).where("low != high").select("band", "key")
    dealt = stash(snug(now.join(split, "band").select("key", "node", "label").distinct(), n_members), "split")
    cells = _cells(dealt, CELL).join(texts, "node").repartition(parallelism(docs.sparkSession), "cell").sortWithinPartitions("cell", "node")
    found = stash(cells.select("cell", "node", "label", "side", "text").mapInArrow(_across(k, least), "a long, b long"), "links")
    joined = components(links.unionByName(found))
    discard(members, texts, labels, dealt, links, found)
    labels = joined
    known = nodes.select("h1", "h2", "node").join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("class_id"))
    return own.select("own_id", "h1", "h2").join(known, ["h1", "h2"])


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id) for each row of docs."""
    return _labelled(docs, id, text, k, least, bands, rows).select(F.col("own_id").alias(id), "class_id")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of docs for each class: the one with the least id, a row without id only where none has one."""
    rows = _labelled(docs.select(id, text), id, text, WORDS, SIMILARITY, BANDS, ROWS)
    copies = rows.groupBy("class_id", "own_id", "h1", "h2").agg(F.count("*").alias("copies"))
    first = copies.groupBy("class_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", "h1", "h2", "copies")).alias("m"))
    kept = stash(first.select(*[F.col(f"m.{c}").alias(f"_n_{c}") for c in ("own_id", "h1", "h2", "copies")]), "kept")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    met = (F.xxhash64(body) == F.col("_n_h1")) & (F.xxhash64(F.lit(1), body) == F.col("_n_h2")) & F.col(f"`{id}`").eqNullSafe(F.col("_n_own_id"))
    single = docs.join(kept.where("_n_copies = 1"), met, "left_semi")
    # rows with equal id and text, which may differ elsewhere
    again = docs.join(kept.where("_n_copies > 1"), met).groupBy("_n_own_id", "_n_h1", "_n_h2").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("m"))
    return single.unionByName(again.select("m.*"))
