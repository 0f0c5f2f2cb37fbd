"""Benchmark decontamination by spaced seeds.

A mask of `SPAN` token positions keeps some and ignores the others, so two passages with a substituted token still agree
under a mask that skips it. Every masked position of the benchmark is hashed, every masked position of the corpus likewise;
equal hashes are hits. On the diagonal of each hit the two whole texts are laid side by side without gaps and the stretch that scores best
(+1 for an equal token, -MISMATCH for a substituted one) is taken; it is a leak if it has LEAST equal tokens or more, or
covers a shorter item entirely, and the share of equal tokens in it is SHARE or more.

Tokens are runs of ASCII letters and digits and of bytes above 127 in the lower-cased text; all else separates.

The corpus side passes a bit table of the benchmark's hashes first; its size is a parameter, whatever the benchmark's size,
and it only saves rows: what passes by chance fails in the join. Hits of one text and item on one diagonal are one candidate.
Texts with candidates are read a second time, and each candidate's window, as long as the item, is compared with the item.

Items of under LEAST tokens are leaks only where they stand whole and unchanged. Those that no mask fits into (under 7
tokens) are sought by one more mask for each such length, which keeps all positions.

Defined results: items of under SHORTEST tokens give no rows, since one or two words prove no leak; null and empty texts and
items have no tokens and give no rows; copies give a row each, equal rows one; ties in the best stretch go to the first, ties
of equal stretches to the one that starts first; very long texts are read whole; ids may be of any type that sorts, and null;
an empty table on either side gives an empty table. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, mix, powers, slabs, span_hashes, spans, stash, text_buffers, tidy

#: Masks over SPAN positions (1: the token counts). Each has weight 7.
MASKS = ("11101001011", "11010110101", "10111010101", "11111110000")
LEAST, SHARE, MISMATCH = 12, 0.75, 2
#: Items of fewer tokens are no passages.
SHORTEST = 3

SEPARATES = np.ones(256, bool)
SEPARATES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a batch of texts and, for each text (n + 1), the number of tokens before it."""
    buf, offsets = text_buffers(pc.utf8_lower(column))
    hashes, first, done = [], [np.zeros(1, np.int64)], 0
    for a, b in slabs(offsets):
        part = buf[offsets[a] : offsets[b]]
        starts, ends, count = spans(part, offsets[a : b + 1] - offsets[a], SEPARATES)
        hashes.append(span_hashes(part, starts, ends))
        first.append(count[1:] + done)
        done += len(starts)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(first)


def masked(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash under the mask at each position."""
    n = len(words)
    words = np.concatenate([words, np.zeros(len(mask), np.uint64)])
    out, power = np.full(n, number, np.uint64), powers(len(mask) + 1, np.uint64(0xA0761D6478BD642F))
    for i, bit in enumerate(mask):
        if bit == "1":
            out += words[i : i + n] * power[i + 1]
    return mix(out)


def _seeds(masks: tuple[str, ...], whole: list[int], table: np.ndarray | None):
    """Rows of (seed, row, at) for each masked position that the table lets pass; `whole`: lengths of items that are sought whole. Without a table the rows are items: those lengths hold for items of this length only."""
    lengths = {len(mask): mask for mask in ("1" * n for n in whole)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = tokens(batch.column("text"))
            rows, n = batch.column("row").to_numpy(zero_copy_only=False), np.diff(first)
            text, found = np.repeat(np.arange(len(n)), n), []
            for number, mask in [*enumerate(masks), *((len(masks) + n, mask) for n, mask in lengths.items())]:
                seed = masked(words, mask, number)
                good = np.arange(len(seed)) + len(mask.rstrip("0")) <= first[1:][text]
                if table is not None:
                    good &= probe(table, seed)
                elif number >= len(masks):
                    good &= n[text] == len(mask)
                at = np.flatnonzero(good)
                found.append((seed[at], at))
            seed, at = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            owner = text[at].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(rows[owner], pa.int64()), pa.array(at - first[:-1][owner], pa.int64())], names=["seed", "row", "at"])

    return tidy(run)


_SEEDS = "seed long, row long, at long"
#: A seed sets two bits of the table: one by its upper bits, one by its lower.
MOST_BITS = 26


def probe(table: np.ndarray, seed: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(table) * 8 - 1)
    out = np.ones(len(seed), bool)
    for slot in (seed & bits, (seed >> np.uint64(32)) & bits):
        out &= (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def bit_table(seeds: DataFrame) -> np.ndarray:
    """Bit table of the column seed, of at most 2**MOST_BITS bits, built where the seeds are and sent as its bytes that are not 0."""
    n = seeds.count()
    bits = 1 << min(MOST_BITS, max(16, (64 * n).bit_length()))
    slots = F.explode(F.array(F.col("seed").bitwiseAND(bits - 1), F.shiftrightunsigned("seed", 32).bitwiseAND(bits - 1)))
    byte = seeds.select(slots.alias("slot")).groupBy(F.shiftright("slot", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot & 7 as int))")).alias("set"))
    table = np.zeros(bits // 8, np.uint8)
    for r in byte.toLocalIterator():
        table[r["byte"]] = r["set"]
    return table


def best_stretch(equal: np.ndarray, mismatch: int) -> tuple[int, int]:
    """First and past-last position of the stretch that scores best."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -mismatch))])
    low = np.minimum.accumulate(total)
    stop = int(np.argmax(total[1:] - low[:-1])) + 1
    return int(np.argmin(total[:stop])), stop


#: Bytes of windows that are held at once, about.
WINDOWS = 8 << 20


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, words, n): the tokens of each item."""
    for batch in batches:
        words, first = tokens(batch.column("text"))
        raw = words.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([raw[8 * i : 8 * j] for i, j in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary()), pa.array(np.diff(first), pa.int64())], names=["row", "words", "n"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (item_row, item_n, diagonal) met by a text: the tokens of the text beside the item."""

    def laid(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        at, item_row, diagonal, near = zip(*out)
        columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("row", "id")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(item_row, pa.int64()), pa.array(diagonal, pa.int64()), pa.array(near, pa.binary())], names=["row", "id", "item_row", "diagonal", "near"])

    for batch in batches:
        out, held = [], 0
        for t in range(len(batch)):
            words, _ = tokens(batch.column("text").slice(t, 1))
            for m in batch.column("met")[t]:
                m = m.as_py()
                near = words[max(0, m["diagonal"]) : max(0, m["diagonal"] + m["item_n"])].tobytes()
                out.append((t, m["item_row"], m["diagonal"], near))
                held += len(near)
                if held > WINDOWS:
                    yield laid(batch, out)
                    out, held = [], 0
        if out:
            yield laid(batch, out)


def _verify(least: int, share: float, mismatch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (diagonal, near, words) in enumerate(zip(batch.column("diagonal").to_pylist(), batch.column("near"), batch.column("words"))):
                doc, item = np.frombuffer(near.as_py(), np.uint64), np.frombuffer(words.as_py(), np.uint64)
                j = max(0, -diagonal)
                equal = doc == item[j : j + len(doc)]
                lo, hi = best_stretch(equal, mismatch)
                same = int(equal[lo:hi].sum())
                if same >= min(least, len(item)) and same >= share * (hi - lo):
                    out.append((k, max(0, diagonal) + lo, hi - lo, same))
            at, *found = zip(*out) if out else [()] * 4
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("row", "id", "item_row")]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.int64()) for c in found]], names=["row", "id", "item_row", "start", "length", "same"])

    return tidy(run)


def row_key(id: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{id}`").cast("string"), F.col(f"`{text}`").cast("string"))


def _found(docs: DataFrame, benchmark: DataFrame, id: str, text: str, item_id: str, item_text: str, masks: tuple[str, ...], least: int, share: float, shortest: int) -> DataFrame:
    """(row, id, item_row, start, length, same) for each diagonal on which a text and an item have a leak; row and item_row are row_keys."""

    def side(df: DataFrame, key: str, body: str) -> DataFrame:
        return df.select(row_key(key, body).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{body}`").cast("string").alias("text"))

    items, texts = side(benchmark, item_id, item_text), side(docs, id, text)
    words = items.dropDuplicates(["row"]).select("row", "text").mapInArrow(tidy(_words), "row long, words binary, n long")
    words = stash(words.where(F.col("n") >= shortest), "items")
    fits = min(len(mask.rstrip("0")) for mask in masks)
    whole = sorted(r["n"] for r in words.where(F.col("n") < fits).select("n").distinct().collect())
    test = stash(items.select("row", "text").join(words.select("row"), "row", "left_semi").mapInArrow(_seeds(masks, whole, None), _SEEDS), "test-seeds")
    corpus = stash(texts.select("row", "text").mapInArrow(_seeds(masks, whole, bit_table(test.select("seed"))), _SEEDS), "corpus-seeds")
    item_hits = test.select("seed", F.col("row").alias("item_row"), F.col("at").alias("item_at"))
    met = corpus.join(item_hits, "seed").select("row", "item_row", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    met = met.join(words.select(F.col("row").alias("item_row"), F.col("n").alias("item_n")), "item_row")
    met = stash(met.groupBy("row").agg(F.collect_list(F.struct("item_row", "item_n", "diagonal")).alias("met")), "met")
    discard(test, corpus)
    key = T.StructField("id", docs.schema[id].dataType)
    near = texts.join(met, "row").mapInArrow(tidy(_windows), T.StructType([T.StructField("row", T.LongType()), key, *T.StructType.fromDDL("item_row long, diagonal long, near binary")]))
    laid = near.join(words.select(F.col("row").alias("item_row"), "words"), "item_row")
    found = T.StructType([T.StructField("row", T.LongType()), key, *T.StructType.fromDDL("item_row long, start long, length long, same long")])
    return laid.select("row", "id", "item_row", "diagonal", "near", "words").mapInArrow(_verify(least, share, MISMATCH), found)


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, least: int = LEAST, share: float = SHARE, shortest: int = SHORTEST) -> DataFrame:
    """One row per document and benchmark item that leaked into it: id, item_id, start, length (tokens of the longest stretch), same (equal tokens there)."""
    found = _found(docs, benchmark, id, text, item_id, item_text, masks, least, share, shortest)
    items = benchmark.select(row_key(item_id, item_text).alias("item_row"), F.col(f"`{item_id}`").alias("item_id")).distinct()
    best = found.join(items, "item_row").groupBy("id", "item_id").agg(F.max(F.struct("same", (-F.col("start")).alias("back"), "length")).alias("m"))
    return best.select(F.col("id").alias(id), "item_id", (-F.col("m.back")).alias("start"), F.col("m.length").alias("length"), F.col("m.same").alias("same"))


def leaking_rows(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row_key of each text that a benchmark item leaked into: rows without id, or with one id, are told apart."""
    return _found(docs, benchmark, id, text, "item_id", "text", MASKS, LEAST, SHARE, SHORTEST).select("row").distinct()
