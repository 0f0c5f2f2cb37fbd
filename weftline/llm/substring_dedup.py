"""Removal of repeated passages: every word that a window of `width` words covers goes if the window's words also start elsewhere.

Windows are dealt to shards by content, so that equal windows meet: the smallest hash among the `seed`-word sequences of a
window names its shard (a minimizer). Consecutive windows of one shard form a segment. Only segments whose minimizer occurs
twice or more in the corpus go on, each distinct one once, with its number of copies as weight. Each shard holds an FM-index
of its segments: their words' Burrows-Wheeler transform in a wavelet matrix. The segments are streamed against it, backward
search yields matching statistics cut off at `width`, and the words from the first to the last window that reaches `width`
with a count of two or more are reported (a segment has fewer windows than `width`, so these overlap).

No step holds a group whole: counts aggregate before they are shuffled; copies of a segment are one row with a weight; the
segments of a minimizer with more than HOT distinct segments are dealt again window by window, by the whole window's hash.
Steps end in written tables.

Defined results: null and empty texts have no words and lose none; texts shorter than a window lose nothing; equal rows
count as copies of each other; very long texts are read whole; an empty table gives an empty table. Extra columns are
carried in a struct, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, gram_hashes, mix, parallelism, powers, slabs, sliding_min, span_hashes, spans, stash, text_buffers, tidy
from .fm_index import FMIndex, repeated_spans

WIDTH, SEED = 35, 8
#: Windows in a segment; distinct segments of one minimizer from which its windows are dealt one by one; words in an index.
LONGEST, HOT, INDEX_WORDS = 32, 512, 1 << 19
_ODD = 0xD1342543DE82EF95
_BACK = np.uint64(pow(_ODD, -1, 1 << 64))


class Segments:
    """Segments of a slab of texts: minimizer, content hash, text, first word in the slab, windows."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, width: int, seed: int):
        self.starts, self.ends, self.first = spans(buf, offsets)
        self.words = span_hashes(buf, self.starts, self.ends)
        n = len(self.words)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        grams = gram_hashes(self.words, seed)
        least = sliding_min(grams, width - seed + 1) if n >= width else np.zeros(0, np.uint64)
        at = np.arange(len(least))
        whole = at + width <= np.repeat(self.first[1:], np.diff(self.first))[: len(least)]
        fresh = whole.copy()
        if len(least):
            fresh[1:] &= ~(whole[:-1] & (least[1:] == least[:-1]) & (self.text[1 : len(least)] == self.text[: len(least) - 1]))
        run = np.flatnonzero(fresh)
        back = np.zeros(len(least), np.int64)
        if len(run):
            back[run[0] :] = at[run[0] :] - np.repeat(run, np.diff(run, append=len(least)))
        self.start = np.flatnonzero(whole & (back % LONGEST == 0))
        ends = np.flatnonzero(whole & np.append(~whole[1:] | (back[1:] % LONGEST == 0), True)[: len(whole)])
        self.windows = ends - self.start + 1
        self.minimizer = least[self.start]
        # a minimizer found twice in one segment: its windows may equal each other
        length = self.windows + width - seed
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length - self.start, length)
        equal = grams[inside] == np.repeat(self.minimizer, length)
        self.times = np.minimum(np.add.reduceat(equal, np.cumsum(length) - length, dtype=np.int32), 2) if len(length) else np.zeros(0, np.int32)
        powered = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * powers(n, np.uint64(_ODD)))])
        self.sums, self.back = powered, powers(n + 1, _BACK)
        self.content = self.hash(self.start, self.windows + width - 1)
        self.owner = self.text[self.start] if n else self.start

    def hash(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of `length` words from word `at` on."""
        return mix((self.sums[at + length] - self.sums[at]) * self.back[at] + np.asarray(length).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


def _runs(width: int, seed: int):
    schema = [("minimizer", pa.int64()), ("content", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("times", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            buf, offsets = text_buffers(batch.column("text"))
            for a, b in slabs(offsets):
                s = Segments(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, seed)
                yield _batch(schema, [_signed(s.minimizer), _signed(s.content), rows[a:b][s.owner], (s.start - s.first[s.owner]).astype(np.int32), s.times])

    return tidy(run)


def _pieces(width: int, seed: int):
    schema = [("shard", pa.int64()), ("piece", pa.int64()), ("minimizer", pa.int64()), ("content", pa.int64()), ("shift", pa.int32()), ("copies", pa.int64()), ("hot", pa.bool_()), ("words", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal rows come to one task; one of them brings the words
        for batch in batches:
            rows = batch.column("row").to_pylist()
            batch = batch.filter(pa.array([r not in seen and not seen.add(r) for r in rows], pa.bool_()))
            buf, offsets = text_buffers(batch.column("text"))
            wanted = batch.column("wanted")
            begin = wanted.offsets.to_numpy()
            inner = wanted.values
            content, copies, hot = (inner.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            for a, b in slabs(offsets):
                part = buf[offsets[a] : offsets[b]]
                s = Segments(part, offsets[a : b + 1] - offsets[a], width, seed)
                ask = slice(begin[a], begin[b])
                key = lambda c, t: mix(c.view(np.uint64) + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                asked = key(content[ask], np.repeat(np.arange(b - a), np.diff(begin[a : b + 1])))
                have, where = np.unique(key(s.content, s.owner), return_index=True)
                if not len(have) or not len(asked):
                    continue
                at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
                good = have[at] == asked
                seg, n, h = where[at[good]], copies[ask][good], hot[ask][good].astype(bool)
                count = np.where(h, s.windows[seg], 1)
                pick = np.repeat(np.arange(len(seg)), count)
                shift = np.arange(len(pick)) - np.repeat(np.cumsum(count) - count, count)
                seg, n, h = seg[pick], n[pick], h[pick]
                start = s.start[seg] + shift
                length = np.where(h, width, s.windows[seg] + width - 1)
                whole = s.hash(start, length)
                raw, lo, hi = part.tobytes(), s.starts[start], s.ends[start + length - 1]
                words = [raw[i:j] for i, j in zip(lo.tolist(), hi.tolist())]
                yield _batch(schema, [_signed(np.where(h, whole, s.minimizer[seg])), _signed(whole), _signed(s.minimizer[seg]), _signed(s.content[seg]), shift.astype(np.int32), n, h, pa.array(words, pa.binary())])

    return tidy(run)


def _search(width: int):
    schema = [("shard", pa.int64()), ("piece", pa.int64()), ("hot", pa.bool_()), ("low", pa.int32()), ("high", pa.int32())]

    def spans_of(rows: pa.Table) -> pa.RecordBatch:
        buf, offsets = text_buffers(rows.column("words"))
        starts, ends, first = spans(buf, offsets)
        symbols = np.unique(span_hashes(buf, starts, ends), return_inverse=True)[1] + 1
        length = np.diff(first)
        begin = first[:-1] + np.arange(len(length))
        sequence = np.zeros(len(symbols) + len(length), np.int64)
        text = np.repeat(np.arange(len(length)), length)
        sequence[np.arange(len(symbols)) + text] = symbols
        copies = rows.column("copies").to_numpy()
        index = FMIndex(sequence, int(symbols.max()) + 1, np.repeat(copies, length + 1), width)
        low, high = repeated_spans(index, sequence, begin, length - width + 1, width)
        hit = np.flatnonzero(low >= 0)
        take = lambda c: rows.column(c).to_numpy()[hit]
        return _batch(schema, [take("shard"), take("piece"), take("hot"), low[hit].astype(np.int32), (high[hit] + width).astype(np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            lengths = np.cumsum(np.concatenate([[0], np.diff(text_buffers(batch.column("words"))[1])])) // 6
            at = 0
            for c in cuts[:-1]:
                if c < len(shard) and shard[c] != last and size + lengths[c] - lengths[at] >= INDEX_WORDS:
                    held.append(batch.slice(at, c - at))
                    yield spans_of(pa.Table.from_batches(held))
                    held, size, at = [], 0, c
                last = shard[c] if c < len(shard) else last
            held.append(batch.slice(at))
            size += int(lengths[-1] - lengths[at])
        if sum(map(len, held)):
            yield spans_of(pa.Table.from_batches(held))

    return tidy(run)


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, texts = [], [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone").to_pylist()):
                words = (text.as_py() or "").encode().split()
                left, at = [], 0
                for span in sorted((g["low"], g["high"]) for g in gone or ()):
                    left += words[at : max(at, span[0])]
                    at = max(at, span[1])
                left = left + words[at:] if at else words
                out = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(out).hexdigest())
                texts.append(out.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())], names=["own", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return tidy(run)


def dedupe(docs: DataFrame, text: str = "text", carry: list[str] | None = None, with_text: bool = True, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row per row of docs: `own` (struct of the carried columns, all by default), n_words, n_removed, kept_sha256, kept_text."""
    carry = docs.columns if carry is None else carry
    spark = docs.sparkSession
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in dict.fromkeys([*carry, text])])
    rows = docs.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    runs = stash(rows.mapInArrow(_runs(width, seed), "minimizer long, content long, row long, start int, times int"), "segments")
    distinct = runs.groupBy("minimizer", "content").agg(F.count("*").alias("copies"), F.sum("times").alias("times"), F.min("row").alias("row"))
    repeated = distinct.groupBy("minimizer").agg(F.sum("times").alias("all"), (F.count("*") > HOT).alias("hot")).where("all >= 2").drop("all")
    wanted = distinct.join(repeated, "minimizer").groupBy("row").agg(F.collect_list(F.struct("content", "copies", "hot")).alias("wanted"))
    pieces = rows.join(wanted, "row").mapInArrow(_pieces(width, seed), "shard long, piece long, minimizer long, content long, shift int, copies long, hot boolean, words binary")
    pieces = stash(pieces, "pieces")
    hot = pieces.where("hot")
    units = pieces.where("not hot").select("shard", "piece", "copies", "hot", "words").unionByName(hot.groupBy("shard", "piece").agg(F.sum("copies").alias("copies"), F.first("words").alias("words")).select("shard", "piece", "copies", F.lit(True).alias("hot"), "words"))
    found = units.repartition(parallelism(spark), "shard").sortWithinPartitions("shard", "piece").mapInArrow(_search(width), "shard long, piece long, hot boolean, low int, high int")
    found = stash(found, "repeats")
    cold = found.where("not hot").select(F.col("shard").alias("minimizer"), F.col("piece").alias("content"), "low", "high")
    warm = hot.select("shard", "piece", "minimizer", "content", "shift").join(found.where("hot").drop("hot"), ["shard", "piece"])
    warm = warm.select("minimizer", "content", (F.col("shift") + F.col("low")).alias("low"), (F.col("shift") + F.col("high")).alias("high"))
    at = runs.join(cold.unionByName(warm), ["minimizer", "content"])
    gone = at.groupBy("row").agg(F.collect_set(F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))).alias("gone"))
    gone = stash(gone, "gone")
    discard(runs, pieces, found)
    own = docs.select(row.alias("row"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("own"), F.col(f"`{text}`").cast("string").alias("text"))
    last = own.join(gone, "row", "left").select("own", "text", "gone")
    schema = T.StructType([own.schema["own"], *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, kept_text string")])
    return last.mapInArrow(_kept(with_text), schema)
