"""Packing by best-fit decreasing.

A document's ids are cut into full windows first; each is a sequence of its own. What remains of every document is packed
longest first: a segment tree over remaining capacities finds the open window that the piece fills most tightly, or opens a
new one. Pieces are dealt into bins of about BIN documents by a hash of the document, and each bin is packed in one task, so
windows are filled to within a token or two while a task's rows stay bounded. A bin's order is a function of its rows.

Tokenising goes by chunks: a byte-level tokenizer splits a text into pre-tokens before it merges, and never joins across a
single space between two other characters, so each distinct chunk is encoded once a batch and its ids are reused. Texts with
any other white space than that and single line breaks are encoded whole. The ids equal those of the whole text's encoding.

Defined results: a null text is an empty one and has the end id only; very long texts are cut, no id is dropped; ties in
length go by document; equal rows are packed each for itself; ids may be of any type; an empty table gives an empty table. Own columns are returned
with the key only, so extra columns cannot clash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parallelism, remembered, slabs, span_hashes, text_buffers, tidy

WINDOW, END = 2048, 1
#: Documents packed together, about.
BIN = 4096
#: Distinct chunks remembered by a worker.
REMEMBER = 500_000
#: Bytes of text encoded together.
TEXT_AT_ONCE = 4 << 20


class CapacityTree:
    """Open windows by remaining capacity: a segment tree whose leaf c counts the windows with c ids of room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove the window with the least room of `least` or more; its number and room."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        window = self.open[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return window, room


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; lengths must fall."""
    tree, windows, number, offset = CapacityTree(window), 0, [], []
    for n in lengths:
        got = tree.take(n)
        if got is None:
            got, windows = (windows, window), windows + 1
        number.append(got[0])
        offset.append(window - got[1])
        if got[1] > n:
            tree.add(got[1] - n, got[0])
    return number, offset


#: White space other than a space or line break, and other strings at which chunks would not be independent.
_ODD = ("  ", " \n", "\n ", "\n\n", "<|", "\x01", *(chr(c) for c in (*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


_STOP, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class ChunkEncoder:
    """Ids of whole texts, as bytes of little-endian 32-bit numbers, by a byte-level BPE tokenizer; each distinct chunk is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.line = self.ids(["\n"])[0]
        self.known[b"\n"] = self.line

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, none of which has a line break: encoded as the lines of one text, which line breaks cut into independent parts."""
        if not chunks:
            return []
        ids = np.frombuffer(self.ids(["\n".join(chunks)])[0], "<u4")
        cuts = np.flatnonzero(ids == np.frombuffer(self.line, "<u4")[0])
        assert len(cuts) == len(chunks) - 1
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if t and (t[0].isspace() or t[-1].isspace() or any(x in t for x in _ODD))]
        skip = set(odd)
        buf, offsets = text_buffers(pa.array(["" if i in skip else t for i, t in enumerate(texts)], pa.large_string()))
        out = self.chunked(buf, offsets) if len(buf) else [b""] * len(texts)
        for i, ids in zip(odd, self.ids([texts[i] for i in odd]) if odd else ()):
            out[i] = ids
        return out

    def chunked(self, buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Chunks begin at a space, at a line break and behind it, and at a comma or full stop after an ASCII letter or digit: places where the tokenizer's pre-tokens begin in any case."""
        line = buf == 0x0A
        first = line | (buf == 0x20)
        first[1:] |= line[:-1] | (_STOP[buf[1:]] & _ALNUM[buf[:-1]])
        first[offsets[:-1][offsets[:-1] < len(buf)]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(buf))
        _, index, inverse = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        raw, known = buf.tobytes(), self.known
        chunks = [raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist())]
        fresh = [c for c in chunks if c not in known]
        known.update(zip(fresh, self.apart([c.decode() for c in fresh])))
        ids = [known[c] for c in chunks]
        if len(known) > REMEMBER:
            for c in fresh:
                del known[c]
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.array([len(x) for x in ids], np.int64) >> 2
        begin, count = (np.cumsum(size) - size)[inverse], size[inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        tokens = flat[np.repeat(begin - total[:-1], count) + np.arange(total[-1])].tobytes()
        at = (4 * total[np.searchsorted(starts, offsets)]).tolist()
        return [tokens[a:b] for a, b in zip(at, at[1:])]


def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker, while it packs."""
    known = remembered("packing")
    if path not in known:
        known[path] = ChunkEncoder(path)
    return known[path]


_PIECE = ("start", "length", "ids_crc32", "doc_tokens")


def _pieces(path: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for a, b in slabs(text_buffers(batch.column("text"))[1], TEXT_AT_ONCE):
                part, out = batch.slice(a, b - a), []
                for at, ids in enumerate(encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += end.to_bytes(4, "little")
                    for s in range(0, len(ids), 4 * window):
                        piece = ids[s : s + 4 * window]
                        out.append((at, s // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
                at, *columns = (pa.array(c, pa.int64()) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("row").take(at), *columns], names=["id", "row", *_PIECE])

    return tidy(run, "packing")


def _place(window: int):
    """Rows come sorted by bin, falling length; each bin's sequences are numbered from bin * 2**32."""

    def packed(rows: pa.Table) -> pa.RecordBatch:
        number, offset = best_fit(rows.column("length").to_pylist(), window)
        first = rows.column("bin")[0].as_py() << 32
        keep = [rows.column(c).combine_chunks() for c in ("id", *_PIECE)]
        columns = [*keep, pa.array(np.array(number, np.int64) + first), pa.array(offset, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["id", *_PIECE, "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bins = batch.column("bin").to_numpy()
            cuts = [0, *(np.flatnonzero(bins[1:] != bins[:-1]) + 1).tolist(), len(bins)]
            for a, b in zip(cuts, cuts[1:]):
                if held and b > a and held[-1].column("bin")[0].as_py() != bins[a]:
                    yield packed(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield packed(pa.Table.from_batches(held))

    return tidy(run, "packing")


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, per_bin: int = BIN) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bins = max(1, docs.count() // per_bin)
    body = F.col(f"`{text}`").cast("string")
    own = docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(F.col(f"`{id}`"), body).alias("row"), body.alias("text"))
    long = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    pieces = own.mapInArrow(_pieces(tokenizer, window, end), T.StructType([own.schema["id"], *long("row", *_PIECE)]))
    # equal rows are told apart by the partition they are read in, so that no bin gets all of them
    spread = F.xxhash64("row", "start", F.spark_partition_id())
    dealt = pieces.withColumn("bin", F.pmod(spread, F.lit(bins))).repartition(min(bins, max(parallelism(docs.sparkSession), 1)), "bin")
    placed = dealt.sortWithinPartitions("bin", F.desc("length"), "row", "start").mapInArrow(_place(window), T.StructType([own.schema["id"], *long(*_PIECE, "sequence_id", "offset")]))
    return placed.withColumnRenamed("id", id)
