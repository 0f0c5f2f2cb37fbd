"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and the three-letter pieces of its words (both lower-cased for ASCII and hashed to buckets), and
its form: hashed 1- and 2-grams of its signs (runs of lower-case letters, capitals and digits shrink to one sign, other
characters stay) and levels of a few ratios: words equal to the last or the one before it, distinct words, words
in capitals, length, bytes a word. Terms are weighted by tf-idf and projected on the leading singular vectors of the labelled
sample (subspace iteration). Every text is compared with all labelled vectors by cosine, in blocks: one matrix product for a
block of texts. The NEIGHBOURS nearest labels (and those as near as the last) vote, weighted by a power of their similarity.

The labelled sample is at most SAMPLE distinct texts, chosen by a hash of the text; its vectors and the projection, of fixed
size, go to every task. Texts are read whole.

Defined results: a null text is an empty one; a text without words scores 0; without a usable label all texts score 0; a
document with several labels brings each as a row; equal texts get equal scores; an empty table gives an empty table. Own
columns start with `_k_`, other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, sampled, slabs, span_hashes, spans, text_buffers

SAMPLE, RANK, NEIGHBOURS, SHARPNESS = 6000, 48, 25, 4.0
#: Hash buckets of words, of pieces of words, and of the form's grams of each order, with their weights; levels of each ratio and their weight.
WORD_TERMS, PIECES, SHAPES = 2048, 2048, (256, 512)
WORD_WEIGHT, PIECE_WEIGHT = 1.0, 1.0
LEVELS, RATIOS, RATIO_WEIGHT = 12, 6, 0.5
SIZE = WORD_TERMS + PIECES + sum(SHAPES) + LEVELS * RATIOS

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = 0x61
_SHAPE[0x80:] = 0x61
_SHAPE[0x41:0x5B] = 0x41
_SHAPE[0x30:0x3A] = 0x30
_RUNS = np.zeros(256, bool)
_RUNS[[0x61, 0x41, 0x30, 0x20]] = True


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Relative frequencies, texts x SIZE, and the number of words of each text."""
    n = len(offsets) - 1
    out = np.zeros((n, SIZE), np.float32)
    text = np.repeat(np.arange(n), np.diff(offsets))
    shape = _SHAPE[buf]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]] | (text[1:] != text[:-1])
    shape, text = shape[keep].astype(np.uint32), text[keep]
    base, gram = 0, shape

    def add(bucket: np.ndarray, owner: np.ndarray, size: int, weight: float = 1.0) -> None:
        nonlocal base
        count = np.bincount(owner * size + bucket, minlength=n * size).reshape(n, size)
        out[:, base : base + size] = weight * np.sqrt(count / np.maximum(1, count.sum(1, keepdims=True)))
        base += size

    for order, size in enumerate(SHAPES, 1):
        if order > 1:
            gram = gram[:-1] * np.uint32(0x9E3779B1) + shape[order - 1 :] * np.uint32(0x85EBCA6B)
        bucket = (shape if order == 1 else (gram * np.uint32(0xC2B2AE35)) >> np.uint32(32 - (size - 1).bit_length())).astype(np.int64)
        own = text[: len(bucket)] == text[order - 1 :]
        add(bucket[own], text[: len(bucket)][own], size)
    starts, ends, first = spans(buf, offsets)
    lower = _LOWER[buf]
    words, count = span_hashes(lower, starts, ends), np.diff(first)
    owner = np.repeat(np.arange(n), count)
    add((words >> np.uint64(53)).astype(np.int64), owner, WORD_TERMS, WORD_WEIGHT)
    # pieces of a word: each byte with the two before it, the space before the word among them
    x = np.where(SPACE[lower], 0x20, lower).astype(np.uint32)
    piece = (x[2:] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[:-2] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    page = np.repeat(np.arange(n), np.diff(offsets))
    inside = (page[2:] == page[:-2]) & (x[2:] != 0x20) & (x[1:-1] != 0x20)
    add((piece[inside] >> np.uint32(21)).astype(np.int64), page[2:][inside], PIECES, PIECE_WEIGHT)
    some = np.maximum(1, count)
    same = lambda k: np.bincount(owner[k:][(words[k:] == words[:-k]) & (owner[k:] == owner[:-k])], minlength=n) / some
    distinct = np.bincount((np.unique(np.stack([owner.astype(np.uint64), words]), axis=1)[0]).astype(np.int64), minlength=n) / some if len(words) else np.zeros(n)
    upper = np.bincount(owner[(buf[starts] >= 0x41) & (buf[starts] <= 0x5A) & (buf[ends - 1] < 0x61)], minlength=n) / some if len(words) else np.zeros(n)
    ratios = (same(1), same(2), distinct, upper, np.minimum(1, np.log1p(count) / 10), np.minimum(1, np.diff(offsets) / some / 20))
    for r, value in enumerate(ratios):
        level = np.minimum(LEVELS - 1, (value * LEVELS).astype(np.int64))
        out[np.arange(n), base + r * LEVELS + level] = RATIO_WEIGHT
    out[count == 0] = 0
    return out, count


def leading(x: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from a fixed start: memory for x and a few thin matrices."""
    rank = min(rank, *x.shape)
    v = np.random.default_rng(0).normal(size=(x.shape[1], min(x.shape[1], rank + 16))).astype(np.float32)
    for _ in range(rounds):
        v = np.linalg.qr(x.T @ (x @ v))[0]
    return v @ np.linalg.svd(x @ v, full_matrices=False)[2].T[:, :rank]


@dataclass(frozen=True)
class Model:
    projection: np.ndarray  # SIZE x RANK, with idf
    vectors: np.ndarray  # RANK x labelled
    labels: np.ndarray
    neighbours: int
    sharpness: float

    def embed(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.projection
        return z / np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))

    def score(self, column: pa.Array) -> np.ndarray:
        buf, offsets = text_buffers(column)
        out = np.zeros(len(column))
        for a, b in slabs(offsets):
            x, count = terms(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i in range(0, b - a, 512):
                cosine = np.maximum(0, self.embed(x[i : i + 512]) @ self.vectors)
                k = min(self.neighbours, cosine.shape[1])
                least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
                weight = np.where(cosine >= least[:, None], cosine, 0) ** self.sharpness
                total = weight.sum(1)
                out[a + i : a + i + len(x[i : i + 512])] = np.where((total > 0) & (count[i : i + 512] > 0), weight @ self.labels / np.maximum(total, 1e-30), 0)
        return np.round(np.clip(out, 0, 1), 6)


def fit(labelled: DataFrame, text: str, label: str, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> Model | None:
    """labelled: rows of a text and a label 0 or 1; rows with another label or no text are left out."""
    known = labelled.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1) and text is not null")
    n = known.count()
    if not n:
        return None
    chosen = sampled(known, F.lit(min(1.0, sample / n)), ["label"], sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffers(batch.column("text"))
            for a, b in slabs(offsets):
                x, count = terms(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                good = count > 0
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a).filter(pa.array(good)), pa.array([r.tobytes() for r in x[good].astype(np.float16)], pa.binary())], names=["label", "x"])

    got = chosen.mapInArrow(features, "label int, x binary").toArrow()
    if not got.num_rows:
        return None
    label_ = got.column("label").to_numpy().astype(np.float32)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, SIZE).astype(np.float32)
    order = np.lexsort((label_, *x.T[:6]))
    label_, x = label_[order], x[order]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
    weighted = x * idf
    projection = (idf[:, None] * leading(weighted, rank)).astype(np.float32)
    model = Model(projection, np.zeros((0, 0)), label_, neighbours, sharpness)
    return Model(projection, np.ascontiguousarray(model.embed(x).T), label_, neighbours, sharpness)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with `_k_score`."""

    @F.arrow_udf("double")
    def voted(column: pa.Array) -> pa.Array:
        return pa.array(np.zeros(len(column)) if model is None else model.score(column))

    return docs.withColumn("_k_score", voted(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
