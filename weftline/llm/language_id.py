"""Language identification in two steps: the family first, then one-versus-one linear SVMs between the family's languages.

Features are relative frequencies of hashed byte 1-, 2- and 3-grams of the lower-cased text, all but letters being blanks. A
linear classifier on them is a mean of weights over a text's positions, so a text is judged in one pass over its bytes,
whatever its length. Families are told apart by one-versus-one machines as well; most votes win, then the larger margins.

The machines are fitted on the driver on a sample of labelled texts: at most `PER_LANGUAGE` of each language and `SAMPLE` in
all, distinct ones chosen by a hash of the text, of the `LANGUAGES` most frequent languages. Every text is read whole, both
for fitting and for prediction.

Defined results: a null text or one without a letter is `und` with score 0; where nothing was learned, every text is; ties
in votes go to the larger sum of margins, then to the language that sorts first; equal texts get equal results; an empty table gives an empty table. Own columns start
with `_l_`, other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, slabs, text_buffers

PER_LANGUAGE, SAMPLE, LANGUAGES = 1000, 6000, 200
#: Language codes by family; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "malayo-polynesian": "id jv mg ms tl",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Buckets of the 1-, 2- and 3-grams and the scale of their frequencies.
ORDERS = ((256, 3.0), (2048, 8.0), (4096, 16.0))
SIZE = sum(n for n, _ in ORDERS)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def codes(buf: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, float]]:
    """Order, first bucket, bucket of the gram at each position (those at the end are short by order - 1), scale."""
    x = np.where(_LETTER[buf], buf, 0x20).astype(np.uint32)
    base, gram = 0, x
    for order, (size, scale) in enumerate(ORDERS, 1):
        if order > 1:
            gram = gram[:-1] * np.uint32(0x9E3779B1) + x[order - 1 :] * np.uint32(0x85EBCA6B)
        bucket = (gram * np.uint32(0xC2B2AE35)) >> np.uint32(32 - (size - 1).bit_length())
        yield order, base, (x if order == 1 else bucket).astype(np.int64), scale
        base += size


def frequencies(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x SIZE."""
    n = len(offsets) - 1
    out = np.zeros((n, SIZE), np.float32)
    text = np.repeat(np.arange(n), np.diff(offsets))
    for order, base, bucket, scale in codes(buf):
        own = text[: len(bucket)] == text[order - 1 :]
        count = np.bincount(text[: len(bucket)][own] * ORDERS[order - 1][0] + bucket[own], minlength=n * ORDERS[order - 1][0]).reshape(n, -1)
        out[:, base : base + count.shape[1]] = scale * count / np.maximum(1, count.sum(1, keepdims=True))
    return out


def has_letter(column: pa.Array) -> np.ndarray:
    buf, offsets = text_buffers(column)
    out = np.zeros(len(column), bool)
    for a, b in slabs(offsets):
        part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        plain = np.flatnonzero(_LETTER[part | 0x20] & (part < 0x80) & (part >= 0x41))
        wide = np.flatnonzero(part >= 0x80)
        inside = lambda x: np.diff(np.searchsorted(x, at)) > 0
        out[a:b] = inside(plain)
        for i in np.flatnonzero(~out[a:b] & inside(wide)):
            out[a + i] = any(c.isalpha() for c in column[int(a + i)].as_py())
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by dual coordinate descent. Classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    each = np.where(y > 0, len(y) / (2.0 * (y > 0).sum()), len(y) / (2.0 * (y < 0).sum()))
    ridge, square = 0.5 / (cost * each), (x * x).sum(1)
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = (y[i] * (x[i] @ w) - 1 + ridge[i] * alpha[i]) / (square[i] + ridge[i])
            new = max(0.0, alpha[i] - step)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass(frozen=True)
class Model:
    languages: list[str]
    groups: list[tuple[str, list[str]]]
    pairs: list[tuple[int, str, str]]  # index of the group (-1: between families), the two classes
    weights: np.ndarray  # pairs x SIZE + 1

    def margins(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts x pairs; a positive margin speaks for the pair's first class."""
        out = np.repeat(self.weights[None, :, -1], len(offsets) - 1, 0)
        for order, base, bucket, scale in codes(buf):
            stop = np.maximum(offsets[:-1], offsets[1:] - order + 1)
            count = np.maximum(1, stop - offsets[:-1])
            for p in range(len(self.pairs)):
                total = np.concatenate([[0.0], np.cumsum(self.weights[p, base : base + ORDERS[order - 1][0]][bucket])])
                stop_ = np.minimum(stop, len(total) - 1)
                out[:, p] += scale * (total[stop_] - total[np.minimum(offsets[:-1], stop_)]) / count
        return out

    def decide(self, margins: np.ndarray, group: int, classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winning class for each text and its least margin over the others."""
        votes, support, least = (np.zeros((len(margins), len(classes))) for _ in range(3))
        least += np.inf
        for p, (g, a, b) in enumerate(self.pairs):
            if g == group:
                for c, m in ((classes.index(a), margins[:, p]), (classes.index(b), -margins[:, p])):
                    votes[:, c] += m > 0
                    support[:, c] += m
                    least[:, c] = np.minimum(least[:, c], m)
        best = np.argmax(votes + 1e-3 * np.tanh(support), axis=1)
        return best, least[np.arange(len(best)), best]

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        buf, offsets = text_buffers(pc.utf8_lower(column))
        names, scores = [], []
        families = [f for f, _ in self.groups]
        for a, b in slabs(offsets):
            m = self.margins(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            family, sure = self.decide(m, -1, families)
            name, least = np.zeros(b - a, object), sure.copy()
            for g, (_, members) in enumerate(self.groups):
                at = np.flatnonzero(family == g)
                own, margin = self.decide(m[at], g, members)
                name[at] = np.array(members, object)[own]
                least[at] = np.minimum(least[at], margin)
            names += name.tolist()
            scores += np.round(1 / (1 + np.exp(-np.clip(3 * least, -30, 30))), 6).tolist()
        return names, scores


def fit(labelled: DataFrame, text: str, language: str, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    known = labelled.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{language}`").cast("string").alias("language")).where("language is not null")
    # this count reads no texts
    counts = {r["language"]: r["count"] for r in known.groupBy("language").count().orderBy(F.desc("count"), "language").limit(LANGUAGES).collect()}
    if not counts:
        return None
    most = max(1, min(per_language, sample // len(counts)))
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / n))]), F.col("language"))
    chosen = sampled(known.where("text is not null and text != ''"), F.coalesce(rate, F.lit(0.0)), ["language"], sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            buf, offsets = text_buffers(pc.utf8_lower(column))
            for a, b in slabs(offsets):
                x = frequencies(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).astype(np.float16)
                good = has_letter(column.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("language").slice(a, b - a).filter(pa.array(good)), pa.array([r.tobytes() for r in x[good]], pa.binary())], names=["language", "x"])

    got = chosen.mapInArrow(features, "language string, x binary").toArrow()
    lang = np.array(got.column("language").to_pylist(), object)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, SIZE)
    order = np.lexsort(x.T[:8].astype(np.float32)) if len(x) else np.zeros(0, np.int64)
    # the rate holds on average only
    order = order[np.sort(np.concatenate([np.flatnonzero(lang[order] == v)[:most] for v in counts]))] if len(x) else order
    lang, x = lang[order], x[order].astype(np.float32)
    languages = sorted(set(lang))
    if not languages:
        return None
    family = np.array([FAMILY.get(v, v) for v in lang], object)
    groups = [(f, [v for v in languages if FAMILY.get(v, v) == f]) for f in sorted(set(family))]
    pairs = [(-1, a, b) for a, b in combinations([f for f, _ in groups], 2)] + [(g, a, b) for g, (_, members) in enumerate(groups) for a, b in combinations(members, 2)]
    weights = []
    for g, a, b in pairs:
        label = family if g < 0 else lang
        at = (label == a) | (label == b)
        weights.append(fit_svm(x[at], np.where(label[at] == a, 1.0, -1.0)))
    return Model(languages, groups, pairs, np.array(weights).reshape(len(pairs), SIZE + 1))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with `_l_language` and `_l_score`."""

    @F.arrow_udf("struct<language:string,score:double>")
    def said(column: pa.Array) -> pa.Array:
        good = has_letter(column) if model is not None else np.zeros(len(column), bool)
        names, scores = np.full(len(column), "und", object), np.zeros(len(column))
        if good.any():
            names[good], scores[good] = model.predict(column.filter(pa.array(good)))
        return pa.StructArray.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(scores)], ["language", "score"])

    out = docs.withColumn("_l_", said(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    return out.withColumns({"_l_language": F.col("_l_.language"), "_l_score": F.col("_l_.score")}).drop("_l_")
