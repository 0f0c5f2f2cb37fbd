import hashlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import fm_index
from weftline.llm import substring_dedup as D


def brute(texts, width=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        left = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 0])
def test_against_brute_force(messy, monkeypatch, hot):
    monkeypatch.setattr(D, "HOT", hot)
    rows = D.dedupe(messy).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute([r.own.text for r in rows])
    assert len(rows) == messy.count() and rows[0].own.asDict().keys() == set(messy.columns)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in rows)


def test_small_alphabet(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["a", "b"], size=n, p=[0.9, 0.1])) for n in (34, 35, 60, 200, 400)] + ["a " * 300, "a b " * 90]
    rows = D.dedupe(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute(texts)


def test_empty(empty):
    assert D.dedupe(empty).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 6, 500)
    seq = np.append(text, 0)
    index = fm_index.FMIndex(seq, 6, np.ones(len(seq), np.int64), 8)
    for _ in range(100):
        n = int(rng.integers(1, 7))
        p = rng.integers(1, 6, n)
        low, high = np.array([0]), np.array([len(seq)])
        for c in p[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        want = sum((text[i : i + n] == p).all() for i in range(len(text) - n + 1))
        assert int(index.count(low, np.maximum(low, high))[0]) == want


def test_compressed_planes():
    """Ranks of compressed planes are exact, and runs take next to no room."""
    rng = np.random.default_rng(4)
    for bit in (rng.random(5000) < 0.5, np.zeros(1000, bool), np.ones(1024, bool), np.repeat(rng.random(40) < 0.5, 1000), np.zeros(0, bool), np.ones(1, bool)):
        plane = fm_index.Plane(bit)
        assert (plane.ones(np.arange(len(bit) + 1)) == np.concatenate([[0], np.cumsum(bit)])).all()
    assert fm_index.Plane(np.repeat([True, False], 500_000)).nbytes < 1_000_000 / 8 / 3
