import random

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import near_dup as N


def sets(text, k=5):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    """Class of each distinct text."""
    texts = sorted({t or "" for _, t in rows})
    s = {t: sets(t) for t in texts}
    up = {t: t for t in texts}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                up[top(a)] = top(b)
    return {t: top(t) for t in texts}


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows)
    ids = {}
    for i, t in rows:
        if i is not None:
            ids.setdefault(want[t or ""], set()).add(i)
    got = N.classes(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            t = next(t for i, t in rows if i == r.doc_id)
            members = ids[want[t or ""]] | {r.class_id for _ in [0] if any(i is None and want[x or ""] == want[t or ""] for i, x in rows)}
            assert r.class_id == min(members), (r, t)


def test_messy(messy, empty):
    check(messy)
    assert N.classes(empty).count() == 0


@pytest.mark.parametrize("cell", [4096, 8])
def test_groups(spark, monkeypatch, cell):
    """Copies of a text with more and more changed words, so that only some are linked, and through others."""
    monkeypatch.setattr(N, "CELL", cell)
    rng, rows = random.Random(7), []
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(150)] = rng.choice(["p", "q", f"z{i}"])
        rows.append((1000 - i, " ".join(w), "x"))
    rows += [(i, " ".join(f"u{rng.randrange(999)}" for _ in range(80)), "y") for i in range(30)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string, node string"))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    common, own = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    gram = np.concatenate([common, own[:50], common, own[50:]])
    text = np.repeat([0, 1], 450)
    s = N.signatures(gram, text, np.ones(900, np.int64), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 400 / 500) < 0.04


def test_weights_count():
    """A heavier shingle wins more slots: over many pairs, its share is that of its weight."""
    rng, shares = np.random.default_rng(5), []
    for _ in range(300):
        g = rng.integers(0, 2**63, 2).astype(np.uint64)
        s = N.signatures(g, np.array([0, 0]), np.array([20, 1]), 1, 8)
        shares.append((s[0] == (g[0] >> np.uint64(32))).mean())
    w = 1 + np.log(20)
    assert abs(np.mean(shares) - w / (w + 1)) < 0.04


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (103, 101)], "a bigint, b bigint")
    got = {r.node: r.label for r in N.components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 103: 100}


def test_links_of_texts_with_repeated_passages():
    """Pairs of set similarity 0.8 that differ in looped passages share a band like any others."""
    rng, texts = random.Random(9), []
    for i in range(300):
        common = [f"c{i}x{rng.randrange(10**6)}" for _ in range(360)]
        loops = [[f"{side}{i}x{j}" for j in range(40)] * 11 for side in "ab"]
        texts += [" ".join(common + loop) for loop in loops]
        assert 0.8 <= len(sets(texts[-1]) & sets(texts[-2])) / len(sets(texts[-1]) | sets(texts[-2])) < 0.81
    n = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([n, n, n, pa.array(texts)], names=["id", "h1", "h2", "text"])
    bands = [b for part in N._sketch(N.WORDS, N.BANDS, N.ROWS)(iter([batch])) for b in part.column("bands").to_pylist()]
    assert all(len(b) == len(set(b)) for b in bands)
    assert sum(not set(a) & set(b) for a, b in zip(bands[::2], bands[1::2])) == 0
