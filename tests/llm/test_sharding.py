import math
import random
import zlib
from collections import Counter

from weftline.llm import queries, sharding


def test_matrix_is_exact():
    counts, sizes = [5, 0, 17, 30, 1], [18, 18, 17]
    for seed in range(20):
        m = sharding.matrix(counts, sizes, seed)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == sizes


def test_hypergeometric_law():
    rng = random.Random(1)
    got = Counter(sharding.hypergeometric(rng, 4, 6, 5) for _ in range(20000))
    want = {0: 6 / 252, 1: 60 / 252, 2: 120 / 252, 3: 60 / 252, 4: 6 / 252}
    assert all(abs(got[k] / 20000 - p) < 0.015 for k, p in want.items())


def test_large_draws_stay_in_range():
    rng = random.Random(2)
    for good, bad, n in ((10**9, 39 * 10**9, 3 * 10**7), (0, 5, 3), (5, 0, 3), (1, 10**10, 10**9)):
        assert max(0, n - bad) <= sharding.hypergeometric(rng, good, bad, n) <= min(good, n)


def test_shards(messy, empty):
    out = sharding.shard(messy, ["doc_id", "text"], 7, blocks=16, cells=8).collect()
    sizes = Counter(r["_s_shard"] for r in out)
    assert len(out) == messy.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["_s_slot"] for r in out if r["_s_shard"] == s) == list(range(sizes[s]))
    assert sharding.shard(empty, ["doc_id", "text"], 7).count() == 0


def test_same_rows_same_result(messy):
    put = lambda d: sorted((r.doc_id or -1, r["_s_shard"], r["_s_slot"]) for r in sharding.shard(d.dropDuplicates(), ["doc_id", "text"], 5).collect())
    assert put(messy.repartition(3)) == put(messy.repartition(7))


def test_shuffle_is_uniform(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id")
    out = sharding.shard(rows, ["doc_id"], 4).collect()
    halves = Counter((r["_s_shard"], r.doc_id < 2000) for r in out)
    assert all(abs(halves[s, True] - 500) < 80 for s in range(4))
    first = sum(r.doc_id for r in out if r["_s_slot"] < 100) / 400
    assert abs(first - 2000) < 200


def test_probabilities_are_exact():
    """Against exact integers: the relative error stays near that of a float for large counts too."""
    for n, x in ((10, 0), (10, 10), (40, 7), (1000, 500), (3000, 12)):
        want = math.log(math.comb(n, x)) + x * math.log(3 / 7) + (n - x) * math.log(4 / 7)
        assert abs(sharding._binomial(x, n, 3 / 7, 4 / 7) - want) < 1e-10
    good, bad, drawn = 300_000, 700_000, 200_000
    whole = [sharding._binomial(x, good, 0.2, 0.8) + sharding._binomial(drawn - x, bad, 0.2, 0.8) - sharding._binomial(drawn, good + bad, 0.2, 0.8) for x in range(58_000, 62_001)]
    assert abs(math.fsum(map(math.exp, whole)) - 1) < 1e-9


def test_long_texts_odd_ids_and_equal_rows(spark):
    rows = [(None, "x" * 200_000)] * 3 + [(10**18, None)] * 40 + [(1, "a"), (None, None)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id", "text"], 7, blocks=4, cells=3).collect()
    assert len(out) == 45 and Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    assert sorted(Counter(r["_s_shard"] for r in out).values()) == [6, 6, 6, 6, 7, 7, 7]
    assert sorted((r["_s_shard"], r["_s_slot"]) for r in out) == [(s, k) for s in range(7) for k in range(7 if s < 3 else 6)]


def test_query_against_brute_force(spark, messy, tmp_path):
    """Every column of the query: sizes and checksums by zlib, one row per document, rows at most one apart, slots without gaps."""
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op4_sharding(spark, str(tmp_path)).collect()
    raw = [(r.doc_id, (r.text or "").encode()) for r in messy.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(t) + 16, zlib.crc32(t)) for i, t in raw)
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    held = Counter(r.shard for r in out)
    assert set(held) <= set(range(40)) and {len(raw) // 40, -(-len(raw) // 40)} >= set(held.get(s, 0) for s in range(40))
    assert sorted((r.shard, r.slot) for r in out) == sorted((s, k) for s, n in held.items() for k in range(n))
