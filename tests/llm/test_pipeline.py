import os
import random
import zlib

import pytest

import corpus_pipeline as P
from weftline.llm import quality_rules, substring_dedup
from weftline.llm.common import stash

DATA = "/root/testdata/sf0.001"


def test_stages(spark, messy):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    seen = []
    for name, stage in P.STAGES:
        docs = stash(stage(spark, docs, DATA) if os.path.exists(DATA) or name != "benchmark_leaks" else docs, name)
        seen.append((name, docs.count()))
        if name != P.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in seen] == ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_leaks", "packing"]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_each_stage_against_its_own_rule(spark):
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    rules = P.rules(spark, source, DATA)
    kept = {r.doc_id for r in quality_rules.judge(source).where("_q_.kept").select("doc_id").collect()}
    assert {r.doc_id for r in rules.select("doc_id").collect()} == kept
    near = P.near_duplicates(spark, rules, DATA)
    texts = {r.doc_id: r.text.split() for r in rules.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    left = [r.doc_id for r in near.collect()]
    for i in left:
        for j in left:
            assert i == j or len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j])
    passages = P.repeated_passages(spark, near, DATA).collect()
    want = {r.own.doc_id: r.kept_text for r in substring_dedup.dedupe(near).collect()}
    assert all(r.text.split() == want[r.doc_id].split() and r.n_chars == len(r.text) for r in passages)
    assert P.run(spark, DATA).count() > 0


def texts_of(rng, n, words=60):
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(words)) for _ in range(n)]


def test_rows_without_id_keep_one_of_each_class(spark):
    """Unique documents without id stay, and a copy without id does not take the others of its class with it."""
    texts = texts_of(random.Random(11), 20)
    rows = [(None, t) for t in texts] + [(i, t) for i, t in enumerate(texts[:12])] + [(100 + i, t) for i, t in enumerate(texts[:6])]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), DATA).collect()
    assert sorted(r.text for r in got) == sorted(texts)
    assert {r.text: r.doc_id for r in got} == {t: i if i < 12 else None for i, t in enumerate(texts)}


def test_leaks_of_rows_without_id(spark, tmp_path):
    """Of rows that share an id, or have none, only those with a leak go."""
    a, b, c, d = texts_of(random.Random(12), 4)
    spark.createDataFrame([(1, a), (2, b)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, a), (None, c), (5, b), (5, d)]
    got = P.benchmark_leaks(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path)).collect()
    assert sorted(r.text for r in got) == sorted([c, d])


def test_repeated_rows_keep_their_text(spark):
    """Of equal rows one stays, and the passages of its text are not repeats."""
    a, b, c = texts_of(random.Random(13), 3)
    rows = [(1, a, "s"), (1, a, "s"), (1, a, "t"), (2, a, "s"), (3, b, "s"), (None, c, "s"), (None, c, "s")]
    near = stash(P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), DATA), "near")
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == sorted([(1, a), (3, b), (None, c)], key=str)
    assert sorted(r.text for r in P.repeated_passages(spark, near, DATA).collect()) == sorted([a, b, c])


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of a few words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_result_against_brute_force(spark, tmp_path):
    """run() from documents to packed ids, beside plain Python for each stage."""
    from tokenizers import Tokenizer

    from weftline.llm import packing
    from weftline.llm.queries import tokenizer_path

    rng = random.Random(31)
    word = lambda: f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(900)}"
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    passage, items = line(50), [line(20) for _ in range(3)]
    texts = ["\n".join(line(15) for _ in range(rng.randrange(2, 9))) for _ in range(30)]
    texts += [t + "\n" + line(2) for t in texts[:4]] + texts[:3]  # near and exact copies
    texts += [f"{line(20)}\n{passage}\n{line(20)}" for _ in range(3)] + [f"{line(30)} {items[0]}", f"{line(4)}\nLog in.\n{line(12)}"]
    texts += [None, "", "no mark\n" * 5, f"{line(9)}\n{'# ' * 30}\n" + "| a | b | c |\n" * 5, line(2500)]
    docs = list(enumerate(texts))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def ruled(t):
        lines = list(dict.fromkeys(x for x in (t or "").split("\n") if x.split()))
        good = [x for x in lines if x.rstrip().endswith(".") and x != "Log in." and "| a |" not in x]
        n = len((t or "").split())
        return "\n".join(good) if n >= 10 and sum(len(x.split()) for x in good) >= 0.5 * n else None

    left = {i: r for i, t in docs if (r := ruled(t)) is not None}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in left.items() for w in [t.split()]}
    up = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            if j < i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = up[i], up[j]
                up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
    left = {i: t for i, t in left.items() if up[i] == i}
    starts = {}
    for i, t in left.items():
        w = t.split()
        for k in range(len(w) - 34):
            starts.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = {(i, k + x) for at in starts.values() if len(at) > 1 for i, k in at for x in range(35)}
    left = {i: " ".join(w for k, w in enumerate(t.split()) if (i, k) not in gone) if any(g[0] == i for g in gone) else t for i, t in left.items()}
    left = {i: t for i, t in left.items() if not any(x in t for x in items)}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END] for i, t in left.items()}

    got, windows = {}, {}
    for r in P.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(got) == set(want) and 5 < len(want) < len(texts) - 10
    for i, pieces in got.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = b"".join(x.to_bytes(4, "little") for x in want[i][r.start : r.start + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want[i]), zlib.crc32(part))
            at += r.length
        assert at == len(want[i])
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
