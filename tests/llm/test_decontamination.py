import random

from weftline.llm import decontamination as C


def text(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_planted(spark):
    rng = random.Random(2)
    items = [(i, " ".join(text(rng, 40 if i % 2 else 15)), "c") for i in range(20)] + [(50, None, None), (51, "", "c"), (52, "one two three", "c")]
    docs, want = [], {}
    for i in range(60):
        w = text(rng, rng.randrange(0, 300))
        if i % 3 == 0:
            item = i % 20
            p = [x.upper() for x in items[item][1].split()]
            for at in range(5, len(p), 9):
                p[at] = "changed"
            w[len(w) // 2 : len(w) // 2] = p
            want[i] = item
        docs.append((i, (", ".join(w) if i % 2 else " ".join(w)), "clash"))
    docs += [(100, None, None), (101, "", "x"), docs[0], docs[3], (None, items[1][1], "n")]
    got = C.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, seed string"), spark.createDataFrame(items, "item_id bigint, text string, near string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {*want.items(), (None, 1)}
    assert len(got) == len(want) + 1


def test_clean_and_empty(spark, messy, empty):
    bench = spark.createDataFrame([(1, " ".join(text(random.Random(9), 40)))], "item_id bigint, text string")
    assert C.leaks(messy, bench).count() == 0
    assert C.leaks(empty, bench).count() == 0
    assert C.leaks(messy, bench.limit(0)).count() == 0


def test_long_item_in_long_text(spark):
    rng = random.Random(4)
    item = text(rng, 500)
    doc = [*text(rng, 2000), *item[100:160], *text(rng, 2000)]
    got = C.leaks(spark.createDataFrame([(1, " ".join(doc))], "doc_id bigint, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and got[0].same >= 40 and 1990 <= got[0].start <= 2064


def test_whole_stretch_of_a_long_item(spark):
    """A long item copied whole is one stretch, also over a part where substituted words leave no seed."""
    rng = random.Random(6)
    item, other = text(rng, 500), [f"v{i}" for i in range(300)]
    copy = list(other)
    for at in range(100, 240, 4):
        copy[at] = "changed"
    docs = [(1, " ".join([*text(rng, 333), *item, *text(rng, 100)])), (2, " ".join([*text(rng, 70), *copy])), (None, " ".join(item[200:]))]
    items = [(7, " ".join(item)), (8, " ".join(other))]
    got = C.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.start, r.length, r.same) for r in got} == {(1, 7, 333, 500, 500), (2, 8, 70, 300, 265), (None, 7, 0, 300, 300)}


def brute(docs, items, least=C.LEAST, share=C.SHARE, shortest=C.SHORTEST):
    """The best stretch over all diagonals that a seed hits, from token lists."""
    out = {}
    for i, d in docs:
        for k, t in items:
            found = []
            for shift in range(1 - len(t), len(d)):
                pairs = [(j, d[j + shift] == t[j]) for j in range(max(0, -shift), min(len(t), len(d) - shift))]
                seed = any(all(0 <= j + o < len(t) and 0 <= j + o + shift < len(d) and t[j + o] == d[j + o + shift] for o, b in enumerate(m) if b == "1") for j, _ in pairs for m in C.MASKS)
                if not seed and not (len(t) < 7 and len(pairs) == len(t) and all(e for _, e in pairs)) or len(t) < shortest:
                    continue
                best = None
                for a in range(len(pairs)):
                    score = 0
                    for b in range(a, len(pairs)):
                        score += 1 if pairs[b][1] else -C.MISMATCH
                        if best is None or (score, -b, -a) > best[0]:
                            best = (score, -b, -a), a, b + 1
                _, a, b = best
                same = sum(e for _, e in pairs[a:b])
                if same >= min(least, len(t)) and same >= share * (b - a):
                    found.append((same, -(pairs[a][0] + shift), b - a))
            if found:
                same, start, length = max(found)
                out[i, k] = (-start, length, same)
    return out


def test_items_of_all_lengths(spark):
    """Short, middling and long items, whole, cut and with substitutions, against brute force; ids are strings."""
    rng = random.Random(21)
    items = [(f"i{n}", text(rng, n)) for n in (1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 16, 30)]
    docs = []
    for k, (_, t) in enumerate(items):
        for changes in (0, 0, 1, 2):
            copy = list(t)
            for at in rng.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = "changed"
            docs.append((f"d{len(docs)}", [*text(rng, rng.randrange(0, 12)), *copy[rng.randrange(2) * (len(copy) > 13) :], *text(rng, rng.randrange(0, 12))]))
        docs.append((f"d{len(docs)}", [*t, "between", *t]))
    got = C.leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id string, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.start, r.length, r.same) for r in got} == brute(docs, items)


def test_very_long_items(spark):
    rng = random.Random(22)
    items = [(n, text(rng, n)) for n in (200, 700, 2000)]
    docs, want = [], set()
    for n, t in items:
        copy = list(t)
        for at in range(7, n - 7, 23):
            copy[at] = "changed"
        docs.append((n, " ".join([*text(rng, 150), *copy, *text(rng, 90)])))
        want.add((n, n, 150, n, n - len(range(7, n - 7, 23))))
    got = C.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.start, r.length, r.same) for r in got} == want
