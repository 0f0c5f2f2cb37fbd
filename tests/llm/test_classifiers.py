import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import language_id as L
from weftline.llm import quality_knn as K
from weftline.llm import queries as Q

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@needs_data
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    out = Q.op7_language_id(spark, DATA).join(docs, "doc_id").where("held_out")
    assert out.where("lang_pred = lang").count() / out.count() > 0.97


@needs_data
def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = Q.op8_quality_classifier(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_language_of_odd_rows(spark, messy, empty):
    rows = spark.createDataFrame([("the cat sat on the mat and the dog", "en"), ("der Hund und die Katze sind hier", "de"), ("le chat et le chien sont dans la maison", "fr"), ("12 34", "en"), (None, "fr")] * 5, "text string, lang string")
    model = L.fit(rows, "text", "lang")
    assert model.languages == ["de", "en", "fr"] and [g for g, _ in model.groups] == ["germanic", "romance"]
    for r in L.predict(messy, model).collect():
        und = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r["_l_language"] == "und") == und and 0 <= r["_l_score"] <= 1
    assert {r["_l_language"] for r in L.predict(messy, None).collect()} == {"und"}
    assert L.fit(rows.limit(0), "text", "lang") is None and L.predict(empty, model).count() == 0
    got = [r["_l_language"] for r in L.predict(rows.limit(3), model).collect()]
    assert got == ["en", "de", "fr"]


def test_batches_do_not_matter():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdeé .")) for _ in range(int(n))) for n in rng.integers(0, 60, 40)]
    model = L.Model(["a", "b"], [("f", ["a", "b"])], [(0, "a", "b")], rng.normal(size=(1, L.SIZE + 1)))
    whole = model.predict(pa.array(texts))[1]
    assert whole == [s for t in texts for s in model.predict(pa.array([t]))[1]]


def test_quality_of_odd_rows(messy, empty):
    labelled = messy.select("text", (F.length("text") % 2).alias("quality"))
    model = K.fit(labelled, "text", "quality")
    for r in K.score(messy, model).collect():
        assert 0 <= r["_k_score"] <= 1 and ((r.text or "").split() or r["_k_score"] == 0)
    assert K.fit(labelled.limit(0), "text", "quality") is None and K.score(empty, model).count() == 0
    assert {r["_k_score"] for r in K.score(messy, None).collect()} == {0.0}


def test_neighbours_vote():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(4, 50)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=0)
    labels = (vectors[0] > 0).astype(np.float32)
    model = K.Model(rng.normal(size=(K.SIZE, 4)).astype(np.float32), vectors, labels, 5, 4.0)
    text = pa.array(["Some words are here, and MORE words."])
    x, _ = K.terms(np.frombuffer(text[0].as_py().encode(), np.uint8), np.array([0, len(text[0].as_py())]))
    cosine = np.maximum(0, model.embed(x) @ vectors)[0]
    near = np.argsort(-cosine)[:5]
    want = (cosine[near] ** 4 @ labels[near]) / (cosine[near] ** 4).sum()
    assert abs(model.score(text)[0] - want) < 1e-5


def test_samples_are_bounded_and_distinct(spark):
    """However often a text is repeated and however the hashes fall, a sample has so many rows at most, and no text twice."""
    from weftline.llm.common import sampled

    rows = spark.createDataFrame([("hot", 1)] * 300 + [(f"t{i}", i % 2) for i in range(200)], "text string, label int")
    for rate, most in ((1.0, 50), (0.5, 1000), (1e-12, 50), (F.lit(1.0), 10**6)):
        got = [(r.label, r.text) for r in sampled(rows, rate, ["label"], most).collect()]
        assert len(got) == len(set(got)) <= min(most, 201)
    assert sampled(rows, 1.0, ["label"], 10**6).count() == 201


def test_languages_are_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(f"text number {i} of language {i % 9}", f"l{i % 9}") for i in range(90)] + [("plus", "l3"), ("one more", "l4")], "text string, lang string")
    monkeypatch.setattr(L, "LANGUAGES", 2)
    assert L.fit(rows, "text", "lang").languages == ["l3", "l4"]


def test_language_ties():
    """Equal margins: the language that sorts first."""
    model = L.Model(["a", "b", "c"], [("f", ["a", "b", "c"])], [(0, "a", "b"), (0, "a", "c"), (0, "b", "c")], np.zeros((3, L.SIZE + 1)))
    assert model.predict(pa.array(["any text", "other"])) == (["a", "a"], [0.5, 0.5])


def test_neighbour_ties():
    """All neighbours as near as the last of the NEIGHBOURS vote, so their order makes no difference."""
    one = np.zeros((K.SIZE, 2), np.float32)
    one[:, 0] = 1
    vectors = np.repeat(np.array([[1.0], [0.0]], np.float32), 6, 1)
    for labels in ([1, 1, 1, 0, 0, 0], [0, 0, 0, 1, 1, 1], [1, 0, 1, 0, 1, 0]):
        model = K.Model(one, vectors, np.array(labels, np.float32), 3, 4.0)
        assert model.score(pa.array(["some words"])).tolist() == [0.5]


def test_leading_vectors():
    x = np.random.default_rng(2).normal(size=(60, 30)).astype(np.float32) @ np.diag(0.7 ** np.arange(30)).astype(np.float32)
    want = np.linalg.svd(x)[2][:5]
    assert np.allclose(np.abs(np.sum(K.leading(x, 5).T * want, 1)), 1, atol=1e-3)
