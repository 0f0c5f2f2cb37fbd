import re

import pytest

from weftline.llm import quality_rules as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    inside = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    base = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), base


def test_counts(messy):
    for r in Q.judge(messy).select("text", "_q_.*").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.text
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize(
    "line, stays",
    [
        ("A sentence that ends well.", True),
        ("“Quoted speech.” She left", True),
        ("no mark at all here", False),
        ("Home | About | Blog | Contact.", False),
        ("BUY!! NOW!! CHEAP!! YES!!", False),
        ("Wor%%% d$$$ s*** e###.", False),
        ("We use it. Read our Privacy Policy.", False),
    ],
)
def test_lines(spark, line, stays):
    good = "The first sentence says something.\nAnother one follows it soon.\nThen a third, with a comma, comes.\nNobody minds a fourth one here."
    r = Q.judge(spark.createDataFrame([(f"{good}\n{line}",)], "text string")).select("_q_.*").first()
    assert r.kept and (line in r.clean_text) == stays


def test_rejects_what_loses_too_much(spark):
    text = "A fine first sentence stays here.\n" + "\n".join(f"menu item number {i} of many" for i in range(8))
    assert not Q.judge(spark.createDataFrame([(text,)], "text string")).first()["_q_"].kept


def test_clean_keeps_columns(messy, empty):
    out = Q.clean(messy)
    assert out.columns == messy.columns
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert Q.clean(empty).count() == 0


def test_marks_of_other_scripts_and_phrases_in_prose(spark):
    """Lines of scripts with other sentence marks, or none, pass; phrases fail short lines of four languages, not paragraphs."""
    good = ["这是一个很长的句子。", "यह एक वाक्य है। और", "هل هذه جملة؟", "นี่คือประโยคหนึ่ง", "To log in he had to find the key that his brother had hidden long ago under the stone."]
    bad = ["Log in to read.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "no mark here"]
    for lines, fails in ((good, 0), (bad, 5)):
        r = Q.judge(spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string")).first()["_q_"]
        assert r.n_lines_failed == fails, r
