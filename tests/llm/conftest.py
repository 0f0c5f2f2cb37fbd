import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row int, label string, own string, bin int, h1 string, seed int, _u_host string, node string, shard int"


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty, short and very long texts, repeated rows, and columns whose names clash with inner ones."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [None, "", " \n\t ", "One", "one two three", base, base, near, "Und " * 50, sentence(rng, 6000), "#### $$$$ %%%% " * 20, "A. | B | C | D |\nA. | B | C | D |", "Größe ÄÖ ’quoted’ – dash.  x", "no\x00null"[:2]]
    texts += [sentence(rng, rng.randrange(5, 90)) for _ in range(30)]
    texts += [sentence(rng, 20) + " " + " ".join(words[:50]) + " " + sentence(rng, 20)]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "x", 1, "l", "o", 2, "h", 3, "u", "n", 4) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, *rows[0][2:]), (None, None, *[None] * 13)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
