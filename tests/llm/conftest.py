import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, text2 string"


def prose(rng, n, syllables="the of an on er th st ing re ha to in ed or".split()):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls, empty and long texts, repeated rows, ties of the id, copies, shared passages, odd characters."""
    rng = random.Random(3)
    passage = prose(rng, 70)
    long_text = prose(rng, 30_000)
    texts = [None, "", " \n\t ", "x", "word", "ünï çödé 漢字 🙂 text", "a" * 3000, "ab" * 700, long_text]
    texts += [prose(rng, rng.randint(20, 300)) for _ in range(25)]
    texts += [prose(rng, 60) + " " + passage + " " + prose(rng, 40) for _ in range(4)]
    texts += [texts[12], texts[12], texts[13] + " more", long_text + " end"]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or ""), 0.5, i, "x") for i, t in enumerate(texts)]
    rows += [rows[10], rows[11], rows[11]]  # repeated rows
    rows += [(5, prose(rng, 30), "en", "s", 1, None, None, None), (None, prose(rng, 60), "fr", None, None, None, None, None),
             (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
