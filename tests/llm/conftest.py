import random

import pytest

WORDS = "alpha beta gamma delta river stone cloud green seven lamp paper glass north sound quick bread mouse table light field".split()


@pytest.fixture
def documents(spark):
    """Makes a documents table, with columns whose names the operators use inside."""

    def make(rows):
        clashing = "bucket bigint, rep bigint, key string, size int, component bigint, owner bigint, places string, `all` string, rank int, words int"
        return spark.createDataFrame([(*r, *[None] * 10) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + clashing)

    return make


@pytest.fixture
def sentence():
    def make(rng: random.Random, n: int) -> str:
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make


EDGES = [
    (None, "one two three four five six seven", "en", "s", 1),
    (None, None, None, None, None),
    (900, None, "en", None, None),
    (901, "", "en", "s", 0),
    (902, " \n\t ", "en", "s", 3),
    (903, "one", "en", "s", 3),
    (904, "one", "en", "s", 3),
    (905, "1234 5678 !!", "en", "s", 3),
    (906, "long " * 30000, "en", "s", 150000),
    (907, "z" * 5000, "en", "s", 5000),
    (908, "same row twice in this little table", "en", "s", 3),
    (908, "same row twice in this little table", "en", "s", 3),
    (909, "<|endoftext|> </s> \\ \u0000 é 漢字 🙂 ", "fr", "s", 3),
]


@pytest.fixture
def edges():
    return list(EDGES)


@pytest.fixture
def one_each():
    """Row counts by id agree between input rows and a result."""

    def check(rows, df):
        got = sorted((r["doc_id"] is not None, r["doc_id"]) for r in df.collect())
        assert got == sorted((r[0] is not None, r[0]) for r in rows)

    return check
