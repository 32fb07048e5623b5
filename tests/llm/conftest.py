"""Small tables with every awkward case: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, size string, words string, start string, key string, node string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = "the on er re an in th ed es ti at or st nd to nt of is it en".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows():
    base = prose(1, 200)
    w = base.split()
    near = " ".join([*w[:50], "changed", *w[51:]])
    far = " ".join(w[:100] + prose(2, 100).split())
    out = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, far, "en", None), (5, None, "en", "a"), (6, "", "de", "b"), (7, " \t\n", None, "b"),
        (8, "one two three", "en", "c"), (9, "ONE  Two\nthree", "en", "c"), (10, "one two three four", "en", "a"), (11, prose(3, 30_000), "en", "a"),
        (12, "é Ünï ça İ ς Σ", "fr", "a"), (13, "12 34 !!", "en", "a"), (14, prose(4, 300), None, "d"), (14, prose(4, 300), None, "d"), (None, base, "en", None),
        (-5, prose(5, 64), "es", "a"), (2**60 + 1, prose(6, 40), "en", "a"), (20, "word", "en", "a"),
    ]
    out += [(100 + i, prose(100 + i, 60), ("en", "de")[i % 2], "hot") for i in range(30)]
    return [(d, t, lang, s, len(t) if t is not None else None, "x", "y", "z", None, "k", "n") for d, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1], r[2], r[3]) for r in rows()]
