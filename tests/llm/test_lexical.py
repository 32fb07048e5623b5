"""Ranked search against plain scoring of every document, and packed numbers against themselves."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from fnatlas.llm import lexical, packed

from .conftest import DOCS, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, most=50):
    docs = [(d, terms(t)) for d, t in documents]
    docs = [(d, w) for d, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in asked.items():
        found = []
        for d, w in docs:
            m = 50 + (50 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in words if t in df)
            if score > 0:
                found.append((d, score))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(i, k + 1, d, s) for k, (d, s) in enumerate(found[:most])]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def items():
    return [(1, prose(1, 40)), (1, "word"), (2, None), (3, " -- !"), (4, "zzz"), (5, "THE é Ünï the"), (None, "12 34"), (7, prose(104, 60)), (8, prose(3, 3000))]


def test_awkward_rows(spark, docs, texts, items):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score long")
    assert result(lexical.ranked(docs, df)) == brute([(d, t) for d, t, *_ in texts], items)


def test_small_shards_blocks_and_joins_by_shuffle(spark, docs, texts, items, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lexical, "SPAN", 4)
    index = lexical.indexed(docs, 500)
    assert index.select("shard").distinct().count() > 10
    df = spark.createDataFrame(items, "item_id long, text string")
    assert result(lexical.search(index, df, 5, 30)) == brute([(d, t) for d, t, *_ in texts], items, 5)
    assert result(lexical.search(index, df, 1, 1)) == brute([(d, t) for d, t, *_ in texts], items, 1)


def test_ties_keep_smaller_ids(spark):
    rows = [(d, "same words here") for d in (9, -2, 2**60, 4, 4, None)]
    got = result(lexical.ranked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([("a", "words")], "item_id string, text string")))
    assert [(r, d) for _, r, d, _ in sorted(got, key=lambda x: x[1])] == [(1, -2), (2, 4), (3, 4), (4, 9), (5, 2**60), (6, None)]


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.ranked(docs, none).count() == lexical.ranked(no_docs, none).count() == 0
    assert lexical.ranked(no_docs, spark.createDataFrame([(1, "word")], "item_id long, text string")).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.ranked(spark.createDataFrame([(1, None), (2, "--"), (3, "")], "doc_id long, text string"), spark.createDataFrame([(1, "word")], "item_id long, text string")).count() == 0
    assert set(DOCS.split()) >= {"text"}


def test_heaps_against_sums():
    r = random.Random(5)
    cursors = []
    for _ in range(12):
        docs = np.array(sorted(r.sample(range(6000), r.randint(1, 3000))))
        cursors.append((docs, np.array([r.randint(0, 30) for _ in docs])))
    total = np.zeros(6000, int)
    for d, s in cursors:
        total[d] += s
    want = sorted(((int(s), -d) for d, s in enumerate(total) if s), reverse=True)[:40]
    assert sorted(lexical.best_of(cursors, 40), reverse=True) == want


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_packed_numbers(x):
    data, at = packed.coded(np.array(x, np.uint64))
    assert packed.read(data.tobytes()).tolist() == x and len(at) == len(x) + 1 and at[-1] == len(data)


@given(st.lists(st.integers(-(2**63), 2**63 - 1)))
def test_steps(x):
    assert packed.from_steps(packed.read(packed.coded(packed.steps(np.array(x, np.int64)))[0].tobytes())).tolist() == x
