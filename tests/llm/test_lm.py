import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fnatlas.llm import lm

from .conftest import DOCS, prose


def check(rows, texts):
    tok = [(d, [*((t or "").encode().lower().split()), b""]) for d, t, *_ in texts]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter()
    for d, w in tok:
        if not held(d):
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for d, w in tok)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-5)


def test_counts_and_base(docs, texts):
    rows = lm.scored(docs).collect()
    check(rows, texts)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def test_beats_the_base_on_held_out_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lm.scored(d).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in d.collect()])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_no_training_documents(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.scored(spark.createDataFrame([(held, "a b", None, None, None, *"abcdef")], DOCS)).collect()
    assert [(x["n_tokens"], x["n_known"], x["train_tokens"], x["score"]) for x in r] == [(3, 0, 0, 0.0)]


def test_empty(no_docs):
    assert lm.scored(no_docs).collect() == []


@pytest.fixture(scope="module")
def model():
    text = prose(9, 3000).encode().split()
    c = Counter(text)
    tail = np.zeros(lm.TAIL, np.int64)
    for x in c.values():
        tail[x.bit_length() - 1] += x
    top = sorted(((w, k) for w, k in c.items() if k > 1), key=lambda p: (-p[1], p[0]))[: lm.TOP_WORDS]
    return lm.Model(len(text), len(c), top, 10, tail, sum(x == 1 for x in c.values())), c


def test_many_words_at_once(model):
    m, c = model
    words = [*c, lm.END, b"once"]
    counts = np.array([*c.values(), 10, 1])
    for n, got in enumerate(zip(*m.of_all(words, counts), strict=True)):
        want = m.of(words[n - 1], int(counts[n - 1])) if n else (lm.UNSEEN, lm.UNSEEN, 0.0)
        assert got[:2] == want[:2] and got[2] == pytest.approx(want[2])


def test_probabilities_sum_to_one(model):
    """Over all words of the vocabulary, the end and the unseen word, whatever the state."""
    m, c = model
    h = np.random.default_rng(0).normal(size=lm.HIDDEN)
    s = h @ m.w + m.c
    p = np.exp(s - s.max())
    p = (1 - lm.FLOOR) * p / p.sum() + lm.FLOOR * m.prior
    total = p[lm.UNSEEN] + p[1]
    for w, k in c.items():
        _, cls, log = m.of(w, k)
        total += p[cls] * 10**log
    empty = sum(p[k] for k in range(2, len(p)) if m.mass[k] <= 0)
    assert total + empty == pytest.approx(1, abs=1e-3)


def test_state_is_carried_over_windows(model):
    """Scores don't depend on which documents go together, nor on the window's length."""
    m, c = model
    r = np.random.default_rng(1)
    docs = [r.integers(0, 60, n) for n in (1, 5, 100, 33, 64)]
    cls = [r.integers(0, 50, len(d)) for d in docs]
    together = m.class_scores(docs, cls)
    for d, k, t in zip(docs, cls, together, strict=True):
        h, one = np.zeros((1, lm.HIDDEN), np.float32), []
        for prev, y in zip([lm._END_IN, *d[:-1]], k, strict=True):
            h = m.step(np.array([prev]), h)[0]
            s = (h @ m.w + m.c)[0]
            p = np.exp(s - s.max())
            one.append(np.log10((1 - lm.FLOOR) * p[y] / p.sum() + lm.FLOOR * m.prior[y]))
        assert np.allclose(one, t, atol=1e-4)


def test_gradient_descends(model):
    m, _ = model
    x = np.tile(np.arange(2, 26), (4, 4))
    y = np.roll(x, -1, 1)
    losses = m.fit(x, y, epochs=30)
    assert losses[-1] < losses[0] / 2


def test_learns_from_all_documents(spark, monkeypatch):
    """What follows what is seen in few tokens of the sample, but in every training document, in blocks of several rounds."""
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 1)
    monkeypatch.setattr(lm, "TRAIN_BYTES", 20_000, raising=False)
    r = np.random.default_rng(7)
    ring = [f"w{i:02d}" for i in range(40)]  # each word tells the next
    rows = [(i, " ".join(ring[(a + j) % 40] for j in range(100))) for i, a in enumerate(r.integers(0, 40, 900))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lm.scored(d).collect()
    check(got, rows)
    held = [x for x in got if x["held_out"]]
    assert sum(x["score"] for x in held) > 0.7 * sum(x["base_score"] for x in held)


def test_every_training_token_is_gone_through(spark, docs):
    counts = lm.counted(docs)
    model = lm.untrained(counts)
    size = 400_000
    assert lm.trained(model, lm.encoded(docs, counts, model, size), size).learned == model.n > 0


def test_units_sum_to_one(model):
    """With the state-dependent softmax within classes too, over all words, the end and the unseen word."""
    m, c = model
    words = [(w, *m.of(w, k)) for w, k in c.items()] + [(lm.END, 1, 1, 0.0), (b"new", 0, 0, 0.0)]
    for first in (5, 40, 300):  # the token before, which tells the state
        units = [np.array([first, u]) for _, u, _, _ in words]
        got = m.class_scores(units, [m.class_of[u] for u in units], units)
        total = sum(10 ** (g[1] + share) for g, (_, _, _, share) in zip(got, words, strict=True))
        empty = sum(m.prior[k] for k in range(2, len(m.mass)) if m.mass[k] <= 0)
        assert total == pytest.approx(1 - empty, abs=0.02)
    spread = [10 ** float(g[1]) for g in got]
    assert len(set(np.round(spread, 9))) > 100


def test_gradients_match_differences(model):
    m = model[0].with_parameters(model[0].parameters())
    for k in lm.NAMES:
        setattr(m, k, getattr(m, k).astype(np.float64))
    r = np.random.default_rng(3)
    units = r.choice(np.r_[1:60, len(m.class_of) - 300 : len(m.class_of)], (3, 7))
    x = np.roll(units, 1, 1)
    h = r.normal(0, 0.3, (3, lm.HIDDEN))
    _, grads, _ = m.gradients(x, m.class_of[units], units, h)
    for k in lm.NAMES:
        a = getattr(m, k)
        flat = grads[k].ravel()
        for i in np.r_[np.argsort(-np.abs(flat))[:3], r.integers(0, a.size, 2)].tolist():
            at = np.unravel_index(i, a.shape)
            old, loss = a[at], []
            for d in (1e-5, -1e-5):
                a[at] = old + d
                loss.append(m.gradients(x, m.class_of[units], units, h)[0])
            a[at] = old
            assert flat[i] == pytest.approx((loss[0] - loss[1]) / 2e-5 / 3, rel=1e-4, abs=1e-7), k


def test_lexing_and_blocks(spark, docs, texts, monkeypatch):
    """Numbers come back as they went, and scores of words don't depend on how documents are dealt to blocks."""
    n = np.array([0, 1, 255, 256, 70_000, 2**24 + 5], np.int32)
    assert (lm.unplaned(lm.planes(n)) == n).all()
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 4)
    counts = lm.counted(docs.repartition(7))
    model = lm.untrained(counts)
    one = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["share"], 9), bytes(r["codes"])) for r in lm.encoded(docs, counts, model, 10).collect())
    counts = lm.counted(docs.coalesce(1))
    assert [sorted(model.top), model.n, model.v] == [sorted(lm.untrained(counts).top), lm.untrained(counts).n, lm.untrained(counts).v]
    two = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["share"], 9), bytes(r["codes"])) for r in lm.encoded(docs, counts, model, 10).collect())
    assert one == two and len(one) == len(texts)


def test_words_of_a_batch_are_those_of_each_text():
    import pyarrow as pa

    texts = [None, "", " A\u00c4b\tc  ", "x", "\x1cY\x1f Z\x0b\x0c\r\n", "\u00a0\u2003 q", "end", "Start", " "]
    for some in (texts, texts[:2], [], ["abc"]):
        words, n = lm.words_in(pa.array(["zz z", *some], pa.string())[1:])
        assert words.to_pylist() == [w for t in some for w in lm.words_of(t)] and n.tolist() == [len(lm.words_of(t)) for t in some]


def test_the_sample_is_chosen_without_the_texts_codes(spark):
    rows = [(i, (b"%05d" % i) * 2 * (1 + i % 900) + b"\1\0") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, codes binary")
    got = lm.sampled(d).collect()
    want = d.select(F.xxhash64("doc_id", "codes").alias("h"), "codes").orderBy("h", "codes").limit(lm.SAMPLE_DOCS).collect()
    assert [r["h"] for r in got] == [r["h"] for r in want]
    for r, w in zip(got, want, strict=True):
        codes, at = bytes(w["codes"]), zlib.crc32(bytes(w["codes"])) % max(1, len(w["codes"]) // 2 - lm.SAMPLE_TOKENS + 1)
        assert bytes(r["codes"]) == codes[2 * at : 2 * (at + lm.SAMPLE_TOKENS)]
