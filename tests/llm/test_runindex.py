"""Repeated passages against a dictionary of all windows, and the run-length index against plain suffix comparison."""

import hashlib
import random

import numpy as np
import pytest

from fnatlas.llm import runindex as R

from .conftest import DOCS


def brute(rows):
    key = lambda d: (d is None, d or 0)
    first, out = {}, []
    raws = [(d, (t or "").encode("utf-8", "surrogatepass")) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - 99):
            w, at = raw[i : i + 100], (key(d), i)
            if w not in first or at < first[w]:
                first[w] = at
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if (key(d), i) > first[raw[i : i + 100]]:
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda x: (key(x[0]), x[1:]))


def result(df):
    return sorted((tuple(x) for x in df.collect()), key=lambda x: ((x[0] is None, x[0] or 0), x[1:]))


def patchwork(seed, n=120):
    """Texts of shared passages cut anywhere, periodic runs, bytes 0, accents, repeated and null ids."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé\0\n ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    bank = [prose(r.randint(10, 80)) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            kind = r.random()
            if kind < 0.5:
                b = r.choice(bank)
                a = r.randint(0, len(b) // 2)
                parts.append(b[a : r.randint(a, len(b))])
            elif kind < 0.6:
                parts.append(r.choice("ab ") * r.randint(1, 400))
            elif kind < 0.7:
                parts.append("abcab" * r.randint(1, 100))
            else:
                parts.append(prose(r.randint(1, 60)))
        rows.append((r.choice([None, 5, 2**62, -3]) if r.random() < 0.15 else i, None if r.random() < 0.03 else "".join(parts)))
    return rows + r.sample(rows, 8)


def test_against_all_windows(spark):
    rows = patchwork(1)
    assert result(R.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


@pytest.mark.parametrize(
    "sizes",
    [
        {},  # several segments, buckets and cells; texts in overlapping parts
        {"HOT": 1},  # windows instead of an index
        {"LOCAL_HOT": 1, "VERY_HOT": 2},  # found before the buckets
    ],
)
def test_every_way_gives_the_same(spark, monkeypatch, sizes):
    for k, v in ({"SEGMENT_BYTES": 3000, "BUCKET_BYTES": 20_000, "CELL_BYTES": 2000, "CHUNK": 700} | sizes).items():
        monkeypatch.setattr(R, k, v)
    rows = patchwork(2, 80)
    assert result(R.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def test_awkward_rows(docs, texts, no_docs):
    assert result(R.without_repeats(docs)) == brute([(d, t) for d, t, *_ in texts])
    assert R.without_repeats(no_docs).count() == 0


def test_kept_bytes(spark):
    a, b = "x" + "passage of some length, " * 10, "other words. " * 12
    rows = [(1, a), (2, b + a)]
    got = {r["doc_id"]: r["kept"] for r in R.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()}
    want = {d: h for d, *_, h in brute(rows)}
    assert {d: hashlib.sha256(k).hexdigest() for d, k in got.items()} == want
    assert len(got[2]) < len(b)


def test_a_hundred_bytes_and_one_less(spark):
    p = "".join(chr(33 + i % 90) for i in range(100))
    rows = [(1, "A" + p + "B"), (2, "C" + p + "D"), (3, "E" + p[:99] + "\n"), (4, p)]
    got = {r[0]: r[2:4] for r in result(R.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {1: (0, 0), 2: (100, 1), 3: (0, 0), 4: (100, 1)}


def cell_text(seed):
    r = random.Random(seed)
    base = bytes(r.choice(b"ab\0c") for _ in range(300))
    parts = []
    for _ in range(30):
        a = r.randint(0, 150)
        p = bytearray(base[a : a + r.randint(101, 150)])
        if r.random() < 0.5:
            p[r.randrange(len(p))] = r.choice(b"ab\0c")
        parts.append(bytes(p))
    return b"".join(p + b"\xff" for p in parts), np.cumsum([len(p) + 1 for p in parts]) - 1


@pytest.mark.parametrize("seed", range(4))
def test_runs_and_matching_statistics(seed):
    text, ends = cell_text(seed)
    suffix = lambda p: text[p : text.index(b"\xff", p)]
    places = sorted((p for p in range(len(text)) if text[p] != 255), key=lambda p: (suffix(p), p))
    index, rem = R.run_index(text, ends)
    assert [len(suffix(p)) for p in range(len(text))] == rem.tolist()
    starts = np.cumsum(np.r_[0, index.length[:-1]])
    assert index.first.tolist() == [places[i] for i in starts] and index.last.tolist() == [places[i - 1] for i in (starts + index.length)]
    chars = np.repeat(index.char, index.length)
    assert chars.tolist() == [256 if p == 0 or text[p - 1] == 255 else text[p - 1] for p in places]
    assert len(index.char) < len(places)  # the passages repeat
    before, common = R.matching_statistics(index, len(text))
    for q, p in zip(places, places[1:], strict=False):
        a, b = suffix(q), suffix(p)
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert (before[p], common[p]) == (q, n)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_windows(seed):
    text, ends = cell_text(seed)
    value = np.random.default_rng(seed).permutation(len(text)) // 2
    least = {}
    whole = [p for p in range(len(text)) if b"\xff" not in text[p : p + 100] and p + 100 <= len(text)]
    for p in whole:
        least[text[p : p + 100]] = min(value[p], least.get(text[p : p + 100], 1 << 60))
    got = R.repeated_windows(text, ends, value)
    assert np.flatnonzero(got).tolist() == [p for p in whole if value[p] > least[text[p : p + 100]]]


def test_equal_windows_have_equal_anchors():
    r = random.Random(3)
    p = bytes(r.choice(b"abcd ") for _ in range(400))
    texts = [bytes(r.choice(b"xyz") for _ in range(k)) + p for k in (3, 57, 200)]
    of = []
    for t in texts:
        start, win, key = R.pieces(t, np.array([0, len(t)]))
        assert win.sum() == len(t) - 99 and (start[1:] == (start + win)[:-1]).all()
        of.append(np.repeat(key, win)[len(t) - len(p) :].tolist())
    assert of[0] == of[1] == of[2]


def test_other_columns_dont_matter(spark):
    rows = [(1, "s" * 150, *["x"] * 3, 1, *["y"] * 5)]
    df = spark.createDataFrame([(r[0], r[1], "en", "a", 3, "h", "s", "w", "st", "k", "n") for r in rows], DOCS).withColumnRenamed("h", "spans").withColumnRenamed("key", "version")
    assert result(R.without_repeats(df)) == brute([(1, "s" * 150)])
