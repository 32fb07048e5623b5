import random

import numpy as np

from fnatlas.llm import graph, minhash

from .conftest import prose


def brute(rows):
    sets = {}
    for d, t, *_ in rows:
        w = t.encode().lower().split() if t else []
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [d for d in sets if d is not None and sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def check(spark, df, rows):
    want = brute(rows)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        n, root = want[r["doc_id"]]
        assert (r["n_shingles"], r["component_id"]) == (n, root), r
        assert r["kept"] == (r["doc_id"] == root)


def test_matches_brute_force(spark, docs, texts):
    check(spark, docs, texts)


def test_group_of_near_copies(spark):
    """Copies with up to five edits each: buckets hold many components, and links between members that aren't the smallest."""
    r = random.Random(5)
    base = prose(50, 150).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(i % 6):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_empty_table(spark, no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []
    assert minhash.deduplicated(no_docs).columns == no_docs.columns


def test_deduplicated_keeps_one_of_each_group(docs, texts):
    want = brute(texts)
    out = minhash.deduplicated(docs).collect()
    ids = [r["doc_id"] for r in out]
    assert sorted(ids, key=str) == sorted({d for d, (_, root) in want.items() if d == root}, key=str)
    assert all(r["h"] == "x" and r["key"] == "k" for r in out)


def test_sketch_agreement_estimates_similarity():
    r = np.random.default_rng(0)
    diffs = []
    for _ in range(40):
        both, a, b = (r.integers(1, 2**63, n, dtype=np.uint64) for n in (300, 60, 60))
        x, y = np.unique(np.r_[both, a]), np.unique(np.r_[both, b])
        diffs.append((minhash.sketch(x) == minhash.sketch(y)).mean() - 300 / 420)
    assert abs(np.mean(diffs)) < 0.02
    for n in (1, 2, 7):  # every coordinate is filled, however small the set
        assert len(np.unique(minhash.sketch(r.integers(1, 2**63, n, dtype=np.uint64)))) >= n


def test_components_of_a_path_and_cycle(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_threshold_is_a_parameter(spark):
    """Pairs with 0.80 <= J < 0.85 are linked at 80 percent and not at 85; pairs below 0.80 at neither."""
    rows, want = [], set()
    for i in range(20):
        w = prose(900 + i, 1004).split()  # 1000 shingles
        cut = 905 if i % 2 else 870
        tail = prose(950 + i, 1004 - cut).split()
        a, b = " ".join(w), " ".join(w[:cut] + tail)
        x, y = (set(minhash.shingles(t).tolist()) for t in (a, b))
        j = len(x & y) / len(x | y)
        assert 0.81 < j < 0.83 if i % 2 else 0.74 < j < 0.78, j
        rows += [(2 * i, a), (2 * i + 1, b)]
        want |= {2 * i} if i % 2 else {2 * i, 2 * i + 1}
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in minhash.deduplicated(d, 80).collect()} == want
    assert {r["doc_id"] for r in minhash.deduplicated(d).collect()} == {d for d, _ in rows}
    assert minhash.band_rows(85) == 5 and minhash.band_rows(80) == 4


def test_cells_of_several_blocks(spark, monkeypatch):
    """Buckets of several blocks of members: links between members that aren't the smallest, few of them returned."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(6)
    base = prose(60, 120).split()
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(1 + i % 7):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((5000 - i, " ".join(w)))
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_a_forest_joins_what_the_links_join():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 60, 300), r.integers(0, 60, 300)
    kept = minhash._forest(a, b, np.arange(300))

    def parts(at):
        of = {i: {i} for i in range(60)}
        for i in at:
            both = of[a[i]] | of[b[i]]
            for n in both:
                of[n] = both
        return {frozenset(x) for x in of.values()}

    assert parts(kept) == parts(range(300)) and len(kept) == 60 - len(parts(kept))


def test_one_id_with_two_texts(spark):
    """Versions of one document: the copies of each are in its component, and one row of it stays."""
    one, two, other = prose(70, 80), prose(71, 80), prose(72, 80)
    rows = [(3, one), (7, one), (7, two), (9, two), (11, other), (12, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(d).collect())
    assert got == [(3, 76, 3, True), (7, 76, 3, False), (7, 76, 3, False), (9, 76, 3, False), (11, 76, 11, True), (12, 0, 12, True)]
    assert sorted(r["doc_id"] for r in minhash.deduplicated(d).collect()) == [3, 11, 12]


def test_hot_set_and_hub(spark):
    """A third of the rows in one set, and a node that most others link with."""
    rows = [(i, prose(80, 40)) for i in range(100, 150)] + [(i, prose(i, 40)) for i in range(100)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    links = [(0, i) for i in range(1, 300)] + [(i, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (None, 3)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {0: 0, 5000: 5000, 5001: 5000, **{i: 0 for i in range(1, 300)}, **{1000 + i: 0 for i in range(1, 300)}}
