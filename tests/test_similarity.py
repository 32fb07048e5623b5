"""Exact neighbours and pairs through many tiles: against numpy, and how much of the products bounds save."""

import numpy as np
import pytest

from fnatlas.operators import similarity as S


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(11)
    at = r.normal(0, 1, (24, 12))
    x = at[np.arange(1200) % 24] + r.normal(0, 0.15, (1200, 12))
    x[1190:1195] = x[5]  # equal vectors
    x[1195:] = 0
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n > 0, n, 1)
    return u, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "id long, v array<double>").repartition(4)


def plain(u, k, only=None):
    sim = np.round(u @ u.T, 9)
    np.fill_diagonal(sim, -np.inf)
    out = {}
    for q in range(len(u)) if only is None else only:
        order = np.lexsort((np.arange(len(u)), -sim[q]))[:k]
        out[q] = [(int(c), round(float(sim[q, c]), 6)) for c in order]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["q"], r["rank"])):
        out.setdefault(r["q"], []).append((r["c"], round(r["sim"], 6)))
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 40)
    monkeypatch.setattr(S, "TILE", 3)


def test_neighbours_and_products(spark, clustered, small):
    u, df = clustered
    products = spark.sparkContext.accumulator(0)
    assert got(S.top_k(df, df, 5, products=products)) == plain(u, 5)
    assert 0 < products.value < len(u) ** 2 / 2


def test_vectors_and_queries_are_shuffled_once(clustered, small):
    _, df = clustered
    plan = S.top_k(df, df, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2 and "Repartition" not in plan.split("FlatMapGroupsInArrow")[0]


def test_pairs(spark, clustered, small):
    u, df = clustered
    sim = np.round(u @ u.T, 9)
    x, y = np.triu_indices(len(u), 1)
    order = np.lexsort((y, x, -sim[x, y]))[:30]
    products = spark.sparkContext.accumulator(0)
    rows = S.top_k(df, df, 30, pairs_once=True, products=products).collect()
    assert [(r["q"], r["c"]) for r in rows] == list(zip(x[order].tolist(), y[order].tolist(), strict=True))
    assert products.value < len(u) ** 2 / 2


def test_some_queries_against_all(clustered, small):
    u, df = clustered
    assert got(S.top_k(df.filter("id % 97 = 3"), df, 7)) == plain(u, 7, [i for i in range(1200) if i % 97 == 3])


def test_few_rows_and_none(spark, clustered):
    u, df = clustered
    assert got(S.top_k(df.filter("id < 3"), df.filter("id < 3"), 10)) == plain(u[:3], 2)
    none = df.filter("id < 0")
    assert S.top_k(df, none, 3).collect() == [] and S.top_k(none, df, 3).collect() == [] and S.top_k(none, none, 3, pairs_once=True).collect() == []
    assert S.top_k(df, none, 3).columns == ["q", "c", "sim", "rank"]


def test_bounds_hold():
    r = np.random.default_rng(3)
    for scale in (1e-9, 1e-3, 0.3, 3.0):
        v = r.normal(0, 1, 8) + r.normal(0, scale, (50, 8))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        b = S._Block(np.arange(50), v)
        q = np.concatenate([v, r.normal(0, 1, (20, 8))])
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        assert (b.bound(q)[:, None] >= q @ v.T - 1e-12).all()


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("known", [False, True])
def test_few_products_are_made_in_double(monkeypatch, copies, known):
    """Those that single precision leaves in question; with large groups of copies whole blocks. The hits are those of double precision."""
    r = np.random.default_rng(5)
    v = r.normal(0, 1, (1200, 16))
    if copies:
        v[::2] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    blocks = [S._Block(np.arange(a, a + 400), v[a : a + 400]) for a in range(0, 1200, 400)]
    exact, einsum = [], np.einsum
    monkeypatch.setattr(S.np, "einsum", lambda f, a, b: exact.append(len(a)) or einsum(f, a, b))
    want = plain(v, 4, range(400))
    floor = np.array([want[q][-1][1] for q in range(400)]) - 1e-6 if known else np.full(400, -np.inf)
    (q, c, s), _ = S.nearest_in(blocks[0], floor, blocks, 4, 9)
    found = {}
    for x, y, z in zip(q, c, s, strict=True):
        found.setdefault(int(x), []).append((int(y), round(float(z), 6)))
    assert found == want
    assert copies or 0 < sum(exact) < 400 * 1200 / 20


def test_a_length_is_computed_once_for_a_vector(spark):
    d = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None)], "vec_id long, embedding array<double>")
    u = S.unit_vectors(d)
    assert {r["id"]: r["v"] for r in u.collect()} == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: None}
    plan = u._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "sqrt" in plan and "/ sqrt" not in plan  # which would be in the lambda of a place


def test_leaves_are_left_out(spark, clustered, monkeypatch):
    """Blocks that hold several groups: of these only the near ones are gone through."""
    u, df = clustered
    monkeypatch.setattr(S, "BLOCK", 400)
    monkeypatch.setattr(S, "LEAF", 20)
    products = spark.sparkContext.accumulator(0)
    assert got(S.top_k(df, df, 5, products=products)) == plain(u, 5)
    assert 0 < products.value < len(u) ** 2 / 2


@pytest.mark.parametrize("k", [1, 3])
def test_equal_vectors_are_searched_once(spark, clustered, small, k):
    u, _ = clustered
    v = u.copy()
    v[600:1100] = u[:500]  # pairs of copies
    v[1100:1150] = u[7]  # a group of more than k + 1
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(4)
    alone, products = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    want = plain(v, k)
    assert got(S.top_k(df, df, k, products=alone)) == want
    assert got(S.top_k_of_all(df, S.copies(df, k), k, products=products)) == want
    assert 0 < products.value < alone.value * 2 / 3
