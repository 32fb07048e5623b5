import numpy as np

from fnatlas.llm import hnsw


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, shard string")


def brute(x, ids, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    d[ids == q] = np.inf
    return ids[np.lexsort((ids, d))[:k]]


def test_recall_over_shards_and_levels(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 24)).astype(np.float32)
    x[400:700] = x[400]  # a very common vector
    ids = np.arange(1500) * 5
    v = hnsw.stored(hnsw.usable(frame(spark, [(int(i), a.tolist()) for i, a in zip(ids, x)])), "v")
    got = hnsw.searched(hnsw.built(v, 300), v.filter("vec_id % 100 = 0"), block=16).toPandas()
    hit = total = 0
    xd = x.astype(float)
    for q, g in got.groupby("query_id"):
        want = brute(xd, ids, q)
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and q not in set(g["vec_id"])
        assert np.allclose(g["score"], [np.sqrt(((xd[ids == q][0] - xd[ids == i][0]) ** 2).sum()) for i in g["vec_id"]], atol=1e-12)
        hit += len(set(want) & set(g["vec_id"]))
        total += 10
    assert got["query_id"].nunique() == 75 and hit / total >= 0.95


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.1]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (7, []), (200, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [1.0, -0.1])]
    got = hnsw.neighbours(frame(spark, rows)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by == {0: [8, 100, 6], 100: [0, 8, 6]}  # 8 and 100 are as near: the smaller id first


def test_empty(spark):
    assert hnsw.neighbours(frame(spark, [])).collect() == []


def test_repeated_rows_and_ids(spark):
    """Copies take no places: each row twelve times, and a near id with 300 vectors of its own."""
    r = np.random.default_rng(4)
    x = r.normal(size=(20, 6)).astype(np.float32)
    rows = [(i * 50, a.tolist()) for i, a in enumerate(x) for _ in range(12)]
    d = lambda q, t: np.sqrt(((x[q].astype(float) - x[t].astype(float)) ** 2).sum())
    got = {}
    for g in sorted(hnsw.neighbours(frame(spark, rows)).collect(), key=lambda g: (g["query_id"], g["rank"])):
        got.setdefault(g["query_id"], []).append(g["vec_id"])
    assert got == {q * 50: [t * 50 for t in sorted(set(range(20)) - {q}, key=lambda t: d(q, t))[:10]] for q in range(0, 20, 2)}
    crowd = [(7, (x[0] + 1e-3 * r.normal(size=6)).astype(np.float32).tolist()) for _ in range(300)]
    one = sorted((g for g in hnsw.neighbours(frame(spark, rows + crowd)).collect() if g["query_id"] == 0), key=lambda g: g["rank"])
    assert [g["vec_id"] for g in one] == [7, *got[0][:9]]


def test_many_ties(spark):
    """398 candidates at distance exactly 1: the smallest ids, nearest ones first."""
    r = np.random.default_rng(5)
    axes = [(s * np.eye(200)[i]).tolist() for i in range(200) for s in (1.0, -1.0)]
    rows = [(int(i), np.add(v, np.ones(200) * 3).tolist()) for i, v in zip(r.permutation(np.arange(1, 401)), axes)]
    rows = [(i if i % 100 else i + 1000, v) for i, v in rows] + [(100, [3.0] * 200), (777, np.r_[3.5, [3.0] * 199].tolist())]
    got = sorted(hnsw.neighbours(frame(spark, rows), 100).collect(), key=lambda g: (g["query_id"], g["rank"]))
    one = [(g["vec_id"], g["score"]) for g in got if g["query_id"] == 100]
    assert one == [(777, 0.5), *((i, 1.0) for i in range(1, 10))]


def test_recall_on_a_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in v.collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got, hit = hnsw.neighbours(v).toPandas(), 0
    for q, g in got.groupby("query_id"):
        hit += len(set(brute(x, ids, q)) & set(g["vec_id"]))
    assert hit >= 0.9 * len(got) and len(got) == 10 * sum(i % 100 == 0 for i in ids)


def test_query_id_of_several_vectors(spark):
    """A candidate's score is the smallest distance from any of the query id's vectors, however rows are dealt."""
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 5))
    rows = [(100, x[0].tolist()), (100, x[1].tolist()), (100, x[1].tolist())] + [(i, x[i].tolist()) for i in range(2, 60)]
    want = sorted((min(float(np.sqrt(((x[q] - x[i]) ** 2).sum())) for q in (0, 1)), i) for i in range(2, 60))[:10]
    for parts in (1, 4):
        got = sorted(hnsw.neighbours(frame(spark, rows).repartition(parts)).filter("query_id = 100").collect(), key=lambda g: g["rank"])
        assert [g["vec_id"] for g in got] == [i for _, i in want] and np.allclose([g["score"] for g in got], [s for s, _ in want], atol=1e-6)
