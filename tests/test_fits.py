"""Fits that go through packed rows: regressions of all labels together, and k-means of many starts."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fnatlas.operators import evaluation as E
from fnatlas.operators import gridsearch as G
from fnatlas.operators import joint
from fnatlas.operators import learning as M
from fnatlas.operators import packed
from fnatlas.operators.clustering import Clusterings, spread_start
from fnatlas.operators.joint import JointLogistic


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(7)
    x = r.normal(0, 1, (400, 5))
    w = r.normal(0, 1, (5, 3))
    rows = []
    for i, (v, z) in enumerate(zip(x, x @ w + r.normal(0, 1, (400, 3)) - [0, 0.5, 2], strict=True)):
        rows.append((i, v.tolist(), [c for c, s in zip("abc", z, strict=True) if s > 0]))
    return spark.createDataFrame(rows, "i int, v array<double>, tags array<string>").repartition(5).cache()


@pytest.mark.parametrize("balanced", [True, False])
def test_joint_equals_separate_fits(spark, labelled, balanced):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"joint-{balanced}", "joint")
    got = JointLogistic.fitted(labelled, "v", "tags", ["a", "b", "c"], c=0.5, balanced=balanced, tol=1e-9)
    n_jobs = len(jobs.getJobIdsForGroup(f"joint-{balanced}"))
    spark.sparkContext.setJobGroup("other", "other")
    assert n_jobs <= got.passes + 8  # a job for each pass, not for each label
    for k, c in enumerate(got.classes):
        d = labelled.withColumn("y", F.array_contains("tags", c).cast("double")).withColumn("x", array_to_vector("v"))
        yes = d.filter("y = 1").count()
        weight = F.when(F.col("y") == 1, 400 / (2 * yes)).otherwise(400 / (2 * (400 - yes))) if balanced else F.lit(1.0)
        m = LogisticRegression(regParam=1 / (0.5 * 400), standardization=False, maxIter=500, tol=1e-12, featuresCol="x", labelCol="y", weightCol="w").fit(d.withColumn("w", weight))
        assert np.allclose(m.coefficients.toArray(), got.coef[:, k], atol=1e-4) and abs(m.intercept - got.intercept[k]) < 1e-4


def test_softmax_in_the_same_passes(spark, labelled):
    d = labelled.withColumn("one", F.when(F.array_contains("tags", "a"), "x").when(F.array_contains("tags", "b"), "y").otherwise("z"))
    held = F.col("i") % 4 == 0
    heads = [joint.Head("tags", ["a", "b", "c"], rows=~held), joint.Head("one", ["x", "y", "z"], one=True)]
    many, one = joint.fitted(d, "v", heads, tol=1e-9)
    alone = JointLogistic.fitted(d.filter(~held), "v", "tags", ["a", "b", "c"], tol=1e-9)
    assert np.allclose(many.coef, alone.coef, atol=1e-5) and np.allclose(many.intercept, alone.intercept, atol=1e-5)
    n = {r["one"]: r["count"] for r in d.groupBy("one").count().collect()}
    w = F.lit(400 / 3) / F.when(F.col("one") == "x", n["x"]).when(F.col("one") == "y", n["y"]).otherwise(n["z"])
    y = F.when(F.col("one") == "x", 0.0).when(F.col("one") == "y", 1.0).otherwise(2.0)
    m = LogisticRegression(family="multinomial", regParam=1 / 400, standardization=False, maxIter=500, tol=1e-12, featuresCol="x", labelCol="y", weightCol="w").fit(d.select(array_to_vector("v").alias("x"), y.alias("y"), w.alias("w")))
    assert np.allclose(m.coefficientMatrix.toArray().T, one.coef, atol=1e-4)
    assert np.allclose(m.interceptVector.toArray() - m.interceptVector.toArray().mean(), one.intercept - one.intercept.mean(), atol=1e-4)
    got = one.chosen(d, "v")
    assert got.filter("one = predicted").count() > 280
    assert all(abs(sum(r["s"]) - 1) < 1e-9 for r in one.with_scores(d, "v", "s").collect())


def test_gradients_lead_to_the_minimum(labelled):
    """At the coefficients found, finite differences of the objective are zero."""
    got = JointLogistic.fitted(labelled, "v", "tags", ["a", "b", "c"], tol=1e-9)
    rows = labelled.collect()
    x, y = np.array([r["v"] for r in rows]), np.array([[t in r["tags"] for t in "abc"] for r in rows])

    def objective(w, b, k):
        z, t = x @ w + b, y[:, k]
        weight = np.where(t, len(x) / (2 * t.sum()), len(x) / (2 * (~t).sum()))
        return (weight * (np.logaddexp(0, z) - t * z)).sum() / weight.sum() + (w @ w) / (2 * weight.sum())

    for k in range(3):
        for p in range(6):
            e = np.eye(6)[p] * 1e-4
            up, down = (objective(got.coef[:, k] + s * e[:5], got.intercept[k] + s * e[5], k) for s in (1, -1))
            assert abs(up - down) / 2e-4 < 1e-6


def test_joint_predictions(spark, labelled):
    got = JointLogistic.fitted(labelled, "v", "tags", M.trainable(labelled, "tags"))
    d = got.predicted(labelled, "v")
    assert d.columns == ["i", "v", "tags", "predicted"]
    right = d.filter(F.array_sort("predicted") == F.when(F.size("tags") > 0, F.array_sort("tags")).otherwise(F.array(F.lit("none")))).count()
    assert right > 200
    again = JointLogistic.of_dict(got.as_dict())
    assert sorted(map(str, again.predicted(labelled, "v").collect())) == sorted(map(str, d.collect()))
    assert {tuple(r["predicted"]) for r in got.predicted(labelled, "v", thresholds={"a": 0.0, "b": 1.1, "c": 1.1}).collect()} == {("a",)}
    t = got.tuned(labelled, "v", "tags")
    assert sorted(t) == ["a", "b", "c"] and all(0 < x < 1 for x in t.values())
    assert {tuple(r["predicted"]) for r in JointLogistic([], np.zeros((0, 0)), np.zeros(0)).predicted(labelled, "v").collect()} == {("none",)}
    some = labelled.withColumn("tags", F.when(F.col("i") == 3, F.array(F.lit("rare"), F.lit("all"))).otherwise(F.array(F.lit("all"))))
    assert M.trainable(some, "tags") == [] and M.trainable(some, "tags", "columns") == ["rare"]


def test_sums_of_many_partitions_are_added_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packed, "PART_BYTES", 16)
    monkeypatch.setattr(packed, "FAN", 4)
    df = spark.range(300).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"), "id").repartition(40, "id")
    with packed.Packed(df, "v", F.array((F.col("id") % 2).cast("double")), F.col("id")) as p:
        assert (p.rows, p.width) == (300, 2) and p.blocks.rdd.getNumPartitions() > 4
        assert p.summed(lambda x, y, k: np.r_[x.sum(0), y.sum(), k.sum()]).tolist() == [44850.0, 300.0, 150.0, 44850.0]


def clouds(seed, n=240):
    r = np.random.default_rng(seed)
    at = r.normal(0, 6, (4, 3))
    return at[np.arange(n) % 4] + r.normal(0, 0.5, (n, 3))


def plain_kmeans(x, k, starts, pool):
    """Cost of the best start, by the plainest code."""
    best = np.inf
    for s in range(starts):
        c = spread_start(pool, k, np.random.default_rng((42, k, s)))
        for _ in range(300):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
            moved, c = ((new - c) ** 2).sum(), new
            if moved <= 1e-4 * x.var(0).mean():
                break
        best = min(best, ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    return best


def test_every_start_of_every_k_in_the_same_passes(spark):
    x = clouds(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(6)
    spark.sparkContext.setJobGroup("starts", "starts")
    got = Clusterings.fitted(df, "id", "v", [2, 3, 4, 5], 10)
    n_jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("starts"))
    spark.sparkContext.setJobGroup("other", "other")
    assert n_jobs <= got.passes + 12
    order = [r["id"] for r in df.orderBy(F.xxhash64("id", F.lit(42)), "id").collect()]
    for k in (2, 3, 4, 5):
        assert len(got.costs[k]) == 10 and abs(min(got.costs[k]) - plain_kmeans(x, k, 10, x[order])) < 1e-6
    d = got.assigned(df, "v").collect()
    for r in d:
        for k, c in zip((2, 3, 4, 5), r["clusters"], strict=True):
            assert c == ((got.centres[k] - r["v"]) ** 2).sum(1).argmin()
    assert len({(i["id"] % 4, i["clusters"][2]) for i in d}) == 4  # the clouds are found


def test_more_clusters_than_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(6)], "id long, v array<double>")
    got = Clusterings.fitted(df, "id", "v", [4], 3)
    assert min(got.costs[4]) < 1e-9


def test_silhouettes_of_many_clusterings(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 50)  # several cells
    x = clouds(2, 120)
    r = np.random.default_rng(1)
    labels = np.stack([np.arange(120) % 4, r.integers(0, 3, 120), np.r_[9, np.zeros(119, int)]], axis=1)
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, labels.tolist(), strict=True))], "id long, v array<double>, c array<int>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for w in range(3):
        s = []
        for i in range(120):
            own = labels[:, w] == labels[i, w]
            if own.sum() == 1:
                s.append(0.0)
                continue
            a = d[i, own].sum() / (own.sum() - 1)
            b = min(d[i, labels[:, w] == o].mean() for o in set(labels[:, w]) - {labels[i, w]})
            s.append((b - a) / max(a, b))
        want.append(np.mean(s))
    got = {x["which"]: x["silhouette"] for x in E.silhouettes(df, "id", "v", "c").collect()}
    assert np.allclose([got[i] for i in range(3)], want)


def test_sweep_chooses_the_clouds(spark):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clouds(3))], "id long, v array<double>")
    got = M.silhouette_sweep(df, "id", "v")
    assert [k for k, _ in got] == list(range(2, 9)) and M.best_k(got) == 4


def test_oversampling(spark):
    from fnatlas.operators.sampling import oversampled

    r = np.random.default_rng(5)
    rows = [(i, r.normal(0, 1, 4).tolist(), "big" if i < 60 else "small" if i < 83 else "lone") for i in range(84)]
    x = {i: np.array(v) for i, v, _ in rows}
    name = {i: c for i, _, c in rows}
    extra = [(None, [1.0] * 4, "small"), (200, None, "small"), (201, [1.0] * 4, None)]
    df = spark.createDataFrame(rows + extra, "id long, v array<double>, class string").repartition(3)
    got = oversampled(df, "id", "v", "class", k=3).collect()
    made = [g for g in got if g["made_of"] is not None]
    assert len(got) - len(made) == 87
    assert {c: sum(g["class"] == c for g in made) for c in ("big", "small", "lone")} == {"big": 0, "small": 37, "lone": 59}
    unit = {i: v / np.linalg.norm(v) for i, v in x.items()}
    for g in made:
        a, b = g["made_of"], g["towards"]
        assert name[a] == name[b] == g["class"] and np.allclose(g["v"], x[a] + g["share"] * (x[b] - x[a]))
        if g["class"] == "small":
            others = sorted((i for i in x if name[i] == "small" and i != a), key=lambda i: (-round(float(unit[a] @ unit[i]), 9), i))
            assert b in others[:3]
    starts = [g["made_of"] for g in made if g["class"] == "small"]
    assert max(map(starts.count, starts)) == 2 and len(set(starts)) == 23  # dealt evenly
    again = oversampled(df.repartition(7), "id", "v", "class", k=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sum(g["class"] == "small" for g in oversampled(df, "id", "v", "class", upto=30).collect() if g["made_of"] is not None) == 7
    assert oversampled(df.filter("false"), "id", "v", "class").count() == 0


def test_a_save_that_breaks_off_leaves_the_version_before(spark, tmp_path):
    from fnatlas.plans import pipeline
    from fnatlas.sources import trees

    folder = f"file://{tmp_path}/p"
    rows = spark.range(3)

    class Broken:
        def write(self):
            raise OSError("no space")

    assert trees.load_pipeline(spark, folder) is None
    with pytest.raises(OSError):
        trees.save_pipeline(rows, {"a": 0}, folder, {"m": Broken()})
    assert trees.load_pipeline(spark, folder) is None
    trees.save_pipeline(rows, {"a": 1}, folder)
    with pytest.raises(OSError):
        trees.save_pipeline(spark.range(9), {"a": 2}, folder, {"m": Broken()})
    got, config, _ = trees.load_pipeline(spark, folder)
    assert config["a"] == 1 and got.count() == 3
    trees.save_pipeline(spark.range(5), {"a": 3}, folder)
    got, config, _ = trees.load_pipeline(spark, folder)
    assert config["a"] == 3 and got.count() == 5 and len(list((tmp_path / "p").iterdir())) == 1
    # one that can't be loaded: rules label
    fns = spark.createDataFrame([("f", "{ printf(1); }")], "function_name string, function_code string")
    assert pipeline.predictor(spark, folder)(fns).first()["labels"]["side_effects"] == ["io"]


def test_no_query_needs_the_package_on_workers():
    """From another folder and without PYTHONPATH, each in a session of its own."""
    import os
    import subprocess
    import sys

    code = """
import sys
sys.path.insert(0, sys.argv[1])
from fnatlas.plans import catalog
from fnatlas.session import session
for name in sys.argv[2:]:
    s = session(4, 4)
    assert catalog.QUERIES[name](s, "/root/testdata/sf0.001").count() > 0, name
    s.stop()
"""
    root = __file__.rsplit("/tests/", 1)[0]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = ["hashed_embedding", "ast_features", "functions_in_sql", "knn_top5", "silhouette", "kmeans_clusters", "multilabel_binary"]
    r = subprocess.run([sys.executable, "-c", code, root, *names], cwd="/", env=env, capture_output=True, text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]


@pytest.mark.parametrize("one", [True, False])
def test_perceptron_gradients(one):
    from fnatlas.operators import mlp

    r = np.random.default_rng(2)
    of = mlp.shapes(4, (6, 5), 3)
    flat, x = mlp.start(of, 1), r.normal(0, 1, (9, 4))
    y = np.eye(3)[r.integers(0, 3, 9)] if one else (r.random((9, 3)) < 0.4).astype(float)
    _, g = mlp.gradients(flat, of, x, y, one, 0.3)
    for i in r.choice(len(flat), 40, replace=False):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        slope = (mlp.gradients(flat + e, of, x, y, one, 0.3)[0] - mlp.gradients(flat - e, of, x, y, one, 0.3)[0]) / 2e-6
        assert abs(slope - g[i]) < 1e-6 * max(1, abs(slope))


def test_perceptron_learns_and_stops(spark, monkeypatch):
    from fnatlas.operators import mlp

    r = np.random.default_rng(4)
    x = r.normal(0, 1, (900, 2))
    ring = (np.linalg.norm(x, axis=1) > 1.1).astype(int)
    rows = [(i, v.tolist(), f"ring{c}", [f"ring{c}"] if c else []) for i, (v, c) in enumerate(zip(x, ring.tolist(), strict=True))]
    df = spark.createDataFrame(rows, "i int, v array<double>, name string, tags array<string>")
    options = {"layers": (24,), "rate": 0.02, "max_rounds": 150, "tol": 0.01}
    model = mlp.Perceptron.fitted(df.filter("i < 600"), "v", "name", ["ring0", "ring1"], **options)
    test = df.filter("i >= 600")
    assert model.predicted(test, "v").filter("name = predicted").count() > 280
    assert min(model.held_losses) < 0.3 * model.held_losses[0]
    last = model.held_losses[-11:]
    assert model.rounds < 150 and all(b > a - 0.01 for a, b in zip(last, last[1:], strict=False))  # it stopped after ten rounds of little gain
    # several blocks, dealt in any way, give one result
    monkeypatch.setattr(packed, "ROWS", 100)
    two = [mlp.Perceptron.fitted(df.filter("i < 600").coalesce(1), "v", "name", ["ring0", "ring1"], **(options | {"max_rounds": 30})) for _ in range(2)]
    assert np.array_equal(two[0].flat, two[1].flat)
    assert two[0].predicted(test, "v").filter("name = predicted").count() > 270
    many = mlp.Perceptron.fitted(df.filter("i < 600"), "v", "tags", ["ring1"], one=False, **(options | {"rate": 0.05, "tol": 1e-4}))
    assert many.predicted(test, "v").filter(F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("none"))) == F.col("predicted")).count() > 280


@pytest.mark.parametrize("one", [False, True])
def test_grid_search(spark, labelled, one):
    """Scores of all points and folds equal those of separate fits; with points dropped on the way the same point is best."""
    d = labelled.withColumn("one", F.when(F.array_contains("tags", "a"), "x").when(F.array_contains("tags", "b"), "y").otherwise("z"))
    column, classes = ("one", ["x", "y", "z"]) if one else ("tags", ["a", "b", "c"])
    grid = [G.Point(c, b) for c in (1e-4, 1e-2, 1.0) for b in (True, False)]
    full = G.searched(d, "i", "v", column, classes, grid, one, rounds=(), max_iter=300, tol=1e-8)
    fold = F.conv(F.substring(F.md5(F.concat(F.col("i").cast("string"), F.lit("-42")).cast("binary")), 1, 8), 16, 10).cast("long") % 3
    mean = {}
    for _, p, f, _, n, f1 in full.scores:
        mean.setdefault(p, []).append(f1)
        if p in (1, 4):
            m = joint.fitted(d.filter(fold != f), "v", [joint.Head(column, classes, one)], grid[p].c, grid[p].balanced, 300, 1e-8)[0]
            held = d.filter(fold == f)
            got = (m.chosen(held, "v") if one else m.predicted(held, "v")).select(column, "predicted").collect()
            assert len(got) == n
            sets = [({t} if one else set(t), {g} if one else set(g)) for t, g in got]
            each = [(sum(c in t and c in g for t, g in sets), sum((c in t) != (c in g) for t, g in sets)) for c in classes]
            assert abs(f1 - np.mean([2 * tp / max(1, 2 * tp + off) for tp, off in each])) < 1e-9
    best = max(range(len(grid)), key=lambda p: (round(np.mean(mean[p]), 9), -p))
    assert full.best == grid[best] and len(full.scores) == 18
    whole = joint.fitted(d, "v", [joint.Head(column, classes, one)], full.best.c, full.best.balanced)[0]
    assert np.allclose(whole.coef, full.model.coef, atol=1e-2)
    spark.sparkContext.setJobGroup(f"grid-{one}", "grid")
    halved = G.searched(d, "i", "v", column, classes, grid, one, refit=False)
    n_jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grid-{one}"))
    spark.sparkContext.setJobGroup("other", "other")
    assert halved.best == full.best and {r: sum(x[0] == r for x in halved.scores) // 3 for r in range(3)} == {0: 6, 1: 3, 2: 2}
    assert n_jobs <= max(x[3] for x in halved.scores) + 10  # a job for each pass, whatever the grid
    assert halved.table(spark, grid).filter("best").select("point").distinct().count() == 1


def test_grid_search_of_odd_rows(spark, labelled):
    d = labelled.withColumn("one", F.when(F.col("i") % 3 == 0, "x").when(F.col("i") % 3 == 1, "y"))
    d = d.union(d.filter("i < 20")).withColumn("i", F.when(F.col("i") > 5, F.col("i")))  # null labels, null keys, repeated rows
    got = G.searched(d, "i", "v", "one", ["x", "y"], [G.Point()], one=True)
    assert got.best == G.Point() and sum(n for r, _, _, _, n, _ in got.scores if r == 0) == d.filter("one is not null").count()
    assert G.searched(d, "i", "v", "one", [], [G.Point(2.0)], one=True) == G.Found(G.Point(2.0), None, [])
    with pytest.raises(ValueError, match="no rows"):
        G.searched(d.limit(0), "i", "v", "one", ["x"], [G.Point()], one=True)
    with pytest.raises(ValueError, match="no point"):
        G.searched(d, "i", "v", "one", ["x"], [])


def test_silhouettes_shuffle_a_vector_once_for_each_tile(spark, monkeypatch):
    """Rows reach the cells of tiles as they are, and a row of sums for each leaves them, however many blocks a tile has."""
    monkeypatch.setattr(E, "BLOCK", 25)
    r = np.random.default_rng(3)
    x, c = r.normal(0, 1, (600, 4)), np.arange(600) % 3
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "id long, v array<double>, c int")
    sums, sizes = E._distance_sums(df, "id", "v", E.F.array("c"))
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = np.stack([d[:, c == k].sum(1) for k in range(3)], axis=1)
    got = {s["id"]: s["totals"] for s in sums.collect()}
    assert sizes == [(0, k, 200) for k in range(3)] and np.allclose([got[i] for i in range(600)], want)
    cells = [s for s in plan.split("\n") if "FlatMapGroupsInArrow" in s]
    assert len(cells) == 1 and "collect_list" not in plan


def test_a_forest_is_fitted_some_trees_at_a_time(spark, monkeypatch):
    """No fit holds more trees than the driver's share of nodes, all trees vote, and the classes are right."""
    from pyspark.ml.classification import RandomForestClassifier

    from fnatlas.operators import forest

    monkeypatch.setattr(forest, "NODES", 1600)
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (200, 4))
    df = spark.createDataFrame([(i, v.tolist(), "a" if v[0] > 0 else "b") for i, v in enumerate(x)], "id long, v array<double>, name string")
    sizes, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, d: sizes.append((self.getNumTrees(), self.getSeed())) or fit(self, d))
    got = forest.predicted(df, df, "v", "name", trees=10, max_depth=6).collect()
    assert [n for n, _ in sizes] == [4, 4, 2] and len({s for _, s in sizes}) == 3
    assert len(got) == 200 and np.mean([g["name"] == g["predicted"] for g in got]) > 0.97


def test_long_sums_reach_the_driver_as_one_row(spark):
    """However many partitions there are; the sums are the same."""
    from fnatlas.operators.packed import Packed

    df = spark.createDataFrame([([float(i)],) for i in range(1000)], "v array<double>").repartition(9)
    with Packed(df, "v") as rows:
        rows.blocks = rows.blocks.repartition(9).persist()
        taken, of = [], type(rows.blocks).collect
        try:
            type(rows.blocks).collect = lambda self: taken.append(of(self)) or taken[-1]
            got = []
            for rows.numbers in (0, 300_000):
                got.append(rows.summed(lambda x, _, __: np.full(100_000, x.sum())))
        finally:
            type(rows.blocks).collect = of
    assert [g[0] for g in got] == [999 * 500.0] * 2 and len(taken[0]) > 1 and len(taken[1]) == 1


def test_machines_of_many_classes_are_fitted_at_once():
    """A pass over few rows leaves most cores idle, so those of several classes go side by side."""
    assert M.classifier("svm", 4, 5).getParallelism() > 1
