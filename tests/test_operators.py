import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fnatlas.functions.embedders import HashedEmbedder, embedding, purpose_text, register
from fnatlas.functions.vectors import cosine, jaccard
from fnatlas.operators import evaluation as E
from fnatlas.operators import learning as M
from fnatlas.operators import similarity as S
from fnatlas.plans import pipeline
from fnatlas.sources import trees
from fnatlas.streaming import labels as stream


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, (r.normal(size=8) + 4 * np.eye(8)[i % 3]).tolist(), i % 3, f"c{i % 3}") for i in range(90)] + [(90, [0.0] * 8, 0, "c0")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, name string").repartition(3)


def matrix(vectors):
    rows = sorted(vectors.collect(), key=lambda r: r["vec_id"])
    return np.array([r["embedding"] for r in rows]), np.array([r["cluster"] for r in rows])


def test_knn_blocks_match_numpy(vectors, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 20)
    x, _ = matrix(vectors)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n > 0, n, 1)
    sim = np.round(u @ u.T, S.DIGITS)
    np.fill_diagonal(sim, -np.inf)
    got = {}
    df = S.unit_vectors(vectors)
    for r in S.top_k(df, df, 4).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["c"]))
    for q in range(len(x)):
        assert [c for _, c in sorted(got[q])] == np.lexsort((np.arange(len(x)), -sim[q]))[:4].tolist()
    pairs = [(r["q"], r["c"]) for r in S.top_k(df, df, 5, pairs_once=True).collect()]
    iu = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x))]
    assert pairs == sorted(iu, key=lambda p: (-sim[p], p))[:5]


def test_similar_to_row(vectors):
    got = [r["vec_id"] for r in S.similar_to_row(vectors, 3, 5).collect()]
    assert 3 not in got and len(got) == 5
    with pytest.raises(ValueError):
        S.similar_to_row(vectors, 12345)


def test_overlap_and_summary(spark, vectors):
    df = S.unit_vectors(vectors.filter("vec_id < 90"))
    n = S.top_k(df, df, 3)
    labels = vectors.select(F.col("vec_id").alias("id"), F.array("name").alias("tags"))
    assert S.overlap_at_k(n, labels).agg(F.avg("overlap")).first()[0] > 0.9
    assert S.conflicting(n, labels, 2.0).count() == 0
    s = S.neighbour_summary(n, vectors.filter("vec_id < 0").select(F.col("vec_id").alias("id"), F.col("name").alias("text")))
    assert {r["summary"] for r in s.collect()} == {"Unknown purpose"}


def test_cosine_and_jaccard(spark):
    r = spark.sql("SELECT array(1D, 0D) a, array(0D, 0D) z, array('x', 'y') p, array('y') q, cast(array() as array<string>) e")
    got = r.select(cosine(F.col("a"), F.col("a")), cosine(F.col("a"), F.col("z")), jaccard(F.col("p"), F.col("q")), jaccard(F.col("q"), F.col("p")), jaccard(F.col("e"), F.col("e"))).first()
    assert tuple(got) == (1.0, 0.0, 0.5, 0.5, 0.0)


def test_classification_report(spark):
    rows = [(["a", "b"], ["a"]), (["b"], ["b", "c"]), (["a"], ["c"]), (["none"], ["none"])]
    df = spark.createDataFrame(rows, "y_true array<string>, y_pred array<string>")
    r = {x["class"]: x for x in E.classification_report(df).collect()}
    assert (r["a"]["precision"], r["a"]["recall"], r["a"]["support"]) == (1.0, 0.5, 2)
    assert r["c"]["precision"] == r["c"]["f1"] == 0 and r["c"]["support"] == 0
    assert r["micro avg"]["precision"] == pytest.approx(3 / 5) and r["micro avg"]["recall"] == pytest.approx(3 / 5)
    assert r["macro avg"]["f1"] == pytest.approx((2 / 3 + 2 / 3 + 0 + 1) / 4)
    assert r["samples avg"]["recall"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert E.subset_accuracy(df).first()["accuracy"] == 0.25


def test_silhouette_matches_numpy(vectors, monkeypatch):
    monkeypatch.setattr("fnatlas.operators.evaluation.BLOCK", 25)
    x, c = matrix(vectors)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        s.append((b - a) / max(a, b))
    assert E.silhouette(vectors, "vec_id", "embedding", "cluster").first()["silhouette"] == pytest.approx(np.mean(s), abs=1e-9)


def test_thresholds_and_status(spark):
    df = spark.createDataFrame([("a", 0.05, False), ("a", 0.35, True), ("a", 0.9, True), ("b", 0.01, True)], "class string, score double, truth boolean")
    got = {r["class"]: (r["threshold"], r["f1"]) for r in E.threshold_search(df).collect()}
    assert got == {"a": (0.1, 1.0), "b": (0.5, 0.0)}
    r = spark.sql("SELECT 1D a, 0.8D b, 0.9D c").select(E.overfit_status(F.col("a"), F.col("b")), E.overfit_status(F.col("b"), F.col("c")), E.overfit_status(F.col("a"), F.col("c"))).first()
    assert tuple(r) == ("OVERFITTING", "UNDERFITTING", "OK")


def test_models_learn_separable_classes(vectors):
    d = vectors.filter("vec_id < 90")
    for kind, options in (("lr", {}), ("svm", {"max_iter": 10}), ("rf", {"trees": 10, "max_depth": 5}), ("mlp", {"layers": (8,), "max_iter": 40})):
        model = M.train_single(d, "embedding", "name", kind, **options)
        assert M.predict_single(model, d, "embedding").filter("name = predicted").count() > 80, kind
    multi = d.withColumn("tags", F.when(F.col("vec_id") == 0, F.array("name", F.lit("rare"))).otherwise(F.array("name")))
    models = M.train_multilabel(multi, "embedding", "tags", max_iter=20)
    assert sorted(models) == ["c0", "c1", "c2"]
    assert M.predict_multilabel(models, multi, "embedding").filter(F.array_contains("predicted", F.col("name"))).count() > 80
    k = M.kmeans(d, "embedding", 3, n_init=4)
    assert k.groupBy("cluster").agg(F.count_distinct("name").alias("n")).agg(F.max("n")).first()[0] == 1
    assert M.adaptive_k(5) is None and M.adaptive_k(9) == 3 and M.adaptive_k(100) == 4
    assert max(M.silhouette_sweep(d, "vec_id", "embedding", 3, 2), key=lambda p: p[1])[0] == 3


def test_scaling_and_projection(vectors):
    x, _ = matrix(vectors)
    s = np.array([r["scaled"] for r in M.standard_scaled(vectors, "embedding").orderBy("vec_id").collect()])
    assert np.allclose(s, (x - x.mean(0)) / x.std(0))
    p, kept = M.pca_projected(vectors, "embedding", 2)
    y = np.array([r["pca"] for r in p.orderBy("vec_id").collect()])
    w = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(y), np.abs((x - x.mean(0)) @ w[2][:2].T), atol=1e-6) and kept == pytest.approx((w[1][:2] ** 2).sum() / (w[1] ** 2).sum())


def test_embedders(spark):
    class Ones:
        def embed_batch(self, codes):
            return np.ones((len(codes), 3))

    register("ones", Ones)
    df = spark.createDataFrame([("int f() { }",), (None,)], "code string")
    assert [list(r[0]) for r in df.select(embedding(F.col("code"), "ones")).collect()] == [[1.0] * 3] * 2
    v = HashedEmbedder().embed_batch(["int f(int a)", "int f(int a)", ""])
    assert np.allclose(v[0], v[1]) and math.isclose(np.linalg.norm(v[0]), 1) and not v[2].any()
    assert [r[0] for r in spark.sql("SELECT explode(array('', null, 'x')) p").select(purpose_text(F.col("p"))).collect()] == ["unknown purpose", "unknown purpose", "x"]


C_FILES = {
    "a/one.c": "#include <x.h>\nint initDevice(int n)\n{\n    if (n < 0) { return -1; }\n    printf(n);\n    return 0;\n}\n\nvoid free_all(void) { free(p); }\n",
    "b/two.c": "static int get_value(struct s *p) { return p->x; }\r\nint set_it(int a) { for (;;) { while (a) { a--; } } return a; }\r\n", "b/empty.c": "int x;\n", "b/skip.h": "int no(void) { }",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("src")
    for name, text in C_FILES.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_bytes(text.encode())
    (top / "b/bytes.c").write_bytes(b"int caf\xff(void) { return 1; }\n")
    for i in range(12):
        (top / f"b/gen{i}.c").write_text(f"int make_{i}(int a)\n{{\n" + ("    p = malloc(a);\n" if i % 2 else "    printf(a);\n") * (1 + i % 3) + ("    return -1;\n" if i % 3 else "    assert(a);\n") + "}\n")
    return str(top)


def test_pipeline_end_to_end(spark, tree, tmp_path):
    files = trees.read_tree(spark, tree)
    assert files.count() == 16 and not files.filter("content like '%\r%'").count()
    report = pipeline.run(spark, tree, str(tmp_path / "out")).first()
    assert report["dataset_stats"]["total_functions"] > 0
    loaded = trees.load_pipeline(spark, str(tmp_path / "out/pipeline"))
    rows, config, models = loaded
    assert rows.count() == 17 and config["embedder"] == "hashed" and set(config["singles"]) <= set(models)
    assert trees.load_pipeline(spark, str(tmp_path / "none")) is None
    got = {r["file_path"].rpartition("/")[2]: r for r in pipeline.analyzed(files).collect()}
    assert got["empty.c"]["warning"] and not got["empty.c"]["functions"]
    assert [f["name"] for f in got["one.c"]["functions"]] == ["initDevice", "free_all"]
    one = got["one.c"]["functions"][0]["predicted_labels"]
    assert one["side_effects"] == ["io"] and one["error_handling"] == "returns_code" and one["high_level_purpose"] == "Initializes device"
    assert [f["name"] for f in got["bytes.c"]["functions"]] == ["caf"]
    asked = pipeline.labeled_by(pipeline.extract_functions(files), lambda s: s.map(lambda c: '{"high_level_purpose": "Asked", "side_effects": ["io"]}'))
    assert {r[0] for r in asked.select("labels.high_level_purpose").collect()} == {"Asked"}


def test_labeled_json(spark, tree, tmp_path):
    df = pipeline.labeled(pipeline.extract_functions(trees.read_tree(spark, tree))).select("function_name", "function_code", "file_path", "labels")
    trees.write_labeled(df, str(tmp_path / "lab"))
    back = trees.read_labeled(spark, str(tmp_path / "lab"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "one.json").write_text(trees.labeled_array(df))
    assert len(json.loads((tmp_path / "one.json").read_text())) == df.count() == trees.read_labeled(spark, str(tmp_path / "one.json")).count()
    clean = trees.clean_labels(df, str(tmp_path / "clean"))
    assert not clean.filter("labels.complexity = 'high'").count()


def test_stream(spark, tree, tmp_path):
    fns = spark.createDataFrame([("f", "{ printf(1); }"), ("g", "{ }")], "function_name string, function_code string")
    fns.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(fns.schema).parquet(str(tmp_path / "in"))
    q = stream.effect_counts(stream.labeled_stream(s)).writeStream.format("memory").queryName("effects").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["effect"]: r["n"] for r in spark.table("effects").collect()} == {"io": 1, "none": 1}
    q = stream.file_stream(spark, tree).writeStream.format("memory").queryName("files").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("files").count() == 16


def test_whole_texts_are_embedded(spark):
    same = "x = y + 1; " * 400
    rows = [(1, same), (2, same + "later words differ"), (3, same + "in other ways")]
    got = [r["e"] for r in spark.createDataFrame(rows, "i int, t string").select("i", embedding(F.col("t")).alias("e")).orderBy("i").collect()]
    assert got[0] != got[1] and got[1] != got[2] and got[0] != got[2]


def test_stored_pipeline_labels_what_it_has_not_seen(spark, tree, tmp_path):
    """With a projection, scaling, tuned thresholds and a classifier for each label: stored, loaded, and used on other files."""
    out = str(tmp_path / "out")
    kinds = {"effects": "lr", "complexity": "rf", "errors": "lr"}
    report = pipeline.run(spark, tree, out, hardware=True, kind=kinds, pca_dims=4, threshold=0.3).first()
    assert "misclassified" in report["failure_text"] or "functions" in report["failure_text"]
    assert report["conflicting_pairs"] and all(0.3 < p["sim"] and p["q"] < p["c"] for p in report["conflicting_pairs"])
    p = pipeline.Predictor(spark, f"{out}/pipeline")
    assert p.config["kinds"] == kinds and p.config["thresholds"] and p.assembly.pca is not None and set(p.assembly.scaling) == {"hybrid_features", "ast_features"}
    # a function that was trained on gets the vector it had
    stored = {r["fn_id"]: r for r in p.rows.collect()}
    again = p.features(p.rows.select("fn_id", "function_name", "function_code", "file_path", "start_line")).collect()
    assert all(np.allclose(r["features"], stored[r["fn_id"]]["features"]) for r in again) and len(again) == 17
    assert {r["fn_id"]: r["predicted_effects"] for r in p.predicted(p.rows.select("fn_id", "function_name", "function_code")).collect()} == {k: r["predicted_effects"] for k, r in stored.items()}
    (tmp_path / "new").mkdir()
    (tmp_path / "new/unseen.c").write_text("int make_it(int a)\n{\n    p = malloc(a);\n    p = malloc(a);\n    return -1;\n}\n")
    files = trees.read_tree(spark, str(tmp_path / "new"))
    one = pipeline.analyzed(files, pipeline.predictor(spark, f"{out}/pipeline")).first()["functions"][0]
    assert one["predicted_labels"]["side_effects"] == ["memory"] and one["predicted_labels"]["control_flow_elements"] == ["return"]
    assert one["embedding_summary"] in {r["labels"]["high_level_purpose"] for r in stored.values()}
    rules = pipeline.analyzed(files, pipeline.predictor(spark, str(tmp_path / "none"))).first()["functions"][0]
    assert rules["predicted_labels"]["high_level_purpose"] == "Performs make it operation"
    text = trees.inference_json(pipeline.analyzed(files)).first()["json"]
    assert json.loads(text)["functions"][0]["name"] == "make_it" and "\n" in text and "\n" not in trees.inference_json(pipeline.analyzed(files), False).first()["json"]
    outside = pipeline.labeled(pipeline.extract_functions(files))
    assert p.scores(outside).first().asDict() == {"f1_macro": 1.0, "f1_micro": 1.0, "accuracy": 1.0}
    shown = pipeline.demo(spark, f"{out}/pipeline").collect()
    assert sorted(r["what"] for r in shown) == ["predicted"] * 3 + ["similar"] * 3
    # stages can be entered again
    assert pipeline.run(spark, "nowhere", out, skip_labeling=True, ast=False, strategy="columns", tune=False).first()["dataset_stats"]["total_functions"] > 0
    assert pipeline.Predictor(spark, f"{out}/pipeline").config["parts"] == ["embedding", "hybrid_features", "purpose_embedding"]
    assert pipeline.run(spark, "nowhere", out, skip_embedding=True).first()["dataset_stats"]["total_functions"] > 0


def test_language_model_labels_and_fallbacks(spark, tree):
    fns = pipeline.extract_functions(trees.read_tree(spark, tree))
    purposes = lambda df: {r[0] for r in df.select("labels.high_level_purpose").collect()}

    def ask(prompts):
        return prompts.map(lambda p: '{"high_level_purpose": "' + str("error_handling" in p and "Function:" in p) + '"}')

    def broken(prompts):
        raise OSError("no service")

    assert purposes(pipeline.labeled_by(fns, ask)) == {"True"} and purposes(pipeline.labeled_by(fns, connect=lambda: ask)) == {"True"}
    assert purposes(pipeline.labeled_by(fns, broken)) == {"Unknown"}
    rules = purposes(pipeline.labeled(fns))
    assert purposes(pipeline.labeled_by(fns)) == rules == purposes(pipeline.labeled_by(fns, connect=lambda: broken(None)))


def test_radial_kernel_and_thresholds(spark):
    r = np.random.default_rng(4)
    angle, far = r.uniform(0, 6.3, 300), np.arange(300) % 2
    rows = [(i, [float((1 + 2 * f) * math.cos(a)), float((1 + 2 * f) * math.sin(a))], f"ring{f}", [f"ring{f}"]) for i, (a, f) in enumerate(zip(angle, far.tolist()))]
    d = spark.createDataFrame(rows, "i int, v array<double>, name string, tags array<string>")
    right = lambda **o: M.predict_single(M.train_single(d, "v", "name", "svm", **o), d, "v").filter("name = predicted").count()
    assert right() > 290 and right(gamma=0.5, cosines=128) > 290 and right(kernel="linear") < 240
    models = M.train_multilabel(d, "v", "tags", "rf", trees=10, max_depth=4)
    t = M.tuned_thresholds(models, d, "v", "tags")
    assert sorted(t) == ["ring0", "ring1"] and all(0 < x < 1 for x in t.values())
    always = M.predict_multilabel(models, d, "v", thresholds={"ring0": 0.0, "ring1": 1.1})
    assert {tuple(x["predicted"]) for x in always.collect()} == {("ring0",)}
    some = d.withColumn("tags", F.when(F.col("i") == 0, F.array("name", F.lit("rare"))).otherwise(F.array("name")))
    assert sorted(M.train_multilabel(some, "v", "tags", "lr", strategy="columns", max_iter=5)) == ["rare", "ring0", "ring1"]
    assert M.best_k([(2, 0.5), (3, 0.7), (4, 0.7)]) == 3 and M.best_k([]) is None


def test_pooling(spark):
    from fnatlas.functions.embedders import KINDS, PooledEmbedder, factory, pooled, register_states

    hidden = np.arange(24.0).reshape(2, 3, 4)
    mask = np.array([[1, 1, 0], [0, 0, 0]])
    assert (pooled(hidden, mask, "first") == hidden[:, 0]).all()
    assert np.allclose(pooled(hidden, mask), [hidden[0, :2].mean(0), np.zeros(4)])
    seen = []

    def states(codes, limit):
        seen.append((len(codes), limit))
        return np.ones((len(codes), 2, 3)) * len(codes[0]), np.ones((len(codes), 2))

    e = PooledEmbedder(states, "x", 3, "mean", 100, 2)
    assert e.embed_batch(["a", None, "ccc"]).tolist() == [[1.0] * 3] * 2 + [[3.0] * 3] and seen == [(2, 100), (1, 100)] and e.embed_batch([]).shape == (0, 3)
    for kind, (how, limit, _) in KINDS.items():
        register_states(kind, lambda: states, 3)
        model = factory(kind)()
        assert (model.how, model.max_length) == (how, limit)
    df = spark.createDataFrame([("int f() { }",)], "code string")
    assert list(df.select(embedding(F.col("code"), "codebert")).first()[0]) == [11.0] * 3


def test_patterns_run_once(spark, sf):
    """Counting an array's elements doesn't evaluate the expressions that make it again."""
    from fnatlas.plans import catalog

    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    assert count(catalog.QUERIES["side_effect_distribution"](spark, sf)) == count(catalog.QUERIES["side_effects"](spark, sf)) > 0


def test_failure_text_has_all_steps(spark):
    """Counts, what failures have in common and why, and improvements, of all misclassified rows and not of those listed."""
    rows = [(i, "x" * (10 + i), ["a"], ["a"] if i >= 20 else ["b"]) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, text string, y_true array<string>, y_pred array<string>")
    assert E.failure_sizes(df, "text").first().asDict() == {"n_failing": 20, "mean_length": 19.5, "usual_length": 29.5}
    overlap = spark.createDataFrame([(0, 0.5)], "q long, overlap double")
    clusters = spark.createDataFrame([(0, 40, 1.0)], "cluster int, n long, purity double")
    conflicts = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.95)], "q long, c long, sim double")
    said = lambda d, c: E.report(d, overlap, clusters, E.misclassified(d, "text", "k"), conflicts=c, sizes=E.failure_sizes(d, "text")).first()["failure_text"]
    parts = said(df, conflicts).split("\n\n")
    assert parts[0].startswith("20 functions were misclassified. 2 pairs")
    assert [p.split(":")[0] for p in parts[1:]] == ["Classification failures", "Similarity failures", "Recommended improvements"]
    assert "20 characters long on average, all functions 30." in parts[1] and "shorter than usual" in parts[1] and parts[1].count("\n- ") == 3
    assert parts[2].count("\n- ") == 3 and parts[3].count("\n") == 3
    fine = said(df.filter("k >= 20"), conflicts.filter("q < 0")).split("\n\n")
    assert fine[0] == "0 functions were misclassified. No pair above the threshold has other labels." and fine[1].startswith("Recommended") and len(fine) == 2
