"""Every registered query of the engine against its SQL oracle, and the contract without the optional subpackage."""

import inspect
import subprocess
import sys

import duckdb
import pytest

from fnatlas.operators import clustering, mlp
from fnatlas.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) and a.equals(b)


@pytest.mark.parametrize("name", ["ast_features", "hashed_embedding", "analyze_file", "kmeans_clusters", "pca_project", "train_lr", "evaluation_report"])
def test_rows_only(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_features_vary(spark, sf):
    for name in ("features_base20", "features_hw20"):
        r = catalog.QUERIES[name](spark, sf).toPandas()
        assert [c for c in r.columns if r[c].nunique() < 2] == []


def test_entry_without_the_subpackage():
    code = """
import sys
class Block:
    def find_spec(self, name, *a):
        if name.startswith("fnatlas.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert e.queries() and not [k for k in e.queries() if k.startswith("op") or k == "pipeline"] and set(e.oracle_sql()) <= set(e.queries())
"""
    root = __file__.rsplit("/tests/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0


def test_sweep_has_every_k(spark, sf):
    assert sorted(r["k"] for r in catalog.QUERIES["silhouette_by_k"](spark, sf).collect()) == list(range(2, 9))


def test_models_are_of_full_size(spark, sf, monkeypatch):
    """Ten starts, and the forest, the network and the machine as large and as long as in production."""
    made, starts = {}, []

    class Stop(Exception):
        pass

    def classifier(kind, *a, make=catalog.M.classifier, **options):
        made[kind] = make(kind, *a, **options)
        raise Stop

    def rounds(self, work):
        raise Stop

    def spread(pool, k, rng, make=clustering.spread_start):
        starts.append(make(pool, k, rng))
        return starts[-1]

    monkeypatch.setattr(catalog.M, "classifier", classifier)
    monkeypatch.setattr(clustering, "spread_start", spread)
    for kind in ("svm", "rf"):
        with pytest.raises(Stop):
            catalog.QUERIES[f"train_{kind}"](spark, sf)
    fitted = mlp.Perceptron.fitted
    monkeypatch.setattr(mlp.Perceptron, "fitted", staticmethod(lambda *a, **o: made.update(mlp=inspect.signature(fitted).bind(*a, **o)) or fitted(*a, **o)))
    with monkeypatch.context() as m, pytest.raises(Stop):
        m.setattr(mlp.Packed, "summed", rounds)
        catalog.QUERIES["train_mlp"](spark, sf)
    made["mlp"].apply_defaults()
    svm = made["svm"].getClassifier() if hasattr(made["svm"], "getClassifier") else made["svm"]
    assert svm.getMaxIter() == 50 and (made["rf"].getNumTrees(), made["rf"].getMaxDepth()) == (100, 20)
    assert (made["mlp"].arguments["layers"], made["mlp"].arguments["max_rounds"]) == ((256, 128), 500)
    catalog.QUERIES["kmeans_clusters"](spark, sf)
    assert len({x.tobytes() for x in starts}) == len(starts) == 10


def test_functions_are_dealt_over_tasks(spark, sf, tmp_path):
    """A key is a few bytes and a function made of it is much work: one small file of keys must not be one task, nor its rows lie in a few."""
    spark.range(20000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for d in (catalog.c_functions(spark, str(tmp_path)), catalog.QUERIES["ast_counts"](spark, str(tmp_path))):
        sizes = d.select(catalog.F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]
        assert len(sizes) == spark.sparkContext.defaultParallelism and sizes.max() < 20000 / len(sizes) * 1.2


@pytest.mark.parametrize(("name", "searches"), [("classification_report", 1), ("split_metrics", 1), ("evaluation_report", 1)])
def test_neighbours_are_searched_once(spark, sf, monkeypatch, name, searches):
    """However many figures a report has: products are counted while it runs."""
    made, once = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    top_k = catalog.S.top_k
    top_k(*[catalog.units(spark, sf)] * 2, 1, digits=6, products=once).count()
    monkeypatch.setattr(catalog.S, "top_k", lambda *a, **o: top_k(*a, **o, products=made))
    assert catalog.QUERIES[name](spark, sf).collect()
    assert made.value == searches * once.value > 0
