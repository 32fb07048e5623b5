"""The command line over a small tree, model options, and embedders that can't be loaded."""

import json

import pytest

from fnatlas import __main__ as cli
from fnatlas.functions import embedders
from fnatlas.plans import pipeline


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("src")
    for i in range(24):
        body = ("    p = malloc(a);\n" if i % 2 else "    printf(a);\n") * (1 + i % 3) + ("    for (;;) { while (a) { if (b) { switch (c) { } } } }\n" if i % 4 == 0 else "") + ("    return -1;\n" if i % 3 else "    assert(a);\n")
        (top / f"gen{i}.c").write_text(f"int make_{i}(int a)\n{{\n{body}}}\n")
    return str(top)


def test_run_and_infer(spark, tree, tmp_path, capsys):
    out = str(tmp_path / "out")
    args = ["run", tree, out, "--kind", "effects=mlp", "complexity=rf", "errors=lr", "--trees", "7", "--max-depth", "4", "--layers", "12", "--max-rounds", "60", "--learning-rate", "0.02", "--test-percent", "25", "--conflicts-of", "5", "--threshold", "0.1", "--c", "3"]
    assert cli.main(args, spark) == 0
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert report["dataset_stats"]["total_functions"] > 0
    p = pipeline.Predictor(spark, f"{out}/pipeline")
    assert p.config["joint"]["effects"]["layers"] == [12] and p.models["complexity"].stages[-2].getNumTrees == 7 and "coef" in p.config["joint"]["errors"]
    seen = {r["fn_id"]: r["predicted_effects"] for r in p.rows.collect()}
    assert {r["fn_id"]: r["predicted_effects"] for r in p.predicted(p.rows.select("fn_id", "function_name", "function_code")).collect()} == seen
    assert sum(r["predicted_effects"] == r["effects"] for r in p.rows.collect()) > 15
    share = p.rows.filter("split = 'test'").count() / p.rows.count()
    assert 0 < share < 0.6
    assert cli.main(["infer", tree, "--pipeline", f"{out}/pipeline", "--compact"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines() if x.startswith("{")]
    assert len(lines) == 24 and lines[0]["functions"][0]["predicted_labels"]["side_effects"]
    assert cli.main(["infer", tree, "--pipeline", str(tmp_path / "none"), "--output", str(tmp_path / "json")], spark) == 0
    assert spark.read.json(str(tmp_path / "json")).count() == 24
    # penalties by grid search, from the stage tables that are there
    assert cli.main(["run", tree, out, "--skip-labeling", "--skip-embedding", "--grid", "0.01", "1", "10", "--max-iter", "40"], spark) == 0
    assert set(pipeline.Predictor(spark, f"{out}/pipeline").config["c"].values()) <= {0.01, 1.0, 10.0}
    assert set(pipeline.Predictor(spark, f"{out}/pipeline").config["c"]) == {"effects", "complexity", "errors"}


def test_kinds_and_options():
    assert cli._kinds(["rf"]) == "rf" and cli._kinds(["effects=svm", "errors=lr"]) == {"effects": "svm", "errors": "lr"}
    o = pipeline.Options(c=2.0, trees=5)
    assert o.of("svm", 10)["reg"] == 0.05 and o.of("rf", 10) == {"trees": 5, "max_depth": 20, "min_leaf": 1} and o.of("lr", 10) == {}


def test_an_embedder_that_cannot_be_loaded(spark):
    def broken():
        raise OSError("no weights")

    class Ones:
        def embed_batch(self, codes):
            return [[1.0]] * len(codes)

    embedders.register("ones", Ones)
    embedders.register("big", broken, usable=broken, instead="small")
    embedders.register("small", broken, usable=lambda: False, instead="ones")
    try:
        assert embedders.factory("big") is Ones and embedders.factory("small") is Ones and embedders.factory("ones") is Ones
        assert embedders.factory("unknown") is embedders.HashedEmbedder
        df = spark.createDataFrame([("x",)], "c string")
        assert list(df.select(embedders.embedding(df.c, "big")).first()[0]) == [1.0]
    finally:
        for n in ("ones", "big", "small"):
            embedders.REGISTRY.pop(n)
            embedders.CHECKS.pop(n, None)
