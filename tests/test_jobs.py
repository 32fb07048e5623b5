"""The jobs: growing input, repeated runs and batches, awkward rows, command line, and their queries against SQL."""

import json
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import audit_labels, label_new_texts, queries
from jobs.common import configured

DOCS = "doc_id long, text string, source string, lang string"
CODE = 'int f(void) {\n  char *p = malloc(3);\n  if (!p) return -1;\n  printf("x");\n  return 0;\n}'


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def config(folder, **more):
    return label_new_texts.Config(f"{folder}/in", f"{folder}/out", f"{folder}/mark", **more)


def add(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def held(df, *drop):
    d = df.drop(*drop)
    return sorted(map(str, d.select(*[c if not t.startswith("array") else F.array_join(c, ",").alias(c) for c, t in d.dtypes]).collect()))


def state(spark, c):
    return held(label_new_texts.latest(label_new_texts.rows(spark, c)), "batch"), held(label_new_texts.totals(spark, c), "upto")


def test_two_runs_over_growing_input(spark, folder, tmp_path):
    c = config(folder)
    add(spark, folder, [(1, CODE, "a", "en"), (2, "plain words", "b", "de"), (3, None, "a", None)])
    assert label_new_texts.run(spark, c) == {"batches": 1, "rows_read": 3, "rows_written": 3, "partitions_counted": 2}
    first = label_new_texts.rows(spark, c).filter("key = 1").first()
    assert (first["side_effects"], first["control_flow"], first["error_handling"], first["lines"], first["batch"]) == (["io", "memory"], ["if", "return"], "returns_code", 6, 0)
    before = state(spark, c)
    assert label_new_texts.run(spark, c) == {"batches": 0, "rows_read": 0, "rows_written": 0, "partitions_counted": 0}
    assert state(spark, c) == before
    add(spark, folder, [(4, CODE, "b", "en"), (2, CODE, "b", "de"), (None, "x", None, None), (None, "x", None, None)])
    got = label_new_texts.run(spark, c)
    assert (got["rows_read"], got["rows_written"], got["partitions_counted"]) == (4, 4, 2)
    assert label_new_texts.rows(spark, c).filter("key = 1").first()["batch"] == 0  # what was there isn't taken again
    # the same as one run over all of it, but for the row that came again
    whole = f"file://{tmp_path}/whole"
    spark.createDataFrame([(1, CODE, "a", "en"), (3, None, "a", None), (4, CODE, "b", "en"), (2, CODE, "b", "de"), (None, "x", None, None), (None, "x", None, None)], DOCS).write.parquet(f"{whole}/in")
    label_new_texts.run(spark, config(whole))
    assert state(spark, c) == state(spark, config(whole))


def test_a_repeated_batch_replaces_itself(spark, folder, tmp_path):
    c = config(folder)
    add(spark, folder, [(i, f"{CODE} {i}", "ab"[i % 2], "en") for i in range(6)])
    label_new_texts.run(spark, c)
    before = state(spark, c)
    for f in (tmp_path / "mark" / "commits").iterdir():  # as if the run had ended after the rows and before the mark
        f.unlink()
    assert label_new_texts.run(spark, c)["rows_written"] == 6
    assert state(spark, c) == before and label_new_texts.rows(spark, c).count() == 6


def test_totals_left_out_are_made_up_for(spark, folder, monkeypatch):
    c = config(folder)
    add(spark, folder, [(1, CODE, "a", "en")])
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(label_new_texts, "recount", lambda *a: (_ for _ in ()).throw(RuntimeError()))
        label_new_texts.run(spark, c)
    assert label_new_texts.totals(spark, c).count() == 0
    assert label_new_texts.run(spark, c)["partitions_counted"] == 1
    assert {(r["label"], r["value"], r["n"]) for r in label_new_texts.totals(spark, c).collect()} == {("complexity", "low", 1), ("error_handling", "returns_code", 1), ("side_effects", "io", 1), ("side_effects", "memory", 1)}


def test_empty_input(spark, folder):
    c = config(folder)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/in")
    label_new_texts.run(spark, c)
    assert label_new_texts.rows(spark, c).count() == label_new_texts.totals(spark, c).count() == 0


def test_settings_are_left_as_they_are(spark, folder):
    before = dict(spark.conf.getAll)
    add(spark, folder, [(1, "x", "a", "en")])
    label_new_texts.run(spark, config(folder))
    assert dict(spark.conf.getAll) == before


def audit(spark, folder, name="audit", **more):
    return audit_labels.Config(f"{folder}/texts", f"{folder}/labels", f"{folder}/vectors", f"{folder}/{name}", **more)


@pytest.fixture
def labelled(spark, folder):
    lang = lambda i: "en" if i < 6 else "de"
    spark.createDataFrame([(i, "t" * i, lang(i)) for i in range(10)] + [(None, "x", "en"), (1, "t", "en")], "doc_id long, text string, lang string").write.parquet(f"{folder}/texts")
    spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(77, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels")
    vec = lambda i: [1.0, 0.1 * (i // 2), 0.0]
    spark.createDataFrame([(i, vec(i)) for i in range(10)] + [(8, [0.0, 0.0, 1.0]), (None, [1.0, 0.0, 0.0]), (55, None)], "vec_id long, embedding array<double>").write.parquet(f"{folder}/vectors")
    return folder


def test_audit(spark, labelled):
    c = audit(spark, labelled, neighbours=1, conflict_from=0.9)
    done = audit_labels.run(spark, c)
    assert done == {"texts_read": 12, "labels_read": 10, "vectors_read": 13, "rows_written": 9}
    got = {r["id"]: r for r in spark.read.parquet(f"{c.output}/rows").collect()}
    assert got[0]["worst_id"] == 1 and got[1]["worst_id"] == 0 and got[1]["worst_sim"] == 1.0  # equal vectors, other labels
    assert got[3]["tags"] == ["en", "quality"] and got[3]["overlap"] == 0.5 and got[3]["partition"] == "en" and got[3]["n_chars"] == 3
    assert got[8]["n_conflicts"] == 0 and got[8]["worst_id"] is None
    s = {r["partition"]: r for r in spark.read.parquet(f"{c.output}/summary").collect()}
    assert (s["en"]["n"], s["de"]["n"], s["de"]["weight"]) == (6, 3, 1.5)


def test_audit_again_and_of_one_partition(spark, labelled):
    c = audit(spark, labelled, neighbours=2)
    audit_labels.run(spark, c)
    read = lambda: (held(spark.read.parquet(f"{c.output}/rows")), held(spark.read.parquet(f"{c.output}/summary")))
    before = read()
    audit_labels.run(spark, c)
    assert read() == before
    assert audit_labels.run(spark, audit(spark, labelled, neighbours=2, only=("de",)))["rows_written"] == 3
    assert read() == before


def test_audit_of_nothing(spark, labelled):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{labelled}/labels")
    assert audit_labels.run(spark, audit(spark, labelled))["rows_written"] == 0


def test_unknown_settings():
    with pytest.raises(ValueError, match="unknown settings: inptu"):
        configured(label_new_texts.Config, {"inptu": "x"})
    assert configured(audit_labels.Config, {"texts": "a", "labels": "b", "vectors": "c", "output": "d", "only": ["en"]}).only == ("en",)


def test_command_line(spark, folder, tmp_path):
    add(spark, folder, [(1, CODE, "a", "en")])
    (tmp_path / "c.json").write_text(json.dumps({"input": f"{folder}/in", "output": f"{folder}/cli", "checkpoint": f"{folder}/cli-mark"}))
    for n in (1, 0):
        r = subprocess.run([sys.executable, "-m", "jobs.label_new_texts", "--config", str(tmp_path / "c.json"), "--set", "files_per_batch=7"], cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True, text=True, timeout=300)
        assert r.returncode == 0, r.stderr
        assert json.loads(r.stdout.strip().splitlines()[-1])["rows_written"] == n
        assert ("read 1 rows" if n else "nothing new") in r.stderr
    assert spark.read.parquet(f"{folder}/cli/rows").count() == 1


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), c.execute(queries.ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) and a.equals(b)
