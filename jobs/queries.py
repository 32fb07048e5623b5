"""The jobs as registered queries: each runs its job twice over the whole tables, into one new folder, and reads all output back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fnatlas.plans import catalog

from . import audit_labels, label_new_texts
from .common import new_folder


def _filled(df: DataFrame) -> DataFrame:
    """What a kind of row hasn't is empty, or -1."""
    return df.na.fill("").na.fill(-1)


def job1_label_new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds nothing new. kind "row" has a text's labels, kind "total" how many texts of a source have a label."""
    folder = new_folder(spark, "job1")
    # a pattern, since a stream takes one file only by a pattern; it matches a folder of that name too
    config = label_new_texts.Config(f"{sf_dir}/documents.parque[t]", f"{folder}/output", f"{folder}/checkpoint")
    for _ in range(2):
        label_new_texts.run(spark, config)
    joined = lambda c: F.array_join(c, ",").alias(c)
    r = label_new_texts.latest(label_new_texts.rows(spark, config))
    r = r.select(F.lit("row").alias("kind"), F.col("key").alias("doc_id"), "partition", "lang", "lines", joined("control_flow"), joined("side_effects"), "complexity", "error_handling", F.lit(1).cast("long").alias("n"))
    t = label_new_texts.totals(spark, config).select(F.lit("total").alias("kind"), "partition", F.col("label").alias("lang"), F.col("value").alias("complexity"), "n")
    return _filled(r.unionByName(t, allowMissingColumns=True).withColumnRenamed("partition", "source"))


#: Word characters are those of Unicode; DuckDB's are not, so letters beyond ASCII become one of ASCII before it matches words.
JOB1_SQL = f"""
WITH f AS (SELECT doc_id AS fn_id, source, lang, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', 'x', 'g') AS function_code FROM documents),
{catalog._DEPTH},
r AS (SELECT fn_id, source, lang, {catalog._LINES} AS lines, {catalog._CF} AS flow, {catalog._SE} AS effects, {catalog._CX} AS complexity, {catalog._EH} AS errors
  FROM (SELECT f.*, greatest(coalesce(depths.depth, 0), 0) AS depth FROM f LEFT JOIN depths USING (fn_id))),
one AS (
  SELECT source, 'complexity' AS label, complexity AS value FROM r UNION ALL SELECT source, 'error_handling', errors FROM r
  UNION ALL SELECT source, 'side_effects', unnest(effects) FROM r)
SELECT 'row' AS kind, fn_id AS doc_id, source, lang, CAST(lines AS INT) AS lines, array_to_string(flow, ',') AS control_flow, array_to_string(effects, ',') AS side_effects, complexity, errors AS error_handling, CAST(1 AS BIGINT) AS n FROM r
UNION ALL SELECT 'total', -1, source, label, -1, '', '', value, '', count(*) FROM one GROUP BY source, label, value
"""


def job2_audit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind "row" has a text's agreement and worst conflict, kind "summary" a language's."""
    folder = new_folder(spark, "job2")
    config = audit_labels.Config(*(f"{sf_dir}/{t}.parquet" for t in ("documents", "labels", "embeddings")), f"{folder}/output")
    for _ in range(2):
        audit_labels.run(spark, config)
    r = spark.read.parquet(f"{config.output}/rows")
    r = r.select(F.lit("row").alias("kind"), F.col("id").alias("doc_id"), "partition", F.array_join("tags", ",").alias("tags"), "n_chars", "overlap", F.col("n_conflicts").alias("n"), "worst_id", "worst_sim")
    s = spark.read.parquet(f"{config.output}/summary").select(F.lit("summary").alias("kind"), "partition", "overlap", F.col("n_conflicting").alias("n"), F.col("weight").alias("worst_sim"))
    return _filled(r.unionByName(s, allowMissingColumns=True).withColumnRenamed("partition", "lang"))


JOB2_SQL = f"""
WITH t AS (SELECT d.doc_id, d.lang, length(d.text) AS n_chars, list_sort(string_split(tag_text, ',')) AS tags FROM documents d JOIN ({catalog.D.DOC_TAGS}) g USING (doc_id)),
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm FROM embeddings WHERE vec_id IN (SELECT doc_id FROM t)),
sims AS (SELECT a.id AS q, b.id AS c, round(coalesce(list_dot_product(a.v, b.v) / nullif(a.nrm * b.nrm, 0), 0), 6) AS sim FROM v a JOIN v b ON a.id <> b.id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rank FROM sims) WHERE rank <= 5),
j AS (SELECT q, c, sim, a.tags AS qt, b.tags AS ct FROM near JOIN t a ON a.doc_id = q JOIN t b ON b.doc_id = c),
agree AS (SELECT q, round(avg(len(list_intersect(qt, ct)) / CAST(len(list_distinct(list_concat(qt, ct))) AS DOUBLE)), 6) AS overlap FROM j GROUP BY q),
bad AS (SELECT q, c, sim, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS k FROM j WHERE sim > 0.2 AND qt <> ct),
r AS (
  SELECT t.doc_id, t.lang, array_to_string(t.tags, ',') AS tags, CAST(t.n_chars AS INT) AS n_chars, overlap, coalesce(bad.n, 0) AS n, coalesce(bad.c, -1) AS worst_id, coalesce(bad.sim, -1) AS worst_sim
  FROM t JOIN v ON v.id = t.doc_id LEFT JOIN agree ON agree.q = t.doc_id LEFT JOIN bad ON bad.q = t.doc_id AND bad.k = 1)
SELECT 'row' AS kind, doc_id, lang, tags, n_chars, overlap, n, worst_id, worst_sim FROM r
UNION ALL SELECT 'summary', -1, lang, '', -1, round(avg(overlap), 6), CAST(count_if(n > 0) AS BIGINT), -1, round((SELECT count(*) / CAST(count(DISTINCT lang) AS DOUBLE) FROM r) / count(*), 6) FROM r GROUP BY lang
"""

QUERIES = {f.__name__: f for f in (job1_label_new_texts, job2_audit_labels)}
ORACLES = {"job1_label_new_texts": JOB1_SQL, "job2_audit_labels": JOB2_SQL}
