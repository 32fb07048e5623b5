"""An audit of labels: which labelled texts disagree with the texts nearest to them.

The job reads texts, their labels and their vectors, finds each labelled text's nearest labelled neighbours by cosine, and
writes for each text how far its label set agrees with theirs, and its conflicts: neighbours from a similarity on with another label
set. Output is partitioned by a column of the texts; partitions are replaced whole, so a rerun gives the same. A second table has
for each partition the number of texts, how well they agree and the weight that balances it against the others.

With `only`, texts of those partitions are audited (against all), and the others' results stay as they are. Rows without
key, label row or vector take no part; of rows with one key, one counts: the smallest by vector, text or labels.

    python -m jobs.audit_labels --config jobs/audit_labels.json --set output=…
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fnatlas.operators import similarity as S
from fnatlas.operators.learning import class_weights

from .common import command_line, log

LOG = log("audit_labels")


@dataclass(frozen=True)
class Config:
    texts: str
    labels: str
    vectors: str
    output: str
    key: str = "doc_id"
    text: str = "text"
    vector_key: str = "vec_id"
    vector: str = "embedding"
    #: Columns of 0 and 1 that name a label each, and the text's column that is one more label and partitions the output.
    flags: tuple[str, ...] = ("quality", "toxic")
    partition: str = "lang"
    only: tuple[str, ...] = ()
    neighbours: int = 5
    conflict_from: float = 0.2
    digits: int = 6


def _one(df: DataFrame, key: str, *others: str) -> DataFrame:
    """key and others, one row for each key."""
    d = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *others)
    return d.groupBy("id").agg(F.min(F.struct(*others)).alias("r")).select("id", *[F.col(f"r.{c}") for c in others])


def audited(texts: DataFrame, labels: DataFrame, vectors: DataFrame, config: Config) -> DataFrame:
    """id, tags, n_chars, overlap, n_conflicts, worst_id, worst_sim, partition."""
    t = _one(texts.select(config.key, F.char_length(config.text).alias("n_chars"), F.col(config.partition).alias("partition")), config.key, "n_chars", "partition")
    tags = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in config.flags], F.col("partition"))))
    known = t.join(_one(labels, config.key, *config.flags), "id").select("id", "n_chars", "partition", tags.alias("tags"))
    v = S.unit_vectors(vectors.filter(F.col(config.vector).isNotNull()), config.vector_key, config.vector)
    v = _one(v, "id", "v").join(known.select("id"), "id", "left_semi")
    asked = v.join(known.filter(F.col("partition").isin(*config.only)).select("id"), "id", "left_semi") if config.only else v
    near = S.top_k(asked, v, config.neighbours, digits=config.digits)
    agree = S.overlap_at_k(near, known.select("id", "tags"))
    worst = F.max(F.struct("sim", (-F.col("c")).alias("c")))
    other = S.conflicting(near, known.select("id", "tags"), config.conflict_from).groupBy("q").agg(F.count("*").alias("n_conflicts"), worst.alias("worst"))
    d = known.join(asked.select("id"), "id", "left_semi").join(agree.withColumnRenamed("q", "id"), "id", "left").join(other.withColumnRenamed("q", "id"), "id", "left")
    return d.select("id", "tags", "n_chars", F.round("overlap", config.digits).alias("overlap"), F.coalesce("n_conflicts", F.lit(0)).cast("long").alias("n_conflicts"), (-F.col("worst.c")).alias("worst_id"), F.col("worst.sim").alias("worst_sim"), "partition")


def summarised(rows: DataFrame) -> DataFrame:
    """partition, n, overlap, n_conflicting, weight."""
    s = rows.groupBy("partition").agg(F.avg("overlap").alias("overlap"), F.count_if(F.col("n_conflicts") > 0).alias("n_conflicting"))
    w = class_weights(rows, "partition").withColumnRenamed("partition", "p")
    s = s.join(w, F.col("partition").eqNullSafe(F.col("p")))
    return s.select("partition", "n", F.round("overlap", 6).alias("overlap"), "n_conflicting", F.round("weight", 6).alias("weight"))


def run(spark: SparkSession, config: Config) -> dict:
    """Audits and writes; how many rows were read and written."""
    tables = {n: spark.read.parquet(getattr(config, n)) for n in ("texts", "labels", "vectors")}
    rows = audited(*tables.values(), config)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition").parquet(f"{config.output}/rows")
    whole = spark.read.schema(rows.schema).parquet(f"{config.output}/rows")
    summarised(whole).write.mode("overwrite").parquet(f"{config.output}/summary")
    own = whole.filter(F.col("partition").isin(*config.only)) if config.only else whole
    done = {f"{n}_read": t.count() for n, t in tables.items()} | {"rows_written": own.count()}
    LOG.info("read %(texts_read)d texts, %(labels_read)d labels, %(vectors_read)d vectors, wrote %(rows_written)d rows", done)
    LOG.info("output in %s/rows and %s/summary", config.output, config.output)
    return done


if __name__ == "__main__":
    sys.exit(command_line(Config, run, __doc__))
