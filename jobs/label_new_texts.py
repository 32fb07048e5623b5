"""Labels of a growing table of code texts: each run takes only the files that are new.

A stream reads the input folder's Parquet files, each once: its checkpoint is the mark of how far the job has come. Each
batch's texts get the rules' labels (control flow, side effects, complexity, error handling) and go to `output`/rows, partitioned
by the configured column and the batch. A batch that is repeated after a failure overwrites its own partitions, so rows are
there once. Then the totals of the partitions that got new rows are counted again and replaced in `output`/totals.

A key that comes again in its partition, in a later file, replaces the earlier row in latest() and in the totals; rows
without a key are kept all. A null text is labelled as an empty one. A file that is only added to the folder, not
changed, is what the stream expects. With nothing new, a run changes nothing.

    python -m jobs.label_new_texts --config jobs/label_new_texts.json --set input=… --set output=… --set checkpoint=…
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fnatlas.functions import labels as L

from .common import command_line, log

LOG = log("label_new_texts")


@dataclass(frozen=True)
class Config:
    #: A folder of Parquet files, or a pattern of such folders or files.
    input: str
    output: str
    checkpoint: str
    key: str = "doc_id"
    text: str = "text"
    #: The column that partitions the output, and others that go along.
    partition: str = "source"
    carry: tuple[str, ...] = ("lang",)
    files_per_batch: int = 200


def labeled(texts: DataFrame, config: Config) -> DataFrame:
    """The job's rows: key, what goes along, lines, labels; and the partition."""
    code: Column = L.plain(F.coalesce(F.col(config.text), F.lit("")))
    d = texts.select(F.col(config.key).alias("key"), *[F.col(c) for c in config.carry], F.col(config.partition).alias("partition"), code.alias("code"))
    return d.withColumn("lower", F.lower("code")).select(
        "key", *config.carry, L.line_count(F.col("code")).alias("lines"), L.control_flow(F.col("code")).alias("control_flow"), L.side_effects(F.col("lower"), True).alias("side_effects"),
        L.complexity(F.col("code")).alias("complexity"), L.error_handling(F.col("lower"), True).alias("error_handling"), "partition",
    )


def _schema(spark: SparkSession, config: Config):
    """Of the rows, as they are read back."""
    empty = spark.createDataFrame([], spark.read.parquet(config.input).schema)
    return labeled(empty, config).withColumn("batch", F.lit(0).cast("long")).schema


TOTALS = "label string, value string, n long, upto long, partition string"


def rows(spark: SparkSession, config: Config) -> DataFrame:
    """All rows that were written, with partition and batch."""
    return spark.read.schema(_schema(spark, config)).parquet(f"{config.output}/rows")


def totals(spark: SparkSession, config: Config) -> DataFrame:
    """How many of the latest rows of a partition have each label, and up to which batch they are counted."""
    return spark.read.schema(TOTALS).parquet(f"{config.output}/totals")


def latest(df: DataFrame) -> DataFrame:
    """Of rows with one key in a partition, one of the last batch that has it; rows without a key are kept."""
    found = [c for c in df.columns if c not in ("partition", "key", "batch")]
    last = F.row_number().over(Window.partitionBy("partition", "key").orderBy(F.desc("batch"), F.xxhash64(*found)))
    return df.filter("key is not null").withColumn("_n", last).filter("_n = 1").drop("_n").unionByName(df.filter("key is null"))


def counted(df: DataFrame) -> DataFrame:
    """partition, label, value, n: how many rows have each label."""
    one = [F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in ("complexity", "error_handling")]
    many = F.transform("side_effects", lambda e: F.struct(F.lit("side_effects").alias("label"), e.alias("value")))
    d = df.select("partition", F.explode(F.concat(F.array(*one), many)).alias("x"))
    return d.groupBy("partition", "x.label", "x.value").agg(F.count("*").alias("n"))


def run(spark: SparkSession, config: Config) -> dict:
    """Labels what is new; how many rows were read and written, in how many batches, and how many partitions were counted again."""
    done = {"batches": 0, "rows_read": 0, "rows_written": 0, "partitions_counted": 0}

    def write(batch: DataFrame, number: int) -> None:
        _replace(labeled(batch, config).withColumn("batch", F.lit(number).cast("long")), f"{config.output}/rows", "partition", "batch")
        n = rows(spark, config).filter(F.col("batch") == number).count()  # of the batch's own folders; each row that is read is one that is written
        done.update(batches=done["batches"] + 1, rows_read=done["rows_read"] + n, rows_written=done["rows_written"] + n)
        LOG.info("batch %d: read %d rows of %s, wrote %d to %s/rows", number, n, config.input, n, config.output)

    # the folders are there even if nothing ever comes
    spark.createDataFrame([], _schema(spark, config)).write.mode("append").partitionBy("partition", "batch").parquet(f"{config.output}/rows")
    spark.createDataFrame([], TOTALS).write.mode("append").partitionBy("partition").parquet(f"{config.output}/totals")
    stream = spark.readStream.schema(spark.read.parquet(config.input).schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(config.input)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", config.checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not done["batches"]:
        LOG.info("nothing new in %s", config.input)
    done["partitions_counted"] = recount(spark, config)
    return done


def _replace(df: DataFrame, path: str, *partitions: str) -> None:
    """Writes df over the partitions that it has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def recount(spark: SparkSession, config: Config) -> int:
    """Totals of the partitions that have rows of later batches than their totals, so those that a run left out are made up for."""
    last = rows(spark, config).groupBy(F.col("partition").alias("p")).agg(F.max("batch").alias("last"))
    upto = totals(spark, config).groupBy("partition").agg(F.max("upto").alias("done"))
    new = last.join(upto, F.col("p").eqNullSafe(F.col("partition")), "left").filter("done is null or done < last").select("p", "last")
    n = new.count()
    if n:
        fresh = counted(latest(rows(spark, config).join(new.select("p"), F.col("partition").eqNullSafe(F.col("p")), "left_semi")))
        fresh = fresh.join(new, F.col("partition").eqNullSafe(F.col("p"))).select("label", "value", "n", F.col("last").alias("upto"), "partition")
        _replace(fresh, f"{config.output}/totals", "partition")
        LOG.info("counted %d partitions again, %s/totals has %d rows", n, config.output, totals(spark, config).count())
    return n


if __name__ == "__main__":
    sys.exit(command_line(Config, run, __doc__))
