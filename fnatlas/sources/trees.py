"""Sources and sinks: source trees, labelled functions as JSON, reports, and saved pipelines."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import LABELS_DDL

LABELED_SCHEMA = f"function_name string, function_code string, file_path string, labels {LABELS_DDL}"


def normalised(content: Column) -> Column:
    """As a reader of text that drops invalid bytes and folds line ends gives it."""
    return F.replace(F.replace(F.make_valid_utf8(content), F.lit("�"), F.lit("")), F.lit("\r\n"), F.lit("\n"))


def read_tree(spark: SparkSession, path: str, glob: str = "*.c") -> DataFrame:
    """file_path, content: a row for each file under path whose name matches."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return df.select(F.col("_metadata.file_path").alias("file_path"), normalised(F.col("value")).alias("content"))


def write_labeled(df: DataFrame, path: str) -> None:
    """JSON lines, a folder; the way to store labelled functions at any size."""
    df.write.mode("overwrite").json(path)


def read_labeled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled functions from JSON lines or from arrays; a file that doesn't parse fails the read."""
    return spark.read.schema(LABELED_SCHEMA).json(path, multiLine=True, mode="FAILFAST") if path.endswith(".json") else spark.read.schema(LABELED_SCHEMA).json(path, mode="FAILFAST")


def labeled_array(df: DataFrame) -> str:
    """A small set of labelled functions as one indented JSON array."""
    return json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).toLocalIterator()], indent=2)


def inference_json(analyzed: DataFrame, pretty: bool = True) -> DataFrame:
    """file_path, json: what is known of each file, as it is printed or stored."""
    return analyzed.select("file_path", F.to_json(F.struct(*analyzed.columns), {"pretty": str(pretty).lower()}).alias("json"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """The versions of a pipeline that are whole, the last one first: those whose configuration, which is written last, is there."""
    fs, p = _fs(spark, folder)
    names = sorted((x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()), reverse=True) if fs.exists(p) else []
    return [f"{folder}/{n}" for n in names if n.startswith("version=") and exists(spark, f"{folder}/{n}/config/_SUCCESS")]


def save_pipeline(rows: DataFrame, config: dict, folder: str, models: dict | None = None) -> str:
    """Rows as parquet, fitted models by name and one row of configuration, as a new version; its folder.

    A version counts once its configuration is written, which comes last: until then load_pipeline() gives the version before. That one
    goes afterwards, with what broken saves left.
    """
    spark = rows.sparkSession
    new = f"{folder}/version={time.time_ns():020d}"
    rows.write.parquet(f"{new}/functions")
    for name, model in (models or {}).items():
        model.write().overwrite().save(f"{new}/models/{name}")
    spark.createDataFrame([(json.dumps(config | {"models": sorted(models or {})}, sort_keys=True),)], "config string").coalesce(1).write.parquet(f"{new}/config")
    fs, p = _fs(spark, folder)
    for x in fs.listStatus(p):
        if x.getPath().getName() < new.rpartition("/")[2] and x.getPath().getName().startswith("version="):
            fs.delete(x.getPath(), True)
    return new


def load_pipeline(spark: SparkSession, folder: str) -> tuple[DataFrame, dict, dict] | None:
    """Rows, configuration and models of the last whole version; None if there is none, so callers fall back to rules."""
    from pyspark.ml import PipelineModel

    for at in _versions(spark, folder)[:1]:
        config = json.loads(spark.read.parquet(f"{at}/config").first()["config"])
        return spark.read.parquet(f"{at}/functions"), config, {n: PipelineModel.load(f"{at}/models/{n}") for n in config["models"]}
    return None


def clean_labels(src: DataFrame, out: str) -> DataFrame:
    """Rewrites labelled functions with rare effects dropped and high complexity merged; `changed` tells the rows."""
    from ..functions.labels import merged_complexity, without_rare

    e, c = F.col("labels.side_effects"), F.col("labels.complexity")
    df = src.withColumn("changed", F.array_sort(F.array_distinct(e)) != F.array_sort(F.array_distinct(without_rare(e))))
    df = df.withColumn("labels", F.col("labels").withField("side_effects", without_rare(e)).withField("complexity", merged_complexity(c)))
    df.write.mode("overwrite").parquet(out)
    return src.sparkSession.read.parquet(out)
