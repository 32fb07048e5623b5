"""Labels of functions as they arrive: a stateless stream over the same expressions, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.trees import normalised


def file_stream(spark: SparkSession, path: str, glob: str = "*.c") -> DataFrame:
    """Whole files of a folder as they appear: file_path, content."""
    s = spark.readStream.format("text").options(wholetext="true", recursiveFileLookup="true", pathGlobFilter=glob).schema("value string").load(path)
    return s.select(F.col("_metadata.file_path").alias("file_path"), normalised(F.col("value")).alias("content"))


def labeled_stream(functions_df: DataFrame) -> DataFrame:
    return functions_df.withColumn("labels", L.label_struct(F.col("function_name"), F.col("function_code")))


def effect_counts(labeled_df: DataFrame) -> DataFrame:
    """Running counts of side effects, for output mode complete or update."""
    return labeled_df.select(F.explode("labels.side_effects").alias("effect")).groupBy("effect").agg(F.count("*").alias("n"))
