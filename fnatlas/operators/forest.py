"""A forest that never is in one place: trees are fitted some at a time, and rows keep the sum of their votes."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..session import shared_dir
from ..sources import trees as files
from .learning import predict_single, prepared

#: Nodes that the driver holds at once: a tree has at most twice as many as rows.
NODES = 500_000


def predicted(train: DataFrame, df: DataFrame, vec: str, label: str, balanced: bool = True, out: str = "predicted", **options) -> DataFrame:
    """df with the class that a forest fitted to train predicts; options are those of classifier().

    A tree's vote is its leaf's share of each class, and votes are added up, as in a forest that is fitted at once. Each round fits as many
    trees as NODES allows, one at least, adds their votes to the rows in the shared folder, and lets them go.
    """
    spark = df.sparkSession
    _, d, forest, names = prepared(train, vec, label, "rf", balanced, **options)
    n, whole = d.count(), forest.getNumTrees()
    some = max(1, NODES // max(1, 2 * n))
    if some >= whole:
        model = PipelineModel(stages=[forest.fit(d), IndexToString(inputCol="prediction", outputCol="predicted", labels=[*names, "?"])])
        return predict_single(model, df, vec, out)
    folder = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    atexit.register(_swept, spark, folder)
    d = d.select("_features", "_label", "_weight").persist()
    df.withColumn("_x", doubles(F.col(vec))).withColumn("_votes", F.lit(None).cast("array<double>")).write.parquet(f"{folder}/0")
    at = 0
    for first in range(0, whole, some):
        model = forest.copy({forest.numTrees: min(some, whole - first), forest.seed: forest.getSeed() + first}).fit(d)
        rows = spark.read.parquet(f"{folder}/{at}")
        voted = model.transform(rows.withColumn("_features", array_to_vector("_x")))
        votes = vector_to_array("rawPrediction")
        added = F.when(F.col("_votes").isNull(), votes).otherwise(F.zip_with("_votes", votes, lambda a, b: a + b))
        voted.select(*df.columns, "_x", added.alias("_votes")).write.parquet(f"{folder}/{at + 1}")
        files.delete(spark, f"{folder}/{at}")
        at += 1
        del model, voted
    d.unpersist()
    most = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("int")
    return spark.read.parquet(f"{folder}/{at}").select(*df.columns, F.get(F.array(*map(F.lit, [*names, "?"])), most).alias(out))


def _swept(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        files.delete(spark, folder)
