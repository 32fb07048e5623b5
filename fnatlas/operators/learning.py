"""Splits, scaling, features, classifiers and clusters on pyspark.ml, with statistics as aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..session import blas_threads, ship


def seeded_digest(key: Column, seed: int = 42) -> Column:
    """A digest of key and seed, the same in every engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")).cast("binary"))


#: Cosines of the radial kernel.
COSINES = 256
#: Machines of one class against the others that are fitted at once; each keeps the vectors in blocks of its own.
AT_ONCE = 3
#: Bytes of vectors that are worth a task: each step of a fit is a job, so small tables go in few partitions.
PART_BYTES = 4 << 20


def hash_split(key: Column, test_percent: int = 30, seed: int = 42) -> Column:
    """'train' or 'test' by a digest of the key, the same each time and wherever rows are."""
    number = F.conv(F.substring(seeded_digest(key, seed), 1, 8), 16, 10).cast("long")
    return F.when(number % 100 < test_percent, "test").otherwise("train")


def modulo_split(key: Column, test_tenths: int = 3) -> Column:
    return F.when(key % 10 < test_tenths, "test").otherwise("train")


def dimension_stats(df: DataFrame, vec: str) -> DataFrame:
    """pos, mean, std: of each place of the vectors, with the population's standard deviation."""
    d = df.select(F.posexplode(doubles(F.col(vec))).alias("pos", "x"))
    return d.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def scaling(df: DataFrame, vec: str) -> dict[str, list[float]]:
    """Means and deviations of the places of a feature vector, to be kept with a model."""
    rows = dimension_stats(df, vec).orderBy("pos").collect()  # one row for each place
    return {"mean": [r["mean"] for r in rows], "std": [r["std"] if r["std"] and r["std"] > 0 else 1.0 for r in rows]}


def scaled_by(v: Column, stats: dict[str, list[float]]) -> Column:
    places = F.array(*[F.struct(F.lit(float(m)).alias("mean"), F.lit(float(d)).alias("std")) for m, d in zip(stats["mean"], stats["std"], strict=True)])
    return F.zip_with(doubles(v), places, lambda x, s: (x - s["mean"]) / s["std"])


def standard_scaled(df: DataFrame, vec: str, fit_on: DataFrame | None = None, out: str = "scaled") -> DataFrame:
    """df with the vectors' places centred and divided by their deviation, or by 1 where that is 0."""
    one = dimension_stats(fit_on if fit_on is not None else df, vec).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("stats"))
    j = df.crossJoin(F.broadcast(one))  # one row
    return j.withColumn(out, F.zip_with(doubles(F.col(vec)), "stats", lambda x, s: (x - s["mean"]) / F.when(s["std"] > 0, s["std"]).otherwise(1.0))).drop("stats")


def concatenated(*vectors: Column) -> Column:
    """Feature vectors one behind the other, in the order given: embedding or its PCA, hybrid, structure, purpose."""
    return F.concat(*[doubles(v) for v in vectors])


def binarised(df: DataFrame, values: str, classes: list[str]) -> DataFrame:
    """df with a 0/1 column is_<class> for each class."""
    return df.select("*", *[F.array_contains(values, c).cast("int").alias(f"is_{c}") for c in sorted(classes)])


def classes_of(df: DataFrame, values: str) -> list[str]:
    """The sorted label vocabulary of an array column; a closed domain."""
    return [r[0] for r in df.select(F.explode(values).alias("c")).distinct().orderBy("c").collect()]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: n / (classes * n of the class)."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def pca_fitted(df: DataFrame, vec: str, dims: int) -> PipelineModel:
    """Centring and projection of _v to _p."""
    stages = [StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False), PCA(k=dims, inputCol="_c", outputCol="_p")]
    return Pipeline(stages=stages).fit(df.withColumn("_v", array_to_vector(doubles(F.col(vec)))))


def pca_applied(model: PipelineModel, df: DataFrame, vec: str, out: str = "pca") -> DataFrame:
    return model.transform(df.withColumn("_v", array_to_vector(doubles(F.col(vec))))).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p")


def pca_projected(df: DataFrame, vec: str, dims: int, fit_on: DataFrame | None = None, out: str = "pca") -> tuple[DataFrame, float]:
    """df with centred vectors in dims principal components, and the share of variance they keep."""
    model = pca_fitted(fit_on if fit_on is not None else df, vec, dims)
    return pca_applied(model, df, vec, out), float(sum(model.stages[1].explainedVariance.toArray()))


class RandomFourier(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """_features to cosines whose products come near the radial kernel exp(-gamma |x - y|^2); what makes them follows from the seed."""

    gamma = Param(Params._dummy(), "gamma", "of the kernel", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "of the vectors", TypeConverters.toInt)
    dims = Param(Params._dummy(), "dims", "how many cosines", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the draws", TypeConverters.toInt)

    @staticmethod
    def of(gamma: float, size: int, dims: int, seed: int = 42) -> RandomFourier:
        return RandomFourier()._set(gamma=gamma, size=size, dims=dims, seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, size, dims, seed = (self.getOrDefault(x) for x in (self.gamma, self.size, self.dims, self.seed))
        ship(df.sparkSession)

        @F.pandas_udf("array<double>")
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            blas_threads(1)  # a task has one core
            r = np.random.default_rng(seed)
            w, b = r.normal(0, (2 * gamma) ** 0.5, (size, dims)), r.uniform(0, 2 * np.pi, dims)
            for s in batches:
                yield pd.Series(list((2 / dims) ** 0.5 * np.cos(np.array(s.tolist(), float).reshape(len(s), size) @ w + b)), index=s.index)

        return df.withColumn("_features", array_to_vector(mapped(vector_to_array("_features"))))


def scale_gamma(df: DataFrame, vec: str) -> float:
    """1 / (places * variance of all entries)."""
    r = df.select(F.size(vec).alias("n"), F.explode(doubles(F.col(vec))).alias("x")).agg(F.max("n").alias("n"), F.var_pop("x").alias("v")).first()
    return 1.0 / (r["n"] * r["v"]) if r["n"] and r["v"] else 1.0


def classifier(kind: str, features: int, classes: int, **options):
    """An estimator by kind: lr, svm, rf or mlp, of the columns _features, _label and _weight."""
    if kind == "svm":
        svc = LinearSVC(regParam=options.get("reg", 0.01), maxIter=options.get("max_iter", 50), featuresCol="_features", labelCol="_label", weightCol="_weight")
        return svc if classes <= 2 else OneVsRest(classifier=svc, parallelism=AT_ONCE, featuresCol="_features", labelCol="_label", weightCol="_weight")
    if kind == "rf":
        depth = options.get("max_depth", 20) or 30
        return RandomForestClassifier(numTrees=options.get("trees", 100), maxDepth=min(30, depth), minInstancesPerNode=options.get("min_leaf", 1), featureSubsetStrategy="sqrt", seed=options.get("seed", 42), featuresCol="_features", labelCol="_label", weightCol="_weight")
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[features, *options.get("layers", (256, 128)), max(2, classes)], maxIter=options.get("max_iter", 50), seed=options.get("seed", 42), featuresCol="_features", labelCol="_label")
    return LogisticRegression(regParam=options.get("reg", 0.01), elasticNetParam=0.0, standardization=False, maxIter=options.get("max_iter", 100), featuresCol="_features", labelCol="_label", weightCol="_weight")


def prepared(df: DataFrame, vec: str, label: str, kind: str = "lr", balanced: bool = True, **options) -> tuple[list[Transformer], DataFrame, Estimator, list[str]]:
    """What train_single() fits: the stages before the estimator, the rows that it is fitted to, the estimator, and the classes' names.

    svm has kernel="rbf" (by random cosines) or "linear"; options besides are those of classifier(). Weights of classes are a
    closed domain, a row each.
    """
    d = df.withColumn("_features", array_to_vector(doubles(F.col(vec))))
    d = d.join(F.broadcast(class_weights(df, label).select(label, F.col("weight").alias("_weight"))), label) if balanced else d.withColumn("_weight", F.lit(1.0))
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(d)
    names = indexer.labels
    size = df.select(F.size(vec)).first()[0]
    first = []
    if kind == "svm" and options.get("kernel", "rbf") == "rbf":
        gamma = options.get("gamma", "scale")
        first, size = [RandomFourier.of(scale_gamma(df, vec) if gamma == "scale" else float(gamma), size, options.get("cosines", COSINES))], options.get("cosines", COSINES)
    d = indexer.transform(d)
    if kind == "svm" and len(names) <= 2:  # without the indexer's place for unknown labels, which would be a third class
        d = d.filter(F.col("_label") < 2).withColumn("_label", F.col("_label").alias("_label", metadata={}))
    for stage in first:
        d = stage.transform(d)
    if (parts := -(-df.count() * size * 8 // PART_BYTES)) < df.sparkSession.sparkContext.defaultParallelism:
        d = d.repartition(max(1, parts))
    return first, d, classifier(kind, size, len(names), **options), names


def train_single(df: DataFrame, vec: str, label: str, kind: str = "lr", balanced: bool = True, **options) -> PipelineModel:
    """A model of one label: indexes the classes by name, fits, and writes `predicted` as a class name. See prepared()."""
    first, d, estimator, names = prepared(df, vec, label, kind, balanced, **options)
    return PipelineModel(stages=[*first, estimator.fit(d), IndexToString(inputCol="prediction", outputCol="predicted", labels=[*names, "?"])])


def predict_single(model: PipelineModel, df: DataFrame, vec: str, out: str = "predicted") -> DataFrame:
    d = model.transform(df.withColumn("_features", array_to_vector(doubles(F.col(vec)))))
    return d.select(*df.columns, F.col("predicted").alias(out))


def train_multilabel(df: DataFrame, vec: str, values: str, kind: str = "lr", least: int = 2, balanced: bool = True, strategy: str = "binary", **options) -> dict[str, PipelineModel]:
    """A binary model for each class, a closed domain. By strategy "binary", of classes with at least `least` positives; by
    "columns", of every class that some rows have and some don't. Other classes are always predicted as no."""
    out = {}
    for c in trainable(df, values, strategy, least):
        d = df.withColumn("_y", F.array_contains(values, c).cast("int").cast("string"))
        out[c] = train_single(d, vec, "_y", kind, balanced, **options)
    return out


def trainable(df: DataFrame, values: str, strategy: str = "binary", least: int = 2) -> list[str]:
    """The classes that a model can be fitted for, sorted: see train_multilabel(). Counted in one pass."""
    n = df.count()
    c = df.select(F.explode(F.array_distinct(values)).alias("c")).groupBy("c").count().filter("c is not null")
    least = least if strategy == "binary" else 1
    return sorted(r["c"] for r in c.collect() if least <= r["count"] < n)


def _with_scores(model: PipelineModel, df: DataFrame, vec: str, out: str) -> DataFrame:
    """df with the probability of yes, or 1 and 0 by the prediction where a model has none."""
    d = model.transform(df.withColumn("_features", array_to_vector(doubles(F.col(vec)))))
    yes = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in d.columns else (F.col("predicted") == "1").cast("double")
    return d.select(*df.columns, yes.alias(out))


def tuned_thresholds(models: dict[str, PipelineModel], df: DataFrame, vec: str, values: str) -> dict[str, float]:
    """For each class the threshold of its probability with the best F1 on df."""
    from .evaluation import threshold_search

    d = df.select(vec, values)
    for i, c in enumerate(sorted(models)):
        d = _with_scores(models[c], d, vec, f"_score_{i}")
    rows = [F.struct(F.lit(c).alias("class"), F.col(f"_score_{i}").alias("score"), F.array_contains(values, c).alias("truth")) for i, c in enumerate(sorted(models))]
    if not rows:
        return {}
    scores = d.select(F.explode(F.array(*rows)).alias("one")).select("one.*")
    return {r["class"]: float(r["threshold"]) for r in threshold_search(scores).collect()}


def predict_multilabel(models: dict[str, PipelineModel], df: DataFrame, vec: str, none: str = "none", out: str = "predicted", thresholds: dict[str, float] | None = None) -> DataFrame:
    """df with the sorted array of the classes predicted, by thresholds of their probability where given, or the one for none."""
    d, keep, found = df, df.columns, []
    for i, c in enumerate(sorted(models)):
        if thresholds and c in thresholds:
            d = _with_scores(models[c], d, vec, f"_is_{i}")
            found.append(F.when(F.col(f"_is_{i}") >= thresholds[c], F.lit(c)))
        else:
            d = predict_single(models[c], d, vec, f"_is_{i}")
            found.append(F.when(F.col(f"_is_{i}") == "1", F.lit(c)))
    got = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return d.select(*keep, F.when(F.size(got) > 0, got).otherwise(F.array(F.lit(none))).alias(out))


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 42, n_init: int = 10, out: str = "cluster", key: str | None = None) -> DataFrame:
    """df with clusters of the best of n_init starts, which are gone through together; starts come from a pool of rows by digests of key."""
    from .clustering import Clusterings

    keyed = df.select(F.xxhash64(vec).alias("_fn_key") if key is None else F.col(key).alias("_fn_key"), vec)
    found = Clusterings.fitted(keyed, "_fn_key", vec, [k], n_init, seed)
    keep = [c for c in df.columns if c != out]
    return found.assigned(df.select(*keep), vec, "_fn_clusters").select(*keep, F.get("_fn_clusters", F.lit(0)).alias(out))


def adaptive_k(n: int, most: int = 4) -> int | None:
    """min(most, n // 3); None if that is no clustering."""
    k = min(most, n // 3)
    return k if k >= 2 else None


def silhouette_sweep(df: DataFrame, key: str, vec: str, most: int = 8, n_init: int = 10) -> list[tuple[int, float]]:
    """The silhouette of each k from 2; best_k() chooses."""
    from .clustering import sweep

    return sweep(df, key, vec, most, n_init)


def best_k(sweep: list[tuple[int, float]]) -> int | None:
    """The first k with the largest silhouette."""
    return max(sweep, key=lambda p: (p[1], -p[0]))[0] if sweep else None
