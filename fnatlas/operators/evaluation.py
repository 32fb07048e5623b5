"""Distributions, classification metrics, cluster quality, failures and the whole report, as aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..session import blas_threads, ship
from .learning import seeded_digest
from .similarity import BLOCK

#: Bytes of the vectors of a tile, two of which a cell holds.
TILE_BYTES = 16 << 20


def distribution(df: DataFrame, values: str, name: str = "value") -> DataFrame:
    """How often each element of an array column occurs.

    explode_outer, since for explode the optimizer adds a filter that evaluates the array's expression once more.
    """
    d = df.select(F.explode_outer(F.transform(values, lambda x: F.struct(x.alias("x")))).alias("one")).filter("one is not null")
    return d.groupBy(F.col("one.x").alias(name)).agg(F.count("*").alias("n"))


def combinations(df: DataFrame, values: str) -> DataFrame:
    return df.groupBy(F.array_join(F.array_sort(values), "+").alias("combination")).agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, text: str) -> DataFrame:
    n = F.length(text)
    return df.agg(
        F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"), F.percentile(n, F.lit(0.5)).alias("median_len"), F.percentile(n, F.lit(0.25)).alias("p25_len"),
    )


def histogram(df: DataFrame, value: Column, bins: int = 20) -> DataFrame:
    """bin (from 0), n: counts in bins of equal width between the least and the largest value, which is in the last."""
    d = df.select(value.cast("double").alias("x"))
    d = d.crossJoin(F.broadcast(d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))))  # one row
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))).otherwise(0)
    return d.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def short_rows(df: DataFrame, text: str, key: str, limit: int = 10) -> DataFrame:
    """The first rows by key that are shorter than the 25th percentile."""
    p = df.agg(F.percentile(F.length(text), F.lit(0.25)).alias("p25"))
    return df.crossJoin(F.broadcast(p)).filter(F.length(text) < F.col("p25")).orderBy(key).limit(limit)


def tallied(df: DataFrame, *columns: str) -> DataFrame:
    """columns, n: how many rows have the same label sets. A row for each combination, kept: what is computed from it several times doesn't
    go through df again."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).persist()


def class_counts(df: DataFrame, true: str = "y_true", pred: str = "y_pred", n: str | None = None) -> DataFrame:
    """class, tp, fp, fn of label sets; one label is a set of one. A row counts as often as its column n says."""
    d = df.select(F.explode(F.array_distinct(F.concat(true, pred))).alias("class"), true, pred, (F.col(n) if n else F.lit(1)).cast("long").alias("n"))
    t, p = F.array_contains(true, F.col("class")), F.array_contains(pred, F.col("class"))
    of = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    return d.select("class", t.alias("t"), p.alias("p"), "n").groupBy("class").agg(of(F.col("t") & F.col("p")).alias("tp"), of(~F.col("t") & F.col("p")).alias("fp"), of(F.col("t") & ~F.col("p")).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_report(df: DataFrame, true: str = "y_true", pred: str = "y_pred", n: str | None = None) -> DataFrame:
    """class, precision, recall, f1, support: a row for each class, then the micro, macro, weighted and samples averages.

    Of rows, or with n of the rows of tallied().
    """
    df, n = (df, n) if n else (tallied(df, true, pred), "n")
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    scores = lambda a, b, c: (_ratio(a, a + b).alias("precision"), _ratio(a, a + c).alias("recall"), _ratio(2 * a, 2 * a + b + c).alias("f1"))
    counts = class_counts(df, true, pred, n)
    per = counts.select("class", *scores(tp, fp, fn), (F.col("tp") + F.col("fn")).alias("support"))
    micro = counts.agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("micro avg").alias("class"), *scores(tp, fp, fn), (tp + fn).cast("long").alias("support"))
    three = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(c).alias(c) for c in three], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *three, "support")
    weighted = per.agg(*[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in three], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *three, "support")
    both, t, p = F.size(F.array_intersect(true, pred)), F.size(F.array_distinct(true)), F.size(F.array_distinct(pred))
    rows = df.select(_ratio(both, p).alias("precision"), _ratio(both, t).alias("recall"), _ratio(2 * both, t + p).alias("f1"), t.alias("support"), F.col(n).alias("n"))
    samples = rows.agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in three], F.sum(F.col("support") * F.col("n")).alias("support")).select(F.lit("samples avg").alias("class"), *three, "support")
    return per.unionByName(micro).unionByName(macro).unionByName(weighted).unionByName(samples)


def subset_accuracy(df: DataFrame, true: str = "y_true", pred: str = "y_pred", n: str | None = None) -> DataFrame:
    """accuracy, n: of rows, or with n of the rows of tallied()."""
    same = F.array_sort(F.array_distinct(true)) == F.array_sort(F.array_distinct(pred))
    if n is None:
        return df.agg(F.avg(same.cast("double")).alias("accuracy"), F.count("*").alias("n"))
    known = F.when(same.isNotNull(), F.col(n))
    return df.agg((F.sum(same.cast("double") * F.col(n)) / F.sum(known)).alias("accuracy"), F.coalesce(F.sum(n), F.lit(0)).alias("n"))


def misclassified(df: DataFrame, text: str, key: str, limit: int = 5, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Rows whose predicted set isn't the true one, shortest text first."""
    wrong = F.array_sort(F.array_distinct(true)) != F.array_sort(F.array_distinct(pred))
    return df.filter(wrong).withColumn("text_length", F.length(text)).orderBy("text_length", key).limit(limit)


def failure_sizes(df: DataFrame, text: str, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """n_failing, mean_length, usual_length: of all rows whose predicted set isn't the true one, and of all rows; one row."""
    wrong = F.array_sort(F.array_distinct(true)) != F.array_sort(F.array_distinct(pred))
    n = F.length(text)
    return df.agg(F.count_if(wrong).alias("n_failing"), F.avg(F.when(wrong, n)).alias("mean_length"), F.avg(n).alias("usual_length"))


def failure_text(n_wrong: Column, mean_length: Column, n_conflicts: Column, usual_length: Column | None = None) -> Column:
    """The analysis of failures: how many there are; of each kind that occurs what they have in common and why; and what would help.

    Lengths are means, of the misclassified and of all functions.
    """
    usual = usual_length if usual_length is not None else F.lit(None).cast("double")
    length = F.when(usual.isNull(), F.format_string("- Misclassified functions are %.0f characters long on average.", mean_length))
    length = length.otherwise(F.format_string("- Misclassified functions are %.0f characters long on average, all functions %.0f.", mean_length, usual))
    short = F.when(usual.isNull(), "- Short ones, that get or set a value, carry few signals.")
    short = short.when(mean_length < usual, "- They are shorter than usual: short ones, that get or set a value, carry few signals.")
    short = short.otherwise("- They aren't shorter than usual: length doesn't tell them from others.")
    classified = F.concat_ws("\n", F.lit("Classification failures:"), F.when(mean_length.isNotNull(), F.concat_ws("\n", length, short)), F.lit("- Reason: functions of one form look alike, whatever they are for."))
    alike = "Similarity failures:\n- Functions whose vectors are alike have other labels.\n- Reason: vectors follow form more than effect.\n- Example: what reads a setting and what writes it may differ in one call."
    better = "Recommended improvements:\n1. Features of structure, as depth of control flow and kinds of statements, beside the vectors\n2. Larger embedders that were trained on C code\n3. More rows of rare labels: augmented or oversampled ones"
    pairs = F.when(n_conflicts > 0, F.format_string("%d pairs are alike but have other labels.", n_conflicts)).otherwise("No pair above the threshold has other labels.")
    found = F.concat_ws(" ", F.format_string("%d functions were misclassified.", n_wrong), pairs)
    return F.concat_ws("\n\n", found, F.when(n_wrong > 0, classified), F.when(n_conflicts > 0, F.lit(alike)), F.lit(better))


def label_purity(df: DataFrame, cluster: str, values: str) -> DataFrame:
    """cluster, n, purity: the share of the most common label set."""
    c = df.groupBy(cluster, F.array_join(F.array_sort(values), "+").alias("combo")).agg(F.count("*").alias("k"))
    return c.groupBy(cluster).agg(F.sum("k").alias("n"), (F.max("k") / F.sum("k")).alias("purity"))


def cluster_profile(df: DataFrame, cluster: str, values: str) -> DataFrame:
    """cluster, value, n: how often each label occurs in each cluster."""
    return df.select(cluster, F.explode(values).alias("value")).groupBy(cluster, "value").agg(F.count("*").alias("n"))


def _sizes(rows: DataFrame) -> list[tuple[int, int, int]]:
    """which, cluster, n of each cluster of each clustering, in order: a closed domain."""
    d = rows.select(F.posexplode("clusters").alias("which", "cluster")).groupBy("which", "cluster").agg(F.count("*").alias("n"))
    return sorted((r["which"], r["cluster"], r["n"]) for r in d.collect())


def _distance_sums(df: DataFrame, key: str, vec: str, clusters: Column) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """id, clusters, totals: how far each row is from each cluster's rows, in sum, in the order of the sizes, which are given too.

    Tiles of rows meet in bounded cells that return a row of sums for each of their rows, never pairs. A cell is two tiles and is gone
    through once for both. A vector is shuffled once for each tile, and so are its sums; tiles are few (TILE_BYTES).
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).cast("long").alias("id"), doubles(F.col(vec)).alias("v"), clusters.cast("array<int>").alias("clusters")).filter("v is not null")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = size["n"], size["width"] or 1
    sizes = _sizes(rows)
    places = {(w, c): i for i, (w, c, _) in enumerate(sizes)}
    # as many as a tile's bytes ask for, and enough for a cell for each core; a block at least
    tiles = max(-(-n * width * 8 // TILE_BYTES), int(np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism))))
    tiles = max(1, min(tiles, -(-n // BLOCK)))
    t = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    # a row goes to the cells (smaller number, larger number) that its tile is in
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda x: F.struct(F.least(x, "t").alias("i"), F.greatest(x, "t").alias("j")))).alias("cell")
    sides = rows.withColumn("t", t).select("*", cell).select("cell.i", "cell.j", "t", "id", "v", "clusters")
    schema = pa.schema([("id", pa.int64()), ("clusters", pa.list_(pa.int32())), ("totals", pa.list_(pa.float64()))])

    def sums(cell: pa.Table) -> pa.Table:
        blas_threads(1)  # a task has one core
        tile, ids = cell.column("t").to_numpy(), cell.column("id").to_numpy()
        v, own = (cell.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) for c in ("v", "clusters"))
        left, right = np.flatnonzero(tile == cell.column("i")[0].as_py()), np.flatnonzero(tile == cell.column("j")[0].as_py())
        same = cell.column("i")[0] == cell.column("j")[0]
        square = (v**2).sum(1)
        member = np.zeros((len(ids), len(places)))
        for w in range(own.shape[1]):
            names, at = np.unique(own[:, w], return_inverse=True)
            member[np.arange(len(ids)), np.array([places[w, int(c)] for c in names])[at]] = 1
        total = np.zeros((len(ids), len(places)))
        for a in range(0, len(left), BLOCK):
            x = left[a : a + BLOCK]
            for b in range(a if same else 0, len(right), BLOCK):
                y = right[b : b + BLOCK]
                d = v[x] @ v[y].T
                d *= -2
                d += square[x, None]
                d += square[None, y]
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                if same:  # equal ids are in one tile
                    d[ids[x][:, None] == ids[y][None]] = 0
                total[x] += d @ member[y]
                if not same or a != b:
                    total[y] += d.T @ member[x]
        out = [pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(own.ravel().astype(np.int32)), own.shape[1]).cast(schema.field(1).type), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), len(places)).cast(schema.field(2).type)]
        return pa.Table.from_arrays(out, schema=schema)

    found = sides.groupBy("i", "j").applyInArrow(sums, "id long, clusters array<int>, totals array<double>")
    added = F.array(*[F.sum(F.get("totals", F.lit(i))) for i in range(len(sizes))]) if sizes else F.array().cast("array<double>")
    return found.groupBy("id", "clusters").agg(added.alias("totals")), sizes


def _silhouette_rows(df: DataFrame, key: str, vec: str, clusters: Column) -> DataFrame:
    """id, which, cluster, silhouette, by Euclidean distance, exactly."""
    j, sizes = _distance_sums(df, key, vec, clusters)
    one = []
    for w in sorted({w for w, _, _ in sizes}):
        to = F.array(*[F.struct(F.lit(c).alias("other"), F.lit(n).cast("long").alias("n"), F.get("totals", F.lit(i)).alias("total")) for i, (x, c, n) in enumerate(sizes) if x == w])
        one.append(F.struct(F.lit(w).alias("which"), F.get("clusters", F.lit(w)).alias("cluster"), to.alias("to")))
    if not one:
        return df.sparkSession.createDataFrame([], "id long, which int, cluster int, silhouette double")
    s = j.select("id", F.explode(F.array(*one)).alias("one")).select("id", "one.*")
    mine = F.get(F.filter("to", lambda x: x["other"] == F.col("cluster")), F.lit(0))
    s = s.select("id", "which", "cluster", mine["n"].alias("size"), _ratio(mine["total"], mine["n"] - 1).alias("a"), F.array_min(F.transform(F.filter("to", lambda x: x["other"] != F.col("cluster")), lambda x: x["total"] / x["n"])).alias("b"))
    value = F.when((F.col("size") <= 1) | F.col("b").isNull(), 0.0).otherwise(_ratio(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return s.select("id", "which", "cluster", value.alias("silhouette"))


def silhouette_rows(df: DataFrame, key: str, vec: str, cluster: str) -> DataFrame:
    """id, cluster, silhouette of each row."""
    return _silhouette_rows(df, key, vec, F.array(cluster)).select("id", "cluster", "silhouette")


def silhouette(df: DataFrame, key: str, vec: str, cluster: str) -> DataFrame:
    return silhouette_rows(df, key, vec, cluster).agg(F.avg("silhouette").alias("silhouette"), F.count("*").alias("n"))


def silhouettes(df: DataFrame, key: str, vec: str, clusters: str) -> DataFrame:
    """which, silhouette, n: of several clusterings, an array column, from the same distances."""
    return _silhouette_rows(df, key, vec, F.col(clusters)).groupBy("which").agg(F.avg("silhouette").alias("silhouette"), F.count("*").alias("n"))


def threshold_search(scores: DataFrame, grid: tuple[float, ...] = tuple(i / 10 for i in range(1, 10)), default: float = 0.5) -> DataFrame:
    """class, threshold, f1: for each class the first threshold with the best F1. Of (class, score, truth boolean)."""
    s = scores.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    hit = F.col("score") >= F.col("threshold")
    f = s.groupBy("class", "threshold").agg(F.count_if(hit & F.col("truth")).alias("tp"), F.count_if(hit & ~F.col("truth")).alias("fp"), F.count_if(~hit & F.col("truth")).alias("fn"))
    f = f.withColumn("f1", _ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")))
    best = f.groupBy("class").agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("best"))
    return best.select("class", F.when(F.col("best.f1") > 0, F.col("best.threshold")).otherwise(default).alias("threshold"), "best.f1")


def overfit_status(train_f1: Column, test_f1: Column) -> Column:
    gap = train_f1 - test_f1
    return F.when(gap > 0.15, "OVERFITTING").when(gap < -0.05, "UNDERFITTING").otherwise("OK")


def hashed_sample(df: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """The same n rows each time: those with the smallest digest of their key."""
    return df.orderBy(seeded_digest(F.col(key), seed), key).limit(n)


def report(df: DataFrame, neighbours_overlap: DataFrame, clusters: DataFrame, failures: DataFrame, effects: str = "y_true", conflicts: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """One row of nested structs. df: y_true, y_pred; neighbours_overlap: q, overlap; clusters: cluster, n, purity; failures: some
    misclassified rows, with text_length; conflicts: pairs q, c, sim of alike rows with other labels; sizes: failure_sizes() of all rows,
    without which what is said of failures is of df and of the failures given."""
    same = tallied(df, "y_true", "y_pred") if effects in ("y_true", "y_pred") else tallied(df, "y_true", "y_pred", effects)
    occurring = same.select("n", F.explode(effects).alias("value")).groupBy("value").agg(F.sum("n").alias("n"))
    stats = occurring.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("side_effect_distribution"))
    stats = stats.crossJoin(same.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_functions"))).select(F.struct("total_functions", "side_effect_distribution").alias("dataset_stats"))
    r = classification_report(same, n="n")
    metrics = r.agg(F.max(F.when(F.col("class") == "macro avg", F.col("f1"))).alias("f1_macro"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", F.struct("precision", "recall", "f1", "support"))))).alias("classification_report"))
    accuracy = subset_accuracy(same, n="n").select("accuracy", F.round((1 - F.coalesce("accuracy", F.lit(1.0))) * F.col("n")).cast("long").alias("n_wrong"))
    metrics = metrics.crossJoin(accuracy).select(F.struct("f1_macro", "accuracy", "classification_report").alias("classification_metrics"), "n_wrong")
    sim = neighbours_overlap.agg(F.struct(F.count("*").alias("num_queries"), F.avg("overlap").alias("average_side_effect_overlap")).alias("similarity_metrics"))
    clu = clusters.agg(F.struct(F.count("*").alias("n_clusters"), F.avg("purity").alias("average_label_purity"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("cluster").cast("string"), "n")))).alias("cluster_sizes")).alias("clustering_metrics"))
    length = F.avg("text_length") if "text_length" in failures.columns else F.lit(None).cast("double")
    fail = failures.agg(F.to_json(F.collect_list(F.struct(*failures.columns))).alias("failure_analysis"), length.alias("mean_length"))
    if sizes is None:
        fail = fail.withColumn("usual_length", F.lit(None).cast("double")).withColumn("n_failing", F.lit(None).cast("long"))
    else:
        fail = fail.drop("mean_length").crossJoin(sizes.select("n_failing", "mean_length", "usual_length"))  # one row each
    some = conflicts if conflicts is not None else df.sparkSession.createDataFrame([], "q long, c long, sim double")
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("by"), "q", "c", "sim"))), 1, 5)
    few = some.orderBy(F.desc("sim"), "q", "c").limit(5).agg(F.transform(first, lambda p: F.struct(p["q"].alias("q"), p["c"].alias("c"), p["sim"].alias("sim"))).alias("conflicting_pairs"))
    few = few.crossJoin(some.agg(F.count("*").alias("n_conflicts")))
    out = stats.crossJoin(metrics).crossJoin(sim).crossJoin(clu).crossJoin(fail).crossJoin(few)  # one row each
    text = failure_text(F.coalesce("n_failing", "n_wrong"), F.col("mean_length"), F.col("n_conflicts"), F.col("usual_length")).alias("failure_text")
    return out.select("dataset_stats", "classification_metrics", "similarity_metrics", "clustering_metrics", "failure_analysis", "conflicting_pairs", text)


def summary_scores(df: DataFrame) -> DataFrame:
    """f1_macro, f1_micro, accuracy of y_true and y_pred, one row."""
    f1 = lambda c: F.max(F.when(F.col("class") == f"{c} avg", F.col("f1"))).alias(f"f1_{c}")
    same = tallied(df, "y_true", "y_pred")
    return classification_report(same, n="n").agg(f1("macro"), f1("micro")).crossJoin(subset_accuracy(same, n="n").select("accuracy"))
