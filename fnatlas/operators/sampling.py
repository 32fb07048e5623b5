"""More rows of rare classes: synthetic minority oversampling.

Each class gets as many rows as the largest one (or a given number). A new row stands on the segment between a row and one of
its k nearest rows of the same class, by cosine; which row, which neighbour and where on the segment are hashes of the row's key, so reruns agree.
Neighbours are found exactly, class by class, by the same operator as everywhere; the large class is left as it is.

Defined cases: rows without key, class or vector go through and take no part; a class of one row repeats it; keys must differ; an empty
table gives no rows. Only what is given is read: give training rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, unit
from .similarity import DIGITS, top_k


def _unit_hash(*cols: Column | str) -> Column:
    """A number from 0 to 1, below 1, by a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def wanted(df: DataFrame, label: str, upto: int | None = None) -> DataFrame:
    """label, n, more: how many rows each class has and lacks. A row for each class, a closed domain."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    top = c.agg(F.max("n").alias("top"))
    target = F.lit(upto) if upto else F.col("top")
    return c.crossJoin(F.broadcast(top)).select(label, "n", F.greatest(target - F.col("n"), F.lit(0)).cast("long").alias("more"))


def oversampled(df: DataFrame, key: str, vec: str, label: str, k: int = 5, upto: int | None = None, seed: int = 42) -> DataFrame:
    """df's key, vec and label with new rows besides, whose key is null; made_of, towards: the keys of the rows it stands between; share: where."""
    given = df.select(F.col(key).cast("long").alias(key), doubles(F.col(vec)).alias(vec), label)
    out = given.withColumn("made_of", F.lit(None).cast("long")).withColumn("towards", F.lit(None).cast("long")).withColumn("share", F.lit(None).cast("double"))
    rows = given.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull())
    need = wanted(rows, label, upto)
    less = need.filter("more > 0")
    few = [r[label] for r in less.select(label).collect()]  # names of classes
    if not few:
        return out
    # a row of the class is the start of n_each new rows, one more for the first by hash
    minority = rows.join(F.broadcast(less), label)
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key))
    each = minority.withColumn("_r", place).withColumn("_n", (F.floor(F.col("more") / F.col("n")) + (F.col("_r") <= F.col("more") % F.col("n")).cast("long")).cast("int"))
    starts = each.filter("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), "_n")))
    near = None
    for name in few:
        own = rows.filter(F.col(label) == name).select(F.col(key).alias("id"), unit(F.col(vec)).alias("v"))
        one = top_k(own, own, k)
        near = one if near is None else near.unionByName(one)
    lists = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "c"))).alias("near"))
    s = starts.join(lists, starts[key] == lists["q"], "left")
    pick = F.when(F.col("near").isNotNull(), F.get(F.col("near.c"), F.floor(_unit_hash(key, "_i", F.lit(seed + 1)) * F.size("near")).cast("int")))
    s = s.withColumn("towards", F.coalesce(pick, F.col(key))).withColumn("share", F.round(_unit_hash(key, "_i", F.lit(seed + 2)), DIGITS))
    other = rows.select(F.col(key).alias("towards"), F.col(vec).alias("_other"))
    made = s.join(other, "towards").withColumn("_at", F.zip_with(vec, "_other", lambda a, b: a + F.col("share") * (b - a)))
    new = made.select(F.lit(None).cast("long").alias(key), F.col("_at").alias(vec), label, F.col(key).alias("made_of"), "towards", "share")
    return out.unionByName(new)
