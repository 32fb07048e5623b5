"""Mixing sources to target weights, with DataFrame operations only.

The words of each source are packed into blocks of `block_words` (the last one may be shorter), documents in
a pseudorandom but fixed order. The output is a row of slots, cut into shards. For each shard the numbers of
slots by source are drawn from the multinomial distribution given the sources' totals: a pseudorandom
permutation of all slots (swap-or-not, a bijection on any range, without cycle walking) deals each source's
slots to shards, and they are counted. Slot k of a source takes the block to which the source's own
permutation maps k modulo its number of blocks, another permutation for each pass. Blocks are joined by
index. The last slot of a source is cut so that its words come to its target exactly; the short block comes
last in its pass.

Defined cases: a null text has size 0; sources of size 0 have target 0; null is a source, the last one;
repeated rows are documents of their own; an empty table gives no rows; other columns of documents are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, small, stored, word_count

#: Fixed values of the contract.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
ROUNDS = 20
#: Slots that one row makes at most.
CHUNK = 65_536


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by key, puts x: rounds of swap-or-not."""

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.pmod(F.xxhash64(*key, r, F.greatest(at, partner)), F.lit(2)) == 1, partner).otherwise(at)

    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), x, step)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Of (source, size): source, sid, source_size, target. A row for each source, so the windows stay small.

    Target = min(cap, level * weight), with the level at which the targets add up to share * all sizes.
    Sorted by cap / weight, the capped sources come first.
    """
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("sid", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    t = t.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights)).cast("int"))).withColumn("cap", cap * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    every = Window.partitionBy()
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("left_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("own_level", (share * F.sum("source_size").over(every) - F.col("before")) / F.col("left_weight"))
    level = F.max(F.when(F.col("cap") / F.col("weight") > F.col("own_level"), F.col("own_level"))).over(every)
    t = t.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))))
    return t.select("source", "sid", "source_size", "target")


def placed(sizes: DataFrame, targets: DataFrame, n_docs: int, n_sources: int) -> DataFrame:
    """sizes with sid, source_size, target and start, the words of the source before the document.

    Prefix sums in two levels: over buckets of a hash, about sqrt(n) of them, then within (source, bucket).
    """
    buckets = max(1, math.isqrt(n_docs))
    d = sizes.join(small(targets, n_sources), sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(buckets)).cast("int"))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("in_bucket")
    sums = sums.select("sid", "bucket", before.alias("bucket_start"))
    within = Window.partitionBy("sid", "bucket").orderBy("doc_id", "h", "copy").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(sums, ["sid", "bucket"]).withColumn("start", F.col("bucket_start") + F.sum("size").over(within) - F.col("size"))
    return d.drop("bucket", "bucket_start")


def slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 8) -> DataFrame:
    """The mix: a row for each slot with shard, sid, k, pass_no, block and take (words, from the block's start)."""
    b, size, goal = F.lit(block_words), F.col("source_size"), F.round("target").cast("long")
    t = targets.filter((size > 0) & (goal > 0)).withColumn("goal", goal).withColumn("passes", F.expr("goal div source_size"))
    t = t.withColumn("rest", F.col("goal") - F.col("passes") * size).withColumn("blocks", F.ceil(size / b).cast("long")).withColumn("whole", F.expr(f"source_size div {block_words}"))
    t = t.withColumn("n_slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / b).cast("long"))
    t = t.withColumn("first", F.sum("n_slots").over(Window.orderBy("sid")) - F.col("n_slots")).withColumn("all_slots", F.sum("n_slots").over(Window.partitionBy()))
    known = t.select("sid", "source_size", "passes", "rest", "blocks", "whole")
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: few rows here make many slots
    x = t.select("sid", "first", "n_slots", "all_slots", F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {CHUNK})")).alias("chunk")).repartition(tasks, "sid", "chunk")
    x = x.select("sid", "all_slots", F.explode(F.expr(f"sequence(first + chunk * {CHUNK}, first + least(n_slots, (chunk + 1) * {CHUNK}) - 1)")).alias("x"))
    shard = F.floor(permuted(F.col("x"), F.col("all_slots"), F.lit(seed)) / F.lit(shard_slots)).alias("shard")
    drawn = x.select("sid", shard).groupBy("shard", "sid").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")
    s = drawn.withColumn("base", base).repartition(tasks, "shard", "sid").select("shard", "sid", F.explode(F.sequence("base", F.col("base") + F.col("n") - 1)).alias("k"))
    s = s.join(known, "sid").withColumn("pass_no", F.expr("k div blocks")).withColumn("i", F.col("k") % F.col("blocks"))
    block = F.when(F.col("i") < F.col("whole"), permuted(F.col("i"), F.greatest(F.col("whole"), F.lit(1)), F.lit(seed), F.col("sid"), F.col("pass_no"))).otherwise(F.col("i"))
    take = F.when(F.col("pass_no") < F.col("passes"), b.cast("long")).otherwise(F.least(b.cast("long"), F.col("rest") - F.col("i") * b))
    return s.select("shard", "sid", "k", "pass_no", block.alias("block"), take.alias("take"))


def pieces(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The part of each document in each block: lo and hi count from the block's start."""
    p = docs.filter(F.col("size") > 0).withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    at = F.col("block") * block_words
    return p.withColumn("lo", F.greatest(F.col("start") - at, F.lit(0))).withColumn("hi", F.least(F.col("start") + F.col("size") - at, F.lit(block_words)))


def sized(documents: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, h (of the text), size and copy, which tells repeated rows apart."""
    d = documents.select("doc_id", "source", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("size"), *keep)
    return d.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy(F.col("source").asc_nulls_last())))


def prepared(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The placed documents and the sources' targets, both stored."""
    sizes = stored(sized(documents), "sizes")
    targets = stored(source_targets(sizes), "targets")
    return stored(placed(sizes, targets, sizes.count(), targets.count()), "placed"), targets


def mix_counts(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document."""
    docs, targets = prepared(documents)
    whole = F.col("take") == block_words
    per_block = slots(targets, block_words).groupBy("sid", "block").agg(F.count_if(whole).alias("times"), F.coalesce(F.max(F.when(~whole, F.col("take"))), F.lit(0)).alias("cut"))
    p = pieces(docs, block_words).join(per_block, ["sid", "block"], "left")
    got = F.coalesce("times", F.lit(0)) * (F.col("hi") - F.col("lo")) + F.greatest(F.lit(0), F.least("hi", F.coalesce("cut", F.lit(0))) - F.col("lo"))
    keys = ["doc_id", "size", "source_size", "target"]
    taken = p.groupBy("sid", "start", *keys).agg(F.sum(got).alias("taken")).select(*keys, "taken")
    return taken.unionByName(docs.filter(F.col("size") == 0).select(*keys, F.lit(0).cast("long").alias("taken")))


def mixed_documents(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents with the text that the mix takes: the words of its pieces, pass by pass, a line for each pass.

    A document that a pass takes whole keeps its text for that pass as it is; one that is never taken goes.
    """
    docs, targets = prepared(documents)
    keys = ["doc_id", "h", "copy"]
    p = pieces(docs, block_words).join(slots(targets, block_words).select("sid", "block", "pass_no", "take"), ["sid", "block"])
    p = p.withColumn("upto", F.least("hi", "take")).filter(F.col("upto") > F.col("lo"))
    p = p.select(*keys, "size", "pass_no", (F.col("block") * block_words + F.col("lo") - F.col("start")).alias("at"), (F.col("upto") - F.col("lo")).alias("n"))
    p = p.groupBy(*keys, "size", "pass_no").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("n").cast("int").alias("n")))).alias("parts"))
    p = p.withColumn("parts", F.when(F.col("n") == F.col("size"), None).otherwise(F.col("parts")))
    p = p.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pass_no", "parts"))).alias("passes"))
    p = p.select(F.col("doc_id").alias("_fn_id"), F.col("h").alias("_fn_ph"), F.col("copy").alias("_fn_pc"), F.col("passes").alias("_fn_passes"))
    d = documents.withColumn("_fn_h", F.xxhash64("text"))
    d = d.withColumn("_fn_c", F.row_number().over(Window.partitionBy("doc_id", "_fn_h").orderBy(F.col("source").asc_nulls_last())))
    j = d.join(p, d["doc_id"].eqNullSafe(p["_fn_id"]) & (d["_fn_h"] == p["_fn_ph"]) & (d["_fn_c"] == p["_fn_pc"]))
    j = j.withColumn("_fn_words", F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), SPACE))
    part = lambda y: F.array_join(F.slice("_fn_words", y["at"] + 1, y["n"]), " ")
    line = lambda x: F.when(x["parts"].isNull(), F.col("text")).otherwise(F.array_join(F.transform(x["parts"], part), " "))
    j = j.withColumn("text", F.array_join(F.transform("_fn_passes", line), "\n"))
    return j.select([F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in documents.columns])
