"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

A document's set holds the 64-bit hashes of its distinct five-word shingles. The sketch has T coordinates and is
filled in rounds of hashed bin placement: in round i < T every element goes to a hashed bin with a hashed value;
in round T + j every element goes to bin j. A bin keeps the smallest (round, value), so after at most 2T rounds
each is full, whatever the set's size; two sketches agree in a coordinate with probability J, and the count of
agreements is as concentrated as if coordinates were independent.

Steps: documents with the same set are one node. Bands of ROWS coordinates give buckets; every member is paired
with the bucket's smallest node only, so pairs grow with members. Pairs are confirmed on the full sets of their
texts. Buckets whose other members are still in several components are gone through again, exactly: members
outside the bucket's largest component meet members of other components, in cells of two bounded blocks, which
compare full sets and return links only. The rows of a band follow from the threshold (band_rows): a pair at it shares
no bucket with probability (1 - 0.85^5)^25 = 5e-7 at 85 percent, (1 - 0.8^4)^32 = 5e-8 at 80.

Defined cases: a null or wordless text has the empty set and links with nothing; with fewer than five words the
whole sequence is the one shingle; a null doc_id takes no part (its component is null and it is kept); rows with one
doc_id are versions of one document: each has a result row, whatever links with one of its texts links with it, and one of
them stays; very long texts are sketched whole, once each; an empty table gives no rows; other columns are ignored,
whatever their names; doc_id must be a number.

Skew: the rows of a set, of a bucket's smallest node and of a component are dealt to several tasks in joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import blas_threads
from .common import SALTS, drop_stored, ship, small, spread_join, stored
from .graph import components
from .spans import batch

SHINGLE_WORDS = 5
#: Linked if 100 * intersection >= percent * union; this is the default.
PERCENT = 85
T = 128
#: The largest probability that a pair at the threshold shares no bucket.
MISSED = 1e-6
#: Members of a block; two blocks make a cell. Elements whose 0/1 columns are held at once.
BLOCK, SLICE = 256, 8192
WORDS_KEPT = 200_000

_U = np.uint64
_STEP = [_U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_BIN_BITS = 7
_ROUND_BITS = 8
_BASE = np.arange(2 * T, dtype=np.uint64) * _U(0xD1342543DE82EF95) + _U(0x632BE59BD9B4E019)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def band_rows(percent: int) -> int:
    """The most coordinates of a band by which at most MISSED of the pairs at the threshold share no bucket, 1 if none do."""
    return max((r for r in range(1, len(_STEP) + 1) if (1 - (percent / 100) ** r) ** (T // r) <= MISSED), default=1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < SHINGLE_WORDS:
        return _mixed(reduce(np.add, (w[i : i + 1] * _STEP[i] for i in range(n))) + _U(n))
    m = n - SHINGLE_WORDS + 1
    return np.unique(_mixed(reduce(np.add, (w[i : i + m] * _STEP[i] for i in range(SHINGLE_WORDS))) + _U(SHINGLE_WORDS)))


def sketch(s: np.ndarray) -> np.ndarray:
    """T coordinates of a set that isn't empty: for each bin its smallest (round, value), as one number."""
    full = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    low = _U(64 - _BIN_BITS)
    keep = _U((1 << (64 - _BIN_BITS - _ROUND_BITS)) - 1)
    done = 0
    while done < T:
        rounds = min(T - done, max(1, -(-900 // len(s)))) if done == 0 else min(T - done, max(1, -(-300 // len(s))))
        at = np.arange(done, done + rounds)
        g = _mixed(s[None, :] ^ _BASE[at][:, None])
        key = (g & ~((_U(1) << low) - _U(1))) | (at.astype(np.uint64) << _U(64 - _BIN_BITS - _ROUND_BITS))[:, None] | (g & keep)
        key = np.sort(key, axis=None)
        b = (key >> low).astype(np.intp)
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        full[b[first]] = np.minimum(full[b[first]], key[first] & ((_U(1) << low) - _U(1)))
        done += rounds
        if not (empty := full == np.iinfo(np.uint64).max).any():
            return full
    for j in np.flatnonzero(empty):
        v = (_mixed(s ^ _BASE[T + j]) & keep).min()
        full[j] = (_U(T + j) << _U(64 - _BIN_BITS - _ROUND_BITS)) | v
    return full


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketches(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    ship(documents.sparkSession)
    size = band_rows(percent)
    n = T // size

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text)
                if not len(s):
                    rows.append((doc_id, 0, None, None))
                    continue
                k = sketch(s)
                bands = _mixed(reduce(np.add, (k[i : n * size : size] * _STEP[i] for i in range(size))) + np.arange(n, dtype=np.uint64))
                rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands.view(np.int64)))
            yield batch(_SKETCHED, rows)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketched, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _linking(percent: int):
    """Of rows in the order of (b, part): the texts of a node b without a, then those of nodes a that are compared with it."""

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict[str, np.ndarray] = {}  # versions of one document
        of, members = None, False
        for pdf in batches:
            out = []
            for a, b, text in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["text"], strict=True):
                if not isinstance(a, str):
                    if members or b != of:
                        near.clear()
                    of, members = b, False
                    near.setdefault(text, shingles(text))
                    continue
                members, x = True, shingles(text)
                for y in near.values():
                    both = np.intersect1d(x, y, assume_unique=True).size
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        out.append((int(a), b))
                        break
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return linked


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the stored ids, stored."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(d.join(small(ids, ids.count()), d["doc_id"] == ids["id"], "left_semi"), "texts")


def confirmed(pairs: DataFrame, documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The stored pairs (a, b) whose full sets are similar enough.

    A node b may be the smallest of many buckets' members: those are dealt to parts by a, b's text goes once to each part, and a
    part is gone through in order, so only one text's set is held.
    """
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = texts_of(documents, ids)
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("part"))
    far = pairs.select("b", "part").distinct().join(texts.withColumnRenamed("doc_id", "b"), "b").select(F.lit(None).cast("string").alias("a"), "b", "part", "text")
    own = pairs.join(texts.withColumnRenamed("doc_id", "a"), "a").select(F.col("a").cast("string").alias("a"), "b", "part", "text")
    rows = far.unionByName(own).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    found = stored(rows.select("a", "b", "text").mapInPandas(_linking(percent), "a long, b long"), "confirmed")
    drop_stored(ids, texts)
    return found


def common_counts(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the sets in rows with all sets, by products of 0/1 matrices over slices of the elements."""
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(x, kind="stable")
    x, owner = x[order], owner[order]
    at = np.cumsum(np.r_[False, x[1:] != x[:-1]])
    shared = np.bincount(at)[at] > 1
    owner, at = owner[shared], at[shared]
    out = np.zeros((len(rows), len(sets)), np.float32)
    if len(at):
        at = np.cumsum(np.r_[False, at[1:] != at[:-1]])
        for lo in range(0, int(at[-1]) + 1, SLICE):
            here = slice(*np.searchsorted(at, (lo, lo + SLICE)))
            m = np.zeros((len(sets), SLICE), np.float32)
            m[owner[here], at[here] - lo] = 1
            out += m[rows] @ m.T
    return out


def _forest(a: np.ndarray, b: np.ndarray, items: np.ndarray) -> list[int]:
    """The items whose link (a, b) joins what those before it didn't."""
    above: dict[int, int] = {}

    def top(n: int) -> int:
        while (m := above.get(n, n)) != n:
            above[n] = n = above.get(m, m)
        return n

    out = []
    for x, y, item in zip(a.tolist(), b.tolist(), items.tolist(), strict=True):
        if (p := top(x)) != (q := top(y)):
            above[max(p, q)] = min(p, q)
            out.append(item)
    return out


_LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _cell_links(cell: pa.Table, percent: int) -> pa.Table:
    """Links of a cell between members of the rest and of other components, confirmed on full sets: as many as join what the cell's links join."""
    blas_threads(1)  # a task has one core
    node, comp, blk, rest = (cell.column(c).to_numpy() for c in ("node", "comp", "blk", "rest"))
    i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    rows = np.flatnonzero(rest & (blk == i))
    if not len(rows) or len(rows) == len(node) == 1:
        return _LINKS_ARROW.empty_table()
    sets = [shingles(t) for t in cell.column("text").to_pylist()]
    n = np.array([len(s) for s in sets])
    both = common_counts(sets, rows)
    near = 100 * both >= percent * (n[rows][:, None] + n[None] - both)
    near &= (comp[rows][:, None] != comp[None]) & ((rest & (blk == j)) if j >= 0 else ~rest)[None]
    x, y = np.nonzero(near)
    left, right = comp[rows[x]], comp[y]
    _, first = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)]), axis=1, return_index=True)
    first = _forest(left[first], right[first], first)
    return pa.table({"a": node[rows[x[first]]], "b": node[y[first]]}, schema=_LINKS_ARROW)


def remaining_links(buckets: DataFrame, labels: DataFrame, documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The links that buckets hold besides those with their smallest node, where they can still join components.

    Buckets with the same members count once. A cell is two blocks of a bucket, so it is bounded whatever the
    bucket's size; cells return links, not pairs.
    """
    b = spread_join(buckets, labels, "node", "key", "left").withColumn("comp", F.coalesce("comp", "node")).filter(F.col("node") != F.col("pivot"))
    members = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"))
    mixed = b.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), members.alias("members")).filter("lo <> hi")
    mixed = mixed.groupBy("members").agg(F.min("key").alias("key")).select("key")
    b = several = stored(spread_join(b, mixed, "key", "node"), "mixed")
    sizes = b.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"))
    sizes = sizes.select("key", F.col("top.comp").alias("core"), (F.col("n") - F.col("top.n")).alias("n_rest"), F.col("top.n").alias("n_core"))
    b = spread_join(b, sizes, "key", "node")
    b = b.withColumn("rest", F.col("comp") != F.col("core"))
    rb, cb = F.ceil(F.col("n_rest") / BLOCK).cast("int"), F.ceil(F.col("n_core") / BLOCK).cast("int")
    b = b.withColumn("rb", rb).withColumn("cb", cb).withColumn("blk", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rb")).otherwise(F.col("cb"))).cast("int"))
    own = F.col("blk")
    # cells: (i, j) of two blocks of the rest, and (i, -1 - c) of a block of the rest and block c of the core
    rest_cells = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("rb") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"))),
        F.transform(F.sequence(F.lit(0), F.col("cb") - 1), lambda x: F.struct(own.alias("i"), (-1 - x).alias("j"))),
    )
    core_cells = F.transform(F.sequence(F.lit(0), F.col("rb") - 1), lambda x: F.struct(x.alias("i"), (-1 - own).alias("j")))
    cells = b.withColumn("cell", F.explode(F.when(F.col("rest"), rest_cells).otherwise(core_cells))).select("key", "node", "comp", "rest", "blk", "cell.i", "cell.j")
    ids = stored(b.select(F.col("node").alias("id")).distinct(), "ids")
    texts = texts_of(documents, ids)

    def cell_links(cell: pa.Table) -> pa.Table:
        return _cell_links(cell, percent)

    found = stored(cells.join(texts.withColumnRenamed("doc_id", "node"), "node").groupBy("key", "i", "j").applyInArrow(cell_links, "a long, b long").distinct(), "remaining")
    drop_stored(several, ids, texts)
    return found


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    s = stored(sketches(documents, percent).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "sketches")
    # a set's smallest document, by way of the parts of its rows, since a third of all rows may have one set
    parts = s.filter("digest is not null and doc_id is not null").groupBy("digest", "part").agg(F.min("doc_id").alias("least"))
    groups = stored(parts.select("digest", "part", F.min("least").over(Window.partitionBy("digest")).alias("node")), "groups")
    of = s.drop("bands").join(groups, ["digest", "part"], "left").withColumn("node", F.coalesce("node", "doc_id"))
    of = stored(of.select("doc_id", "n_shingles", "digest", "node"), "nodes_of")
    nodes = stored(s.join(groups, ["digest", "part"]).filter("doc_id = node").select("node", "digest", "bands").dropDuplicates(["node", "digest"]), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    # a bucket's smallest node the same way
    rows, one = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SALTS))), Window.partitionBy("key")
    parts = rows.groupBy("key", "part").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    pivots = parts.select("key", "part", F.min("least").over(one).alias("pivot"), F.sum("n").over(one).alias("n")).filter("n > 1").drop("n")
    buckets = stored(rows.join(pivots, ["key", "part"]).drop("part"), "buckets")
    pairs = stored(buckets.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    confirmed_links = confirmed(pairs, documents, percent)
    # versions of one document: its id may be in several sets
    ids = of.filter("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    versions = stored(of.filter("digest is not null").select("doc_id", "node").join(ids.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b").distinct(), "versions")
    drop_stored(s, groups, nodes, pairs)
    links = confirmed_links.union(versions)
    labels = components(links)
    more = remaining_links(buckets, labels, documents, percent)
    drop_stored(buckets, labels)
    labels = components(links.union(more))
    drop_stored(confirmed_links, versions, more)
    out = spread_join(of, labels, "node", "doc_id", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents with one document of each component; of rows with one doc_id, one."""
    found = stored(near_duplicates(documents, percent), "components")
    kept = found.filter("kept").groupBy("doc_id").agg(F.count("*").alias("n"))
    gone = stored(found.filter("not kept").select("doc_id").distinct(), "gone")
    out = documents.join(small(gone, gone.count()), "doc_id", "left_anti")
    twice = stored(kept.filter("n > 1 and doc_id is not null").select("doc_id"), "twice")
    n = twice.count()
    if not n:
        return out.select(documents.columns)
    return out.join(small(twice, n), "doc_id", "left_anti").unionByName(out.join(small(twice, n), "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(documents.columns)
