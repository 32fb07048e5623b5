"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are hashed to shards of about SHARD_ROWS rows. A shard's graph is built by insertion: a vector's level is
drawn from its hash, the graph is searched from the top for close vectors, and links are chosen by the diversity
rule and cut to M (2 M at the bottom). It is stored as one row of flat arrays: ids, vectors, offsets of each vector's
rows, and neighbours, -1 for none. Equal vectors of a shard are one vertex with a list of ids, so that a
common vector makes no clique. Queries go in blocks to every shard, and a shard goes once to each SLICE of these blocks;
each returns its nearest, and the merge keeps the K nearest of all. Distances are recomputed in double precision on the
original vectors. A search whose K-th distance is also that of the farthest vertex it kept is widened, at last to the whole
shard, so that of equally near vectors the smaller ids are taken, however many they are.

Defined cases: vectors that are null, empty, zero or have null or non-finite parts take no part; vectors of another
length are searched among their own kind; repeated ids count once, at the smallest distance between any two of the
query's and the candidate's vectors; with fewer
candidates than K all are returned; an empty table gives no rows; other columns are ignored. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import blas_threads
from .common import ship, small, stored

SHARD_ROWS = 8192
M, BUILD, SEARCH = 16, 80, 160
K = 10
#: Queries of a block, and blocks that a copy of a shard serves.
QUERY_BLOCK, SLICE = 256, 4


class Graph:
    """The vertices' vectors (float64), links by level as one int32 array per level, and each vertex's level."""

    def __init__(self, vectors: np.ndarray, seed: int = 2) -> None:
        self.x = np.ascontiguousarray(vectors, np.float64)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        n = len(self.x)
        u = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(1 - u) / math.log(M)).astype(int), 12)
        top = int(self.level.max()) if n else 0
        self.links = [np.full((n, 2 * M if lv == 0 else M), -1, np.int32) for lv in range(top + 1)]
        self.entry = 0

    def search(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef vertices nearest to q that greedy search from start finds, nearest first, with squared distances."""
        links, x, sq = self.links[level], self.x, self.sq
        seen = np.zeros(len(x), bool)
        for _, v in start:
            seen[v] = True
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, v) for d, v in start]
        heapq.heapify(best)
        while todo:
            d, v = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            near = links[v]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            dist = sq[near] - 2.0 * (x[near] @ q)
            if len(best) >= ef:
                good = dist < -best[0][0]
                near, dist = near[good], dist[good]
            for e, w in zip(dist.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-e, w))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, w))
                else:
                    continue
                heapq.heappush(todo, (e, w))
        return sorted((-d, v) for d, v in best)

    def chosen(self, v: int, cands: list[int], dist: np.ndarray, most: int) -> list[int]:
        """The diversity rule: nearest first, those closer to v than to any chosen one; then the rest until full."""
        sub = self.x[cands]
        own = self.sq[cands]
        between = own[:, None] + own[None, :] - 2.0 * (sub @ sub.T)
        order = np.argsort(dist, kind="stable")
        taken: list[int] = []
        least = np.full(len(cands), np.inf)
        for i in order.tolist():
            if len(taken) == most:
                break
            if dist[i] < least[i]:
                taken.append(i)
                np.minimum(least, between[i], out=least)
        if len(taken) < most:
            have = set(taken)
            taken += [i for i in order.tolist() if i not in have][: most - len(taken)]
        return [cands[i] for i in taken]

    def insert(self, v: int) -> None:
        q, lv, top = self.x[v], int(self.level[v]), int(self.level[self.entry])
        at = [(float(self.sq[self.entry] - 2.0 * (self.x[self.entry] @ q)), self.entry)]
        for k in range(top, lv, -1):
            at = self.search(q, at[:1], 1, k)
        for k in range(min(lv, top), -1, -1):
            at = self.search(q, at, BUILD, k)
            links = self.links[k]
            most = links.shape[1]
            cands = [w for _, w in at]
            near = self.chosen(v, cands, np.array([d for d, _ in at]) + self.sq[v], M)
            links[v, : len(near)] = near
            for w in near:
                row = links[w]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = v
                else:
                    them = [*row.tolist(), v]
                    d = self.sq[them] - 2.0 * (self.x[them] @ self.x[w]) + self.sq[w]
                    keep = self.chosen(w, them, d, most)
                    row[:] = -1
                    row[: len(keep)] = keep
        if lv > top:
            self.entry = v

    def build(self) -> Graph:
        for v in range(1, len(self.x)):
            self.insert(v)
        return self

    def nearest(self, q: np.ndarray, ef: int) -> list[int]:
        at = [(float(self.sq[self.entry] - 2.0 * (self.x[self.entry] @ q)), self.entry)]
        for k in range(int(self.level[self.entry]), 0, -1):
            at = self.search(q, at[:1], 1, k)
        return [v for _, v in self.search(q, at, ef, 0)]


_INDEX = "dim int, shard int, ids binary, ends binary, vectors binary, levels binary, entry int, links array<binary>"


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    blas_threads(1)  # a task has one core
    x = np.array(pdf["vec"].tolist(), np.float64) + 0.0
    ids = pdf["vec_id"].to_numpy(np.int64)
    order = np.lexsort((ids, *x.T[::-1]))
    x, ids = x[order], ids[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1)]  # a row that is repeated counts once
    x, ids = x[new], ids[new]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(1)])
    shuffle = np.random.default_rng(len(first)).permutation(len(first))  # sorted vectors would be inserted along a line
    ends = np.r_[first[1:], len(x)]
    ids = np.concatenate([ids[first[i] : ends[i]] for i in shuffle])
    g = Graph(x[first][shuffle]).build()
    cut = np.cumsum((ends - first)[shuffle])
    return pd.DataFrame([(key[0], key[1], ids.tobytes(), cut.astype(np.int64).tobytes(), g.x.tobytes(), g.level.astype(np.int32).tobytes(), g.entry, [a.tobytes() for a in g.links])], columns=["dim", "shard", "ids", "ends", "vectors", "levels", "entry", "links"])


def loaded(row) -> tuple[Graph, np.ndarray, np.ndarray]:
    """A shard's graph, the ids of its vertices, and where each vertex's ids begin."""
    g = Graph.__new__(Graph)
    g.x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    g.sq = np.einsum("ij,ij->i", g.x, g.x)
    g.level = np.frombuffer(row["levels"], np.int32)
    g.links = [np.frombuffer(a, np.int32).reshape(len(g.x), -1) for a in row["links"]]
    g.entry = int(row["entry"])
    return g, np.frombuffer(row["ids"], np.int64), np.r_[0, np.frombuffer(row["ends"], np.int64)]


def nearest_ids(g: Graph, ids: np.ndarray, start: np.ndarray, vec: np.ndarray, own: int, k: int, ef: int) -> list[tuple[float, int]]:
    """(distance, id) of the k nearest distinct ids but the query's own; ids with many vectors and ties make the search wider."""
    vs = np.array(g.nearest(vec, ef))
    while True:
        ds = np.sqrt(((g.x[vs] - vec) ** 2).sum(1))
        best: dict[int, float] = {}
        last = math.inf
        for n in np.argsort(ds, kind="stable").tolist():
            v, d = vs[n], float(ds[n])
            if d > last:
                break
            for i in ids[start[v] : min(start[v] + k + 1, start[v + 1])].tolist():  # distinct, the smaller first
                if i != own:
                    best.setdefault(i, d)
            if len(best) >= k and last == math.inf:
                last = d
        if len(vs) == len(g.x) or (len(vs) >= ef and ds.max() > last):
            return sorted((d, i) for i, d in best.items())[:k]
        whole = len(vs) < ef or 8 * ef > len(g.x)  # vertices that no link reaches, or ties of much of the shard: all are compared
        ef *= 2
        vs = np.arange(len(g.x)) if whole else np.array(g.nearest(vec, ef))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).filter("vec_id is not null and vec is not null")
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return e.filter(fine & F.exists("vec", lambda v: v != 0))


def built(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored index: a row for each shard."""
    ship(vectors.sparkSession)
    shards = max(1, -(-vectors.count() // shard_rows))
    v = vectors.withColumn("dim", F.size("vec")).withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int"))
    v = v.repartition(min(3 * shards, 10_000), "dim", "shard")  # small rows, much work: more tasks than bytes ask for
    return stored(v.groupBy("dim", "shard").applyInPandas(_build, _INDEX), "hnsw")


def searched(index: DataFrame, queries: DataFrame, k: int = K, ef: int = SEARCH, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, vec)."""
    blocks = max(1, -(-queries.count() // block))
    q = queries.select(F.col("vec_id").alias("query_id"), "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    q = q.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "vec")).alias("queries")).withColumn("slice", F.expr(f"block div {SLICE}").cast("int"))
    names = index.select("dim", "shard")  # a row of 8 bytes for each SHARD_ROWS vectors
    n = names.count()
    copies = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // SLICE))))
    tasks, keys = max(1, min(n * (1 + (blocks - 1) // SLICE), 10_000)), ["dim", "shard", "slice"]
    cells = q.join(small(names, n), "dim").repartition(tasks, *keys).join(copies.repartition(tasks, *keys).hint("merge"), keys)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blas_threads(1)  # a task has one core
        at, shard = None, None
        for pdf in batches:
            for row in pdf.to_dict("records"):
                if at != (row["dim"], row["shard"]):
                    at, shard = (row["dim"], row["shard"]), loaded(row)
                out = []
                for one in row["queries"]:
                    own, vec = one["query_id"], np.array(one["vec"], np.float64)
                    out += [(own, i, d) for d, i in nearest_ids(*shard, vec, own, k, ef)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = cells.mapInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The k nearest vectors of each whose id is divisible by `every`, among all others."""
    v = stored(usable(embeddings), "vectors")
    return searched(built(v), v.filter(F.col("vec_id") % every == 0).distinct(), k)
