"""Nearest neighbours by cosine: a query set against all rows in bounded cells, and statistics over the neighbours.

Vectors are grouped about pivots, a bounded number of rows, and groups are cut into blocks of a bounded number of rows. Some consecutive
blocks are a tile; each tile of queries meets each tile of rows in one cell, so a vector is shipped once for each tile of the
other side, and all is shuffled once. In a cell, the blocks of rows are cut into leaves, about some of their own rows, and a leaf is left
out for the queries that are too far from it: by the triangle inequality for angles, none of its rows is nearer than its centre less its
radius. What is near enough is known from a first round over the cells that a block has with itself. k rows leave each cell for a query, pairs are never rows of a plan, and no side needs to fit
in one place. The result is exact: products are made in single precision, and those that its error leaves in question again in double.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, doubles, jaccard, unit
from ..session import blas_threads, ship

#: Rows of a block, blocks of a tile, pivots at most, rows of a leaf on the average.
BLOCK, TILE, PIVOTS, LEAF = 2048, 8, 1024, 96
#: Bytes of a tile's vectors up to which it has more blocks, MORE times as many at most: all vectors are shuffled once for each tile.
TILE_BYTES, MORE = 32 << 20, 4
#: Products that are made again in double precision at once.
SOME = 1 << 16
#: Digits that similarities are rounded to before ties go to the smaller key.
DIGITS = 9

_OUT = "q long, c long, sim double"
_ARROW = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("sim", pa.float64())])


def unit_vectors(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), unit(F.col(vec)).alias("v"))


def _matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ids, v = rows.field("id").to_numpy(zero_copy_only=False), rows.field("v")
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


class _Block:
    """Rows of a block by id, the direction of their sum, and the largest angle that one has to it."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], v[order]
        centre = v.sum(0)
        n = np.linalg.norm(centre)
        self.centre = centre / n if n > 0 else centre
        whole = (v**2).sum(1) > 0
        cos = np.clip(v[whole] @ self.centre, -1, 1)
        self.radius = float(np.arccos(cos.min())) if n > 0 and whole.any() else np.pi
        self.zeros = not whole.all()  # they have similarity 0 to all
        self.v32 = self.v.astype(np.float32)

    def bound(self, q: np.ndarray) -> np.ndarray:
        """What no similarity of a row to each of q exceeds."""
        out = np.cos(np.maximum(0, np.arccos(np.clip(q @ self.centre, -1, 1)) - self.radius - 1e-7))
        return np.maximum(out, 0) if self.zeros else out


def _leaves(b: _Block, size: int) -> list[_Block]:
    """A block's rows by which of some of them is nearest: smaller blocks, which bounds leave out more of."""
    n = len(b.ids) // size
    if n < 2:
        return [b]
    some = np.random.default_rng(0).permutation(len(b.ids))[:n]  # ids may have a pattern
    near = (b.v32 @ b.v32[some].T).argmax(1)
    order = np.argsort(near, kind="stable")
    return [_Block(b.ids[x], b.v[x]) for x in np.split(order, np.flatnonzero(np.diff(near[order])) + 1)]


def _bounds(queries: _Block, blocks: list[_Block]) -> np.ndarray:
    """bound() of all blocks, a row for each; cos(a - r) is cos a cos r + sin a sin r, and what roots may be off by is added."""
    radius = np.array([b.radius + 1e-7 for b in blocks])[:, None]
    cos = np.array([b.centre for b in blocks]) @ queries.v.T
    np.clip(cos, -1, 1, out=cos)
    out = np.sqrt(1 - cos * cos)
    out *= np.sin(radius)
    out += cos * np.cos(radius)
    out += 1e-7
    out[(cos >= np.cos(radius)) | (radius >= np.pi)] = 1
    zeros = np.array([b.zeros for b in blocks])
    out[zeros] = np.maximum(out[zeros], 0)
    return out


def _others(queries: np.ndarray, b: _Block) -> tuple[np.ndarray, np.ndarray]:
    """The places of a block's rows that are the queries themselves, by id: rows and columns of the products."""
    lo = np.searchsorted(b.ids, queries)
    n = np.searchsorted(b.ids, queries, "right") - lo
    x = np.repeat(np.arange(len(queries)), n)
    return x, np.repeat(lo, n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)


def _first(x: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which hits are among the k first of their query x, by similarity s and then id c, in order of queries; and their rank from 0."""
    order = np.lexsort((c, -s, x))
    first = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
    rank = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
    return order[rank < k], rank[rank < k]


def nearest_in(queries: _Block, floor: np.ndarray, blocks: list[_Block], k: int, digits: int) -> tuple[list[np.ndarray], int]:
    """Rows (q, c, sim) of the k nearest of some blocks to each query, as far as they reach the query's floor; how many products it took."""
    floor, hits, products = floor.copy(), [], 0
    bounds = _bounds(queries, blocks)
    best = np.full((len(queries.ids), k), -np.inf)
    # a product of single precision is off by less, of unit vectors; and rounding moves one by half a digit
    slack = (queries.v.shape[1] + 8) * 2.0**-23 + 10.0**-digits
    some = np.flatnonzero((bounds >= floor - 10.0**-digits).any(1))
    for i in some[np.argsort(-bounds[some].mean(1), kind="stable")]:
        b = blocks[i]
        live = np.flatnonzero(bounds[i] >= floor - 10.0**-digits)
        if not len(live):
            continue
        products += len(live) * len(b.ids)
        sim = queries.v32[live] @ b.v32.T
        cut, own = floor[live], None
        if k <= sim.shape[1] and (new := np.flatnonzero(np.isneginf(cut))).size:  # nothing is known yet
            own = _others(queries.ids[live], b)
            sim[own] = -np.inf
            cut[new] = -np.partition(-sim[new], k - 1, axis=1)[:, k - 1].astype(float) - slack
        # of flat arrays numpy finds them faster
        x, y = np.divmod(np.flatnonzero(sim >= (cut - slack)[:, None].astype(np.float32)), sim.shape[1])
        if len(x) > sim.size // 8:  # large groups of copies
            sim = np.round(queries.v[live] @ b.v.T, digits)
            sim[_others(queries.ids[live], b) if own is None else own] = -np.inf
            kth = -np.partition(-sim, k - 1, axis=1)[:, k - 1] if k <= sim.shape[1] else np.full(len(live), -np.inf)
            more = sim > kth[:, None]
            ties = (sim == kth[:, None]) & np.isfinite(sim)  # of these the first by id
            ties &= ties.cumsum(1) <= (k - more.sum(1))[:, None]
            x, y = np.divmod(np.flatnonzero((more | ties) & (sim >= floor[live][:, None])), sim.shape[1])
            s = sim[x, y]
        else:
            keep = queries.ids[live[x]] != b.ids[y]
            x, y = x[keep], y[keep]
            s = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", queries.v[live[x[a : a + SOME]]], b.v[y[a : a + SOME]]) for a in range(0, len(x), SOME))])
            s = np.round(s, digits)
            keep = s >= floor[live[x]]
            x, y, s = x[keep], y[keep], s[keep]
        if not len(x):
            continue
        at, rank = _first(x, b.ids[y], s, k)
        x, y, s = x[at], y[at], s[at]
        hit = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        row = np.repeat(np.arange(len(hit)), np.diff(np.r_[hit, len(x)]))
        got = np.full((len(hit), k), -np.inf)
        got[row, rank] = s
        of = live[x[hit]]
        best[of] = -np.sort(-np.concatenate([best[of], got], axis=1), axis=1)[:, :k]
        floor[of] = np.maximum(floor[of], best[of, k - 1])
        hits.append((queries.ids[live[x]], b.ids[y], s))
    if not hits:
        return [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], products
    q, c, s = (np.concatenate(h) for h in zip(*hits, strict=True))
    at, _ = _first(q, c, s, k)
    return [q[at], c[at], s[at]], products


def pairs_in(left: list[_Block], right: list[_Block], same: bool, floor: float, k: int, digits: int) -> tuple[list[np.ndarray], int]:
    """The k most similar pairs q < c of left and right blocks, of the same list each two blocks once; and how many products it took."""
    best, products = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], 0
    for i, a in enumerate(left):
        for b in right[i:] if same else right:
            live = np.flatnonzero(b.bound(a.v) >= floor - 10.0**-digits)
            if not len(live):
                continue
            products += len(live) * len(b.ids)
            sim = np.round(a.v[live] @ b.v.T, digits)
            ids = a.ids[live]
            if a is b:
                sim[ids[:, None] >= b.ids[None]] = -np.inf
            else:
                sim[ids[:, None] == b.ids[None]] = -np.inf
            cut = max(floor, -np.partition(-sim.ravel(), k - 1)[k - 1]) if sim.size >= k else floor
            x, y = np.nonzero((sim >= cut) & np.isfinite(sim))
            p, r, s = (np.concatenate(z) for z in zip(best, (np.minimum(ids[x], b.ids[y]), np.maximum(ids[x], b.ids[y]), sim[x, y]), strict=True))
            order = np.lexsort((r, p, -s))[:k]
            best = [p[order], r[order], s[order]]
            if len(order) == k:
                floor = max(floor, float(best[2][-1]))
    return best, products


def _blocked(df: DataFrame, pivots: np.ndarray, first: dict[int, int], blocks: dict[int, int]) -> DataFrame:
    """df with its block: of the pivot that it is nearest to, by a hash of its id."""

    @F.pandas_udf("int")
    def pivot(v: pd.Series) -> pd.Series:
        return pd.Series((np.array(v.tolist(), float).reshape(len(v), pivots.shape[1]) @ pivots.T).argmax(1).astype(np.int32), index=v.index)

    of = F.create_map(*[F.lit(x) for p in first for x in (p, first[p])])
    size = F.create_map(*[F.lit(x) for p in blocks for x in (p, blocks[p])])
    d = df.withColumn("_p", pivot("v"))
    return d.withColumn("b", (F.element_at(of, F.col("_p")) + F.pmod(F.xxhash64("id"), F.element_at(size, F.col("_p")))).cast("int")).drop("_p")


def top_k(queries: DataFrame, rows: DataFrame, k: int, pairs_once: bool = False, digits: int = DIGITS, products: Accumulator | None = None) -> DataFrame:
    """q, c, sim, rank: the k rows nearest to each query, itself excluded. Of (id, v) with unit vectors.

    With pairs_once, pairs of q < c only, and the k best of all instead of each query; queries and rows are then the same table.
    products: gets the number of products that are made.
    """
    spark = queries.sparkSession
    ship(spark)
    every_row = pairs_once or queries is rows
    rows = rows.filter("v is not null and id is not null")
    queries = rows if every_row else queries.filter("v is not null and id is not null")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], _OUT + ("" if pairs_once else ", rank int"))
    if n <= BLOCK:
        nb, blocked = 1, lambda df: df.withColumn("b", F.lit(0))
    else:
        some = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-n // BLOCK))).select("v").collect()
        pivots, plain = np.array([r["v"] for r in some], float), dict.fromkeys(range(len(some)), 1)
        # a row for each pivot; v is taken twice, so that what makes it isn't put into the function's argument, where a plan may not find it again
        count = {r["b"]: r["n"] for r in _blocked(rows, pivots, {p: p for p in plain}, plain).groupBy("b").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).collect()}
        blocks = {p: max(1, -(-count.get(p, 0) // BLOCK)) for p in plain}
        first = dict(zip(plain, np.cumsum([0, *blocks.values()]).tolist(), strict=False))
        nb, blocked = sum(blocks.values()), lambda df: _blocked(df, pivots, first, blocks)
    of_tile = TILE if nb == 1 else max(TILE, min(MORE * TILE, TILE_BYTES // (BLOCK * pivots.shape[1] * 8)))
    tiles = max(-(-nb // of_tile), min(nb, spark.sparkContext.defaultParallelism))
    tile = F.floor(F.col("b") * tiles / nb).cast("int")
    r, q = blocked(rows).withColumn("t", tile), blocked(queries).withColumn("t", tile)
    every = F.sequence(F.lit(0), F.lit(tiles - 1))
    own, leaf = F.array("b"), LEAF
    # few queries are fewer tiles, so rows are shuffled fewer times for them
    asked = tiles if every_row or tiles == 1 else max(1, min(tiles, -(-queries.count() // (of_tile * BLOCK))))

    def work(cell: pa.Table) -> pa.Table:
        blas_threads(1)  # a task has one core
        ids = cell.column("id").to_numpy()
        v = cell.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        b, side = cell.column("b").to_numpy(), cell.column("side").to_numpy()
        floor = cell.column("floor").to_numpy()

        def side_of(at: np.ndarray) -> list[tuple[_Block, np.ndarray]]:
            out = []
            for x in np.unique(b[at]):
                here = at[b[at] == x]
                out.append((_Block(ids[here], v[here]), floor[here][np.argsort(ids[here], kind="stable")]))
            return out

        left, right = side_of(np.flatnonzero(side == 0)), [x for x, _ in side_of(np.flatnonzero(side == 1))] if (side == 0).any() else []
        if pairs_once:
            same = cell.column("i")[0] == cell.column("j")[0]
            found, made = pairs_in([x for x, _ in left], [x for x, _ in left] if same else right, same, float(floor.max()), k, digits)
            out = [found]
        else:
            out, made, right = [], 0, [y for x in right for y in _leaves(x, leaf)] if nb > 1 else right
            for x, f in left if right else []:
                found, m = nearest_in(x, f, right, k, digits)
                out.append(found)
                made += m
        if products is not None:
            products.add(made)
        return pa.concat_tables([pa.table([pa.array(x) for x in h], schema=_ARROW) for h in out]) if out else _ARROW.empty_table()

    def round_of(q: DataFrame, r: DataFrame, js, is_, cells: int) -> DataFrame:
        """The hits of queries that go to the tiles js of rows; rows go to the tiles is_ of queries. Some cells are a task: they differ in work."""
        left = q.select("id", "v", "b", "floor", F.lit(0).alias("side"), F.col("t").alias("i"), F.explode(js).alias("j"))
        right = r.select("id", "v", "b", F.lit(float("-inf")).alias("floor"), F.lit(1).alias("side"), F.explode(is_).alias("i"), F.col("t").alias("j"))
        parts = max(1, min(cells, 4 * spark.sparkContext.defaultParallelism))
        return left.unionByName(right).repartition(parts, "i", "j").groupBy("i", "j").applyInArrow(work, _OUT)

    low = F.lit(float("-inf"))
    if tiles > 1:
        near = round_of(q.withColumn("floor", low).withColumn("t", F.col("b")), r.withColumn("t", F.col("b")), own, own, nb)  # hits are few rows for each query
        if pairs_once:
            worst = _ranked(near, k, True).agg(F.count("*").alias("n"), F.min("sim").alias("sim")).first()
            low = F.lit(worst["sim"] if worst["n"] == k else float("-inf"))
            q = q.withColumn("floor", low)
        else:
            floors = near.groupBy("q").agg(F.count("*").alias("n"), F.min("sim").alias("at")).filter(F.col("n") == k).select(F.col("q").alias("id"), F.col("at").alias("floor"))
            q = q.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", low))
    else:
        q = q.withColumn("floor", low)
    if pairs_once:
        return _ranked(round_of(q, r, F.filter(every, lambda x: x >= F.col("t")), F.filter(every, lambda x: x <= F.col("t")), tiles * tiles), k, True)
    q = q.withColumn("t", F.floor(F.col("t") * asked / tiles).cast("int"))
    return _ranked(round_of(q, r, every, F.sequence(F.lit(0), F.lit(asked - 1)), tiles * asked), k, False)


def _ranked(found: DataFrame, k: int, pairs_once: bool) -> DataFrame:
    if pairs_once:
        return found.orderBy(F.desc("sim"), "q", "c").limit(k)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "c"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def copies(rows: DataFrame, k: int) -> DataFrame:
    """id, v, key, ids: the different vectors of (id, v), by the bytes they consist of, with the smallest id and the first k + 1 ids of each."""
    d = _keyed(rows)
    first = d.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("place") <= k + 1)
    one = first.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.any_value("v").alias("v"))
    return one.select(F.get("ids", F.lit(0)).alias("id"), "v", "key", "ids")


def _keyed(rows: DataFrame) -> DataFrame:
    ship(rows.sparkSession)
    key = F.pandas_udf(lambda s: s.map(lambda v: np.asarray(v, float).tobytes()), "binary")
    return rows.filter("v is not null and id is not null").select("id", "v", key("v").alias("key"))


def top_k_of_all(rows: DataFrame, one: DataFrame, k: int, digits: int = DIGITS, products: Accumulator | None = None) -> DataFrame:
    """top_k(rows, rows, k), where many vectors may be equal: the search is among the different ones, one = copies(rows, k).

    A row that is among the k nearest is of one of the k vectors that are nearest, by similarity and smallest id, or a copy of the query;
    and the first k + 1 ids of a vector tell the first k without any one of them. Ids are different.
    """
    mine = one.select("id", "v")
    near = top_k(mine, mine, k, digits=digits, products=products)
    others = near.join(one.select(F.col("id").alias("c"), "ids"), "c").select(F.col("q").alias("id"), "sim", "ids")
    square = F.round(dot(F.col("v"), F.col("v")), digits)
    every = others.unionByName(one.select("id", square.alias("sim"), "ids").filter(~F.isnan("sim"))).select("id", F.explode("ids").alias("c"), "sim")
    best = every.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "c"))).filter(F.col("place") <= k + 1)
    best = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "c", "sim"))).alias("best"))
    to = one.select("id", "key").join(best, "id").select("key", "best")
    got = _keyed(rows).select("id", "key").join(to, "key").select(F.col("id").alias("q"), F.slice(F.filter("best", lambda x: x["c"] != F.col("id")), 1, k).alias("best"))
    return got.select("q", F.posexplode("best").alias("place", "one")).select("q", "one.c", "one.sim", (F.col("place") + 1).alias("rank"))


def similar_to_vector(df: DataFrame, vector: list[float], k: int = 5, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector."""
    q = unit(F.array(*[F.lit(float(x)) for x in vector]))
    sim = F.round(dot(unit(F.col(vec)), q), DIGITS)
    return df.withColumn("sim", sim).orderBy(F.desc("sim"), key).limit(k)


def similar_to_row(df: DataFrame, key_value: int, k: int = 5, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k rows nearest to the row with a key, without it. A key that isn't there is an error."""
    row = df.filter(F.col(key) == key_value).select(doubles(F.col(vec)).alias("v")).first()
    if row is None:
        raise ValueError(f"no row has {key} {key_value}")
    return similar_to_vector(df.filter(F.col(key) != key_value), row["v"], k, key, vec)


def overlap_at_k(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """q, overlap: the mean Jaccard overlap of a query's label set and its neighbours'. labels: id, tags."""
    a = labels.select(F.col("id").alias("q"), F.col("tags").alias("q_tags"))
    b = labels.select(F.col("id").alias("c"), F.col("tags").alias("c_tags"))
    j = neighbours.join(a, "q").join(b, "c")
    return j.groupBy("q").agg(F.avg(jaccard(F.col("q_tags"), F.col("c_tags"))).alias("overlap"))


def conflicting(neighbours: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Neighbours above a similarity whose label sets differ."""
    a = labels.select(F.col("id").alias("q"), F.array_sort("tags").alias("q_tags"))
    b = labels.select(F.col("id").alias("c"), F.array_sort("tags").alias("c_tags"))
    return neighbours.filter(F.col("sim") > threshold).join(a, "q").join(b, "c").filter("q_tags <> c_tags")


def neighbour_summary(neighbours: DataFrame, texts: DataFrame, missing: str = "Unknown purpose") -> DataFrame:
    """q, summary: what the nearest row says. texts: id, text."""
    t = texts.select(F.col("id").alias("c"), F.col("text").alias("summary"))
    return neighbours.filter("rank = 1").join(t, "c", "left").select("q", F.coalesce("summary", F.lit(missing)).alias("summary"))
