"""k-means for several k with several starts each, all in the same passes, and the silhouettes of all k from one product of distances.

The centres of all sets stand side by side: a pass is one matrix product of a block with all of them, and returns each set's sums,
counts and cost. The number of jobs grows with the iterations only. Starts are drawn by k-means++ from a bounded pool, the rows with the
smallest digests of their keys; after that every row counts in every pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..session import blas_threads, ship
from .packed import Packed

#: Rows that starts are drawn from.
POOL = 4096


def spread_start(pool: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of the pool, each drawn by its squared distance to those drawn before."""
    at = [int(rng.integers(len(pool)))]
    near = ((pool - pool[at[0]]) ** 2).sum(1)
    while len(at) < k:
        total = near.sum()
        at.append(int(np.searchsorted(np.cumsum(near), rng.random() * total, "right")) if total > 0 else int(rng.integers(len(pool))))
        at[-1] = min(at[-1], len(pool) - 1)
        near = np.minimum(near, ((pool - pool[at[-1]]) ** 2).sum(1))
    return pool[at]


def _nearest(x: np.ndarray, centres: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each set of centres (between the cuts) the nearest one to each row, and its squared distance."""
    d = (centres**2).sum(1) - 2 * x @ centres.T
    near = np.stack([d[:, a:b].argmin(1) for a, b in zip(cuts, cuts[1:], strict=False)], axis=1)
    low = np.take_along_axis(d, near + np.array(cuts[:-1]), axis=1)
    return near, low + (x**2).sum(1)[:, None]


@dataclass
class Clusterings:
    """For each k the centres of its best start; costs of all starts; how many passes it took."""

    centres: dict[int, np.ndarray]
    costs: dict[int, list[float]]
    passes: int = 0

    @staticmethod
    def fitted(df: DataFrame, key: str, vec: str, ks: list[int], starts: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> Clusterings:
        """A set is done when its centres move by at most tol times the mean variance of a place, squared and added up."""
        first = df.select(doubles(F.col(vec)).alias("x"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(key).alias("k")).filter("x is not null").orderBy("h", "k").limit(POOL)
        pool = np.array([r["x"] for r in first.select("x").collect()], float)
        if not len(pool):
            raise ValueError("no rows to cluster")
        sets = [(k, s) for k in ks for s in range(starts)]
        at = [spread_start(pool, k, np.random.default_rng((seed, k, s))) for k, s in sets]
        with Packed(df, vec) as rows:
            moments = rows.summed(lambda x, _, __: np.stack([x.sum(0), (x**2).sum(0)])).reshape(2, -1) / rows.rows
            still = tol * max(0.0, float((moments[1] - moments[0] ** 2).mean()))

            def measured(live: list[int]) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
                centres = np.concatenate([at[i] for i in live])
                cuts = np.cumsum([0, *(len(at[i]) for i in live)]).tolist()

                def work(x: np.ndarray, _, __) -> np.ndarray:
                    near, low = _nearest(x, centres, cuts)
                    member = np.zeros((len(x), len(centres)))
                    np.put_along_axis(member, near + np.array(cuts[:-1]), 1, axis=1)
                    cost = np.zeros(len(centres))
                    cost[: len(live)] = np.maximum(low, 0).sum(0)
                    return np.column_stack([member.T @ x, member.sum(0), cost])

                got = rows.summed(work).reshape(len(centres), -1)
                return [got[a:b, :-2] for a, b in zip(cuts, cuts[1:], strict=False)], [got[a:b, -2] for a, b in zip(cuts, cuts[1:], strict=False)], got[: len(live), -1].tolist()

            live, passes = list(range(len(sets))), 0
            while live and passes < max_iter:
                sums, counts, _ = measured(live)
                passes += 1
                moving = []
                for i, s, n in zip(live, sums, counts, strict=True):
                    new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], at[i])  # one that nothing is near to stays
                    if ((new - at[i]) ** 2).sum() > still:
                        moving.append(i)
                    at[i] = new
                live = moving
            cost = measured(list(range(len(sets))))[2]
        costs = {k: [c for (m, _), c in zip(sets, cost, strict=True) if m == k] for k in ks}
        best = {k: at[sets.index((k, int(np.argmin(costs[k]))))] for k in ks}
        return Clusterings(best, costs, passes + 1)

    def clusters(self, vector: Column) -> Column:
        """An array: of each k, in rising order, the cluster of a vector."""
        ks = sorted(self.centres)
        centres = np.concatenate([self.centres[k] for k in ks])
        cuts = np.cumsum([0, *(len(self.centres[k]) for k in ks)]).tolist()

        @F.pandas_udf("array<int>")
        def assign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            blas_threads(1)
            for s in batches:
                x = np.array(s.tolist(), float).reshape(len(s), centres.shape[1])
                yield pd.Series(list(_nearest(x, centres, cuts)[0].astype(np.int32)), index=s.index)

        return assign(doubles(vector))

    def assigned(self, df: DataFrame, vec: str, out: str = "clusters") -> DataFrame:
        ship(df.sparkSession)
        return df.withColumn(out, self.clusters(F.col(vec)))


def sweep(df: DataFrame, key: str, vec: str, most: int = 8, starts: int = 10) -> list[tuple[int, float]]:
    """The silhouette of each k from 2 to the smaller of most and a third of the rows."""
    from .evaluation import silhouettes

    n = df.filter(F.col(vec).isNotNull()).count()
    ks = list(range(2, min(most, n // 3) + 1))
    if not ks:
        return []
    got = Clusterings.fitted(df, key, vec, ks, starts)
    found = {r["which"]: r["silhouette"] for r in silhouettes(got.assigned(df.select(key, vec), vec), key, vec, "clusters").collect()}
    return [(k, found[i]) for i, k in enumerate(ks)]
