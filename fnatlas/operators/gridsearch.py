"""Grid search of regressions by cross-validation: every point of the grid and every fold in the same passes over the rows.

A row's fold follows from a digest of its key. A (point, fold) is a search that the fold's rows aren't counted for; all of them
advance together (see `joint`), so a round is as many jobs as it has passes, whatever the grid's size. After each round one more
job counts hits and misses of all on the rows that were kept from them; points whose mean F1 is too low are dropped, the others go on from
where they are. The last round goes to the end. What the driver gets is of the size of grid, folds and labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joint import Head, JointLogistic, advance, fitted, part_of
from .learning import seeded_digest
from .packed import Packed


@dataclass(frozen=True)
class Point:
    """Parameters: the inverse of the penalty, and whether classes weigh the same in sum."""

    c: float = 1.0
    balanced: bool = True


@dataclass
class Found:
    """The best point, its model fitted to all rows, and the scores: round, point, fold, passes, n (rows of the fold), f1."""

    best: Point
    model: JointLogistic | None
    scores: list[tuple[int, int, int, int, int, float]]

    def table(self, spark, grid: list[Point]) -> DataFrame:
        """A row for each point, fold and round that it was in, and whether it is of the best point."""
        rows = [(r, p, grid[p].c, grid[p].balanced, fold, passes, n, f1, grid[p] == self.best) for r, p, fold, passes, n, f1 in self.scores]
        return spark.createDataFrame(rows, "round int, point int, c double, balanced boolean, fold int, passes int, n long, f1 double, best boolean")


def searched(
    df: DataFrame, key: str, vec: str, column: str, classes: list[str], grid: list[Point], one: bool = False, folds: int = 3, rounds: tuple[int, ...] = (10, 20), keep: float = 0.5,
    max_iter: int = 100, tol: float = 1e-4, refit: bool = True, seed: int = 42,
) -> Found:
    """The point of the grid whose models have the highest macro F1 on rows that they aren't fitted to, the mean of all folds.

    column: an array of labels, or with `one` a single one; a null one is in no fold. rounds: passes of the rounds before the
    last, each of which keeps the share `keep` of the points (one at least); without any it is a full search. Of equal points the first is taken;
    a grid of one point is searched no further than its scores; without classes the first point is best, and there are no scores.
    """
    if not grid:
        raise ValueError("no point to choose from")
    if not classes:
        return Found(grid[0], None, [])
    k = len(classes)
    fold = F.pmod(F.conv(F.substring(seeded_digest(F.coalesce(F.col(key).cast("string"), F.lit("")), seed), 1, 8), 16, 10).cast("long"), F.lit(folds))
    known = F.col(column).isin(classes) if one else F.col(column).isNotNull()
    known = F.coalesce(known, F.lit(False))
    truth = [x.cast("double") for x in Head(column, classes, one).truth()[:k]]
    y = F.array(*truth, *[(known & (fold != f)).cast("double") for f in range(folds)], *[(known & (fold == f)).cast("double") for f in range(folds)])
    scores: list[tuple[int, int, int, int, int, float]] = []
    with Packed(df, vec, y) as rows:
        if not rows.rows:
            raise ValueError("no rows to fit")
        seen = rows.summed(lambda x, y, _: np.concatenate([y[:, :k].T @ y[:, k:], y[:, k:].sum(0)[None]]).ravel()).reshape(k + 1, -1)
        outputs = [(0, k)] if one else [(j, j + 1) for j in range(k)]
        parts = {
            (p, f): [part_of(0, a, b, k + f, one, seen[k, f], seen[a:b, f], rows.width, grid[p].c, grid[p].balanced) for a, b in outputs]
            for p in range(len(grid)) for f in range(folds)
        }
        alive, done = list(range(len(grid))), 0
        for r, most in enumerate([*rounds, max(0, max_iter - sum(rounds))]):
            last = r == len(rounds)
            done += advance(rows, [s for p in alive for f in range(folds) for s in parts[p, f]], most, tol)
            at = [(f, np.concatenate([s.search.x.reshape(rows.width + 1, -1) for s in parts[p, f]], axis=1)) for p in alive for f in range(folds)]

            def hits(x: np.ndarray, y: np.ndarray, _, at=at) -> np.ndarray:
                out = []
                for f, m in at:
                    held = y[:, k + folds + f] > 0
                    z, t = x[held] @ m[:-1] + m[-1], y[held, :k] > 0
                    got = np.arange(k) == z.argmax(1)[:, None] if one else z >= 0
                    out.append([(t & got).sum(0), (got & ~t).sum(0), (t & ~got).sum(0)])
                return np.array(out, float).ravel()

            tp, fp, fn = np.moveaxis(rows.summed(hits).reshape(len(alive), folds, 3, k), 2, 0)
            f1 = (2 * tp / np.maximum(2 * tp + fp + fn, 1)).mean(2)
            scores += [(r, p, f, done, int(seen[k, folds + f]), float(f1[i, f])) for i, p in enumerate(alive) for f in range(folds)]
            order = sorted(range(len(alive)), key=lambda i: (-round(float(f1[i].mean()), 9), alive[i]))
            alive = [alive[i] for i in order[: 1 if last else max(1, int(np.ceil(keep * len(alive))))]]
            alive.sort()
    best = grid[alive[0]]
    model = fitted(df, vec, [Head(column, classes, one, known if one else None)], best.c, best.balanced, max_iter, tol)[0] if refit else None
    return Found(best, model, scores)
