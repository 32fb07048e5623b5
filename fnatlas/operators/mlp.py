"""A multilayer perceptron: rectified layers, mini-batch Adam with a learning rate, early stopping on rows kept aside.

Rows are packed in blocks. In a round each block goes through Adam's steps over its mini-batches, from the parameters that all share, and
the blocks' parameters and moments are averaged by their rows: one job a round, and the result doesn't depend on how
blocks are dealt. A hashed share of the rows isn't fitted to: their loss at each round's beginning decides when to stop, and the best
parameters are kept. On one block this is plain mini-batch Adam.
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

#: Decay of Adam's moments, and what keeps its division finite.
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8


def shapes(width: int, layers: tuple[int, ...], labels: int) -> list[tuple[int, ...]]:
    sizes = [width, *layers, labels]
    return [s for a, b in zip(sizes, sizes[1:], strict=False) for s in ((a, b), (b,))]


def split(flat: np.ndarray, of: list[tuple[int, ...]]) -> list[np.ndarray]:
    cuts = np.cumsum([int(np.prod(s)) for s in of])
    return [p.reshape(s) for p, s in zip(np.split(flat, cuts[:-1]), of, strict=True)]


def start(of: list[tuple[int, ...]], seed: int) -> np.ndarray:
    """Uniform draws whose width follows from the layers' sizes."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(0, len(of), 2):
        bound = np.sqrt(6.0 / sum(of[i]))
        out += [r.uniform(-bound, bound, s).ravel() for s in of[i : i + 2]]
    return np.concatenate(out)


def outputs(x: np.ndarray, p: list[np.ndarray]) -> list[np.ndarray]:
    """What each layer gives; the last one before softmax or sigmoid."""
    a = [x]
    for i in range(0, len(p), 2):
        z = a[-1] @ p[i] + p[i + 1]
        a.append(np.maximum(z, 0) if i < len(p) - 2 else z)
    return a


def probabilities(z: np.ndarray, one: bool) -> np.ndarray:
    if not one:
        return 1 / (1 + np.exp(-z))
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def losses(z: np.ndarray, y: np.ndarray, one: bool) -> np.ndarray:
    """Each row's log loss."""
    if not one:
        return (np.logaddexp(0, z) - y * z).sum(1)
    u = z - z.max(1, keepdims=True)
    return np.log(np.exp(u).sum(1)) - (u * y).sum(1)


def gradients(flat: np.ndarray, of: list[tuple[int, ...]], x: np.ndarray, y: np.ndarray, one: bool, alpha: float) -> tuple[float, np.ndarray]:
    """The mean loss of some rows with half of alpha times the squared weights per row, and its gradient."""
    p, n = split(flat, of), len(x)
    a = outputs(x, p)
    d = (probabilities(a[-1], one) - y) / n
    loss = losses(a[-1], y, one).mean() + alpha / (2 * n) * sum((w**2).sum() for w in p[::2])
    out: list[np.ndarray] = []
    for i in range(len(p) - 2, -1, -2):
        out = [a[i // 2].T @ d + alpha / n * p[i], d.sum(0), *out]
        if i:
            d = (d @ p[i].T) * (a[i // 2] > 0)
    return float(loss), np.concatenate([g.ravel() for g in out])


@dataclass
class Perceptron:
    classes: list[str]
    layers: tuple[int, ...]
    width: int
    one: bool
    flat: np.ndarray
    rounds: int = 0
    held_losses: tuple[float, ...] = ()

    @staticmethod
    def fitted(
        df: DataFrame, vec: str, label: str, classes: list[str], one: bool = True, layers: tuple[int, ...] = (256, 128), rate: float = 1e-3, alpha: float = 1e-4, max_rounds: int = 500, batch: int = 200,
        early_stopping: bool = True, held_percent: int = 10, patience: int = 10, tol: float = 1e-4, seed: int = 42,
    ) -> Perceptron:
        """Of a column of single values, or without `one` an array column. Without early stopping the training loss decides when to stop."""
        hit = [F.coalesce(F.col(label) == c if one else F.array_contains(label, c), F.lit(False)).cast("double") for c in classes]
        aside = (F.pmod(F.xxhash64(vec, F.lit(seed)), F.lit(100)) < held_percent) if early_stopping else F.lit(False)
        d = df.filter(F.col(label).isNotNull())
        with Packed(d, vec, F.array(*hit, aside.cast("double")), F.xxhash64(vec, F.lit("order"))) as rows:
            if not rows.rows or not classes:
                raise ValueError("no rows or classes to fit")
            of = shapes(rows.width, layers, len(classes))
            flat = start(of, seed)
            rows.numbers = 3 * len(flat) + 5
            m, v, t = np.zeros_like(flat), np.zeros_like(flat), 0
            best, best_flat, stale, seen = np.inf, flat, 0, []
            rounds = 0
            while rounds < max_rounds and stale < patience:

                def work(x: np.ndarray, y: np.ndarray, key: np.ndarray, flat=flat, m=m, v=v, t=t, number=rounds) -> np.ndarray:
                    held, y = y[:, -1] > 0, y[:, :-1]
                    p, m, v = flat.copy(), m.copy(), v.copy()
                    xs, ys = x[~held], y[~held]
                    n, total, steps = len(xs), 0.0, 0
                    held_loss = losses(outputs(x[held], split(p, of))[-1], y[held], one).sum() if held.any() else 0.0
                    order = np.random.default_rng((seed, number, int(key[0]) & 0xFFFFFFFF)).permutation(n)
                    for a in range(0, n, batch):
                        at = order[a : a + batch]
                        loss, g = gradients(p, of, xs[at], ys[at], one, alpha)
                        total += loss * len(at)
                        steps += 1
                        k = t + steps
                        m = BETA1 * m + (1 - BETA1) * g
                        v = BETA2 * v + (1 - BETA2) * g * g
                        p -= rate * np.sqrt(1 - BETA2**k) / (1 - BETA1**k) * m / (np.sqrt(v) + TINY)
                    return np.concatenate([n * p, n * m, n * v, [n, total, held_loss, held.sum(), n * steps]])

                got = rows.summed(work)
                n, total, held_loss, n_held, steps = got[-5:]
                if not n:
                    raise ValueError("no rows to fit")
                size = len(flat)
                value = held_loss / n_held if n_held else total / n
                seen.append(float(value))
                stale = 0 if value < best - tol else stale + 1
                if value < best:
                    # a held loss is that of the parameters that a round begins with
                    best, best_flat = value, flat if n_held else got[:size] / n
                flat, m, v = got[:size] / n, got[size : 2 * size] / n, got[2 * size : 3 * size] / n
                t += round(steps / n)
                rounds += 1
        return Perceptron(list(classes), tuple(layers), rows.width, one, best_flat if early_stopping else flat, rounds, tuple(seen))

    def scores(self, vector: Column) -> Column:
        flat, of, width, one = self.flat, shapes(self.width, self.layers, len(self.classes)), self.width, self.one

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            blas_threads(1)
            p = split(flat, of)
            for s in batches:
                x = np.array(s.tolist(), float).reshape(len(s), width)
                yield pd.Series(list(np.round(probabilities(outputs(x, p)[-1], one), 9)), index=s.index)

        return score(doubles(vector))

    def predicted(self, df: DataFrame, vec: str, out: str = "predicted", none: str = "none") -> DataFrame:
        """df with the most probable class; without `one` with the sorted array of the classes from 0.5 on, or the one for none."""
        ship(df.sparkSession)
        d = df.withColumn("_fn_scores", self.scores(F.col(vec)))
        if self.one:
            value = F.get(F.array(*map(F.lit, self.classes)), (F.array_position("_fn_scores", F.array_max("_fn_scores")) - 1).cast("int"))
        else:
            order = sorted(range(len(self.classes)), key=self.classes.__getitem__)
            got = F.array_compact(F.array(*[F.when(F.get("_fn_scores", F.lit(i)) >= 0.5, F.lit(self.classes[i])) for i in order]))
            value = F.when(F.size(got) > 0, got).otherwise(F.array(F.lit(none)))
        return d.select(*[c for c in df.columns if c != out], value.alias(out))

    def as_dict(self) -> dict:
        return {"kind": "mlp", "classes": self.classes, "layers": list(self.layers), "width": self.width, "one": self.one, "flat": self.flat.tolist()}

    @staticmethod
    def of_dict(d: dict) -> Perceptron:
        return Perceptron(d["classes"], tuple(d["layers"]), d["width"], d["one"], np.array(d["flat"]))
