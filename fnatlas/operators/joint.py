"""Logistic regressions of many labels, fitted together: a pass over the rows gives the gradients of all labels at once.

A head is a set of labels: any of them may hold for a row (a regression each), or one of them does (a softmax). Each regression and
each softmax has its own quasi-Newton search (L-BFGS with a halving step), and all searches advance in the same passes, so the number
of jobs is that of the slowest one, whatever the number of labels. An objective is the weighted mean log loss and half the penalty
times the squared coefficients, without intercepts; the penalty is 1 / (c * sum of weights).
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

#: Steps that a search remembers; digits of probabilities, so that one at a threshold is there whatever batch it is computed in.
MEMORY, DIGITS = 10, 12


class _Search:
    """The minimum of one label's objective; `at` is where the next value and gradient are wanted."""

    def __init__(self, n: int) -> None:
        self.at = np.zeros(n)
        self.x, self.f, self.g = self.at, np.inf, np.zeros(n)
        self.d, self.t, self.done = np.zeros(n), 1.0, False
        self.s: list[np.ndarray] = []
        self.y: list[np.ndarray] = []

    def _direction(self) -> np.ndarray:
        q, a = self.g.copy(), []
        for s, y in zip(reversed(self.s), reversed(self.y), strict=True):
            a.append(s @ q / (y @ s))
            q -= a[-1] * y
        if self.s:
            q *= (self.s[-1] @ self.y[-1]) / (self.y[-1] @ self.y[-1])
        for s, y, b in zip(self.s, self.y, reversed(a), strict=True):
            q += s * (b - y @ q / (y @ s))
        return -q

    def take(self, f: float, g: np.ndarray, tol: float) -> None:
        first = np.isinf(self.f)
        if not first and not f <= self.f + 1e-4 * self.t * (self.g @ self.d):
            self.t /= 2
            self.done = self.t < 1e-12
            self.at = self.x + self.t * self.d
            return
        if not first:
            s, y = self.at - self.x, g - self.g
            if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
                self.s, self.y = [*self.s, s][-MEMORY:], [*self.y, y][-MEMORY:]
        self.x, self.f, self.g = self.at, f, g
        self.done = bool(np.abs(g).max(initial=0) <= tol)
        self.d = self._direction()
        if self.g @ self.d >= 0:
            self.s, self.y, self.d = [], [], -self.g
        self.t = 1.0 if self.s else min(1.0, 1.0 / max(1e-12, np.abs(self.g).sum()))
        self.at = self.x + self.t * self.d


@dataclass
class Head:
    """Labels of a column: an array, or with `one` a single value. Rows where `rows` isn't true aren't fitted to; c: its own, if any."""

    column: str
    classes: list[str]
    one: bool = False
    rows: Column | None = None
    c: float | None = None

    def truth(self) -> list[Column]:
        """For each label 1 or 0, and then 1 if the row counts."""
        hit = [F.col(self.column) == x if self.one else F.array_contains(self.column, x) for x in self.classes]
        counts = F.coalesce(self.rows, F.lit(False)) if self.rows is not None else F.lit(True)
        return [F.coalesce(h, F.lit(False)).cast("double") for h in [*hit, counts]]


@dataclass
class _Part:
    """What a search is for: a range of outputs, all of a softmax or one of its own, and the place of the row's flag."""

    head: int
    a: int
    b: int
    flag: int
    one: bool
    weights: np.ndarray  # of the labels; for a label of its own of no and yes
    total: float
    search: _Search
    c: float


def part_of(head: int, a: int, b: int, flag: int, one: bool, n: float, seen: np.ndarray, width: int, c: float, balanced: bool) -> _Part:
    """The search for outputs a to b, of n rows that count; seen: how many have each of these labels."""
    if one:
        w = n / ((b - a) * np.maximum(seen, 1)) if balanced else np.ones(b - a)
        return _Part(head, a, b, flag, True, w, float(w @ seen), _Search((width + 1) * (b - a)), c)
    yes = seen[0]
    w = np.array([n / (2 * max(n - yes, 1)), n / (2 * max(yes, 1))]) if balanced else np.ones(2)
    return _Part(head, a, b, flag, False, w, float(w @ [n - yes, yes]), _Search(width + 1), c)


def advance(rows: Packed, parts: list[_Part], most: int, tol: float) -> int:
    """Takes all searches that aren't done on, by as many passes over the rows as it returns."""
    passes = 0
    while passes < most and (live := [p for p in parts if not p.search.done]):
        at = [(p.a, p.b, p.flag, p.one, p.weights, p.search.at.reshape(rows.width + 1, -1)) for p in live]

        def gradients(x: np.ndarray, y: np.ndarray, _, at=at) -> np.ndarray:
            b = np.concatenate([m for *_, m in at], axis=1)
            z = x @ b[:-1] + b[-1]
            loss, r, k = [], np.empty_like(z), 0
            for lo, hi, flag, one, weights, _m in at:
                t, u = y[:, lo:hi], z[:, k : k + hi - lo]
                if one:
                    u = u - u.max(1, keepdims=True)
                    total = np.log(np.exp(u).sum(1, keepdims=True))
                    w = (t @ weights) * y[:, flag]
                    loss.append((w * (total[:, 0] - (u * t).sum(1))).sum())
                    r[:, k : k + hi - lo] = w[:, None] * (np.exp(u - total) - t)
                else:
                    w = weights[t.astype(np.intp)] * y[:, flag, None]
                    loss.append((w * (np.logaddexp(0, u) - t * u)).sum())
                    r[:, k : k + 1] = w * (1 / (1 + np.exp(-u)) - t)
                k += hi - lo
            return np.array(np.concatenate([x.T @ r, r.sum(0)[None]]).ravel().tolist() + loss)

        got = rows.summed(gradients)
        passes += 1
        g, k = got[: -len(live)].reshape(rows.width + 1, -1), 0
        for p, loss in zip(live, got[-len(live) :], strict=True):
            w = p.search.at.reshape(rows.width + 1, -1)
            own = g[:, k : k + p.b - p.a] / max(p.total, 1e-12)
            k += p.b - p.a
            own[:-1] += w[:-1] / (p.c * max(p.total, 1e-12))
            p.search.take((loss + (w[:-1] ** 2).sum() / (2 * p.c)) / max(p.total, 1e-12), own.ravel(), tol)
    return passes


def fitted(df: DataFrame, vec: str, heads: list[Head], c: float = 1.0, balanced: bool = True, max_iter: int = 100, tol: float = 1e-4) -> list[JointLogistic]:
    """A model for each head. balanced: the labels of a softmax, and the two sides of a label of its own, weigh the same in sum."""
    truth = [x for h in heads for x in h.truth()]
    with Packed(df, vec, F.array(*truth)) as rows:
        if not rows.rows:
            raise ValueError("no rows to fit")
        first = np.cumsum([0, *(len(h.classes) + 1 for h in heads)])
        flags = [int(f) - 1 for f in first[1:]]
        of_flag = np.repeat(flags, np.diff(first))
        counts = rows.summed(lambda x, y, _: (y * y[:, of_flag]).sum(0))
        parts: list[_Part] = []
        for i, h in enumerate(heads):
            n, k, at = counts[flags[i]], len(h.classes), int(first[i])
            own, n_own = h.c or c, [(at, at + k)] * (k > 0) if h.one else [(at + j, at + j + 1) for j in range(k)]
            parts += [part_of(i, lo, hi, flags[i], h.one, n, counts[lo:hi], rows.width, own, balanced) for lo, hi in n_own]
        passes = advance(rows, parts, max_iter, tol)
    out = []
    for i, h in enumerate(heads):
        best = [p.search.x.reshape(rows.width + 1, -1) for p in parts if p.head == i]
        m = np.concatenate(best, axis=1) if best else np.zeros((rows.width + 1, 0))
        out.append(JointLogistic(list(h.classes), m[:-1], m[-1], passes, h.one))
    return out


@dataclass
class JointLogistic:
    """Coefficients (width, labels) and intercepts of the labels in `classes`; with `one`, of a softmax over them."""

    classes: list[str]
    coef: np.ndarray
    intercept: np.ndarray
    passes: int = 0
    one: bool = False

    @staticmethod
    def fitted(df: DataFrame, vec: str, values: str, classes: list[str], c: float = 1.0, balanced: bool = True, max_iter: int = 100, tol: float = 1e-4) -> JointLogistic:
        """Of df's vectors and one array column."""
        return fitted(df, vec, [Head(values, classes)], c, balanced, max_iter, tol)[0] if classes else JointLogistic([], np.zeros((0, 0)), np.zeros(0))

    def scores(self, vector: Column) -> Column:
        """The labels' probabilities, an array in the order of classes."""
        coef, intercept, one = self.coef, self.intercept, self.one

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            blas_threads(1)
            for s in batches:
                z = np.array(s.tolist(), float).reshape(len(s), coef.shape[0]) @ coef + intercept
                p = np.exp(z - z.max(1, keepdims=True)) if one else 1 / (1 + np.exp(-z))
                yield pd.Series(list(np.round(p / p.sum(1, keepdims=True) if one else p, DIGITS)), index=s.index)

        return score(doubles(vector))

    def with_scores(self, df: DataFrame, vec: str, out: str) -> DataFrame:
        ship(df.sparkSession)
        return df.withColumn(out, self.scores(F.col(vec)))

    def predicted(self, df: DataFrame, vec: str, none: str = "none", out: str = "predicted", thresholds: dict[str, float] | None = None) -> DataFrame:
        """df with the sorted array of the labels whose probability reaches their threshold (0.5 if none is given), or the one for none."""
        t = thresholds or {}
        if not self.classes:
            return df.withColumn(out, F.array(F.lit(none)))
        d = self.with_scores(df, vec, "_fn_scores")
        order = sorted(range(len(self.classes)), key=self.classes.__getitem__)
        got = F.array_compact(F.array(*[F.when(F.get("_fn_scores", F.lit(i)) >= t.get(self.classes[i], 0.5), F.lit(self.classes[i])) for i in order]))
        return d.select(*[c for c in df.columns if c != out], F.when(F.size(got) > 0, got).otherwise(F.array(F.lit(none))).alias(out))

    def chosen(self, df: DataFrame, vec: str, out: str = "predicted") -> DataFrame:
        """df with the most probable label, the first in the order of classes if several are."""
        d = self.with_scores(df, vec, "_fn_scores")
        names = F.array(*map(F.lit, self.classes))
        return d.select(*[c for c in df.columns if c != out], F.get(names, (F.array_position("_fn_scores", F.array_max("_fn_scores")) - 1).cast("int")).alias(out))

    def tuned(self, df: DataFrame, vec: str, values: str) -> dict[str, float]:
        """For each label the threshold of its probability with the best F1 on df, which the model wasn't fitted to."""
        from .evaluation import threshold_search

        if not self.classes:
            return {}
        one = [F.struct(F.lit(x).alias("class"), F.get("_fn_scores", F.lit(i)).alias("score"), F.array_contains(values, x).alias("truth")) for i, x in enumerate(self.classes)]
        d = self.with_scores(df.select(vec, values), vec, "_fn_scores").select(F.explode(F.array(*one)).alias("one")).select("one.*")
        return {r["class"]: float(r["threshold"]) for r in threshold_search(d).collect()}

    def as_dict(self) -> dict:
        return {"classes": self.classes, "coef": self.coef.tolist(), "intercept": self.intercept.tolist(), "one": self.one}

    @staticmethod
    def of_dict(d: dict) -> JointLogistic:
        return JointLogistic(d["classes"], np.array(d["coef"]).reshape(-1, len(d["classes"])), np.array(d["intercept"]), 0, d.get("one", False))
