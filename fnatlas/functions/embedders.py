"""Embedders: a registry of pluggable models, and a deterministic hashed one that needs no model file.

An embedder is any object with `name`, `dim`, `max_length` (its limit of context in tokens, None for none) and
`embed_batch(codes) -> array (n, dim)`. Its factory runs once in each Python worker, and codes reach it in Arrow batches.
"""

from __future__ import annotations

import logging
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

LOG = logging.getLogger(__name__)

#: One text for a purpose that is missing, in training and afterwards.
NO_PURPOSE = "unknown purpose"

_TOKEN = re.compile(r"\w+|[^\w\s]")


@dataclass
class HashedEmbedder:
    """Signed hashing of all tokens, mean-pooled, of unit length; it has no limit of context."""

    dim: int = 64
    max_length: int | None = None
    name: str = "hashed"

    def embed_batch(self, codes: list[str | None]) -> np.ndarray:
        known: dict[str, int] = {}
        tokens = [[known.setdefault(t, len(known)) for t in _TOKEN.findall(code or "")] for code in codes]
        h = np.array([zlib.crc32(t.encode()) for t in known], np.int64)  # each distinct token once
        at = np.array([t for x in tokens for t in x], np.int64)
        row = np.repeat(np.arange(len(codes)), [len(x) for x in tokens])
        sign = np.where(h[at] >> 31, 1.0, -1.0) if len(at) else np.zeros(0)
        place = row * self.dim + (h[at] % self.dim if len(at) else at)
        out = np.bincount(place, sign, len(codes) * self.dim).reshape(len(codes), self.dim)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


def pooled(hidden: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """A model's states (n, tokens, dim) as one vector each: of the first token, or the mean over the tokens of the mask."""
    if how == "first":
        return hidden[:, 0]
    m = mask[:, :, None].astype(float)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)


@dataclass
class PooledEmbedder:
    """A model by its function states(codes, max_length) -> (hidden, mask), which is called for `batch` codes at once."""

    states: Callable[[list[str], int], tuple[np.ndarray, np.ndarray]]
    name: str
    dim: int
    how: str = "mean"
    max_length: int = 512
    batch: int = 8

    def embed_batch(self, codes: list[str | None]) -> np.ndarray:
        parts = [pooled(*self.states([c or "" for c in codes[i : i + self.batch]], self.max_length), self.how) for i in range(0, len(codes), self.batch)]
        return np.concatenate(parts) if parts else np.zeros((0, self.dim))


#: Pooling, limit of context in tokens, and codes at once of known kinds of models, for PooledEmbedder.
KINDS = {"codebert": ("first", 512, 8), "qwen3": ("mean", 512, 4), "jina": ("mean", 4096, 4), "codesage": ("mean", 1024, 4), "nomic": ("mean", 4096, 4)}


def register_states(kind: str, states: Callable[[], Callable], dim: int) -> None:
    """Makes a model of a known kind available; states() loads it in a Python worker."""
    how, max_length, batch = KINDS[kind]
    register(kind, lambda: PooledEmbedder(states(), kind, dim, how, max_length, batch))


REGISTRY: dict[str, Callable[[], object]] = {"hashed": HashedEmbedder}
#: What tells whether a model can be loaded, and the name that takes its place if not.
CHECKS: dict[str, tuple[Callable[[], object], str]] = {}


def register(name: str, factory: Callable[[], object], usable: Callable[[], object] | None = None, instead: str = "hashed") -> None:
    """Makes a model available by name: its factory is called in the Python workers.

    usable is asked on the driver before a model is used: if it fails or says no, `instead` takes its place, for all rows alike.
    """
    REGISTRY[name] = factory
    CHECKS.pop(name, None)
    if usable is not None:
        CHECKS[name] = (usable, instead)


def factory(name: str) -> Callable[[], object]:
    """The factory of a name, or of what stands in for it; unknown names get the hashed embedder, so a pipeline always runs."""
    for _ in range(len(CHECKS)):  # what stands in may be checked too
        if name not in CHECKS:
            break
        usable, instead = CHECKS[name]
        try:
            fine = bool(usable())
        except Exception:  # noqa: BLE001  whatever keeps a model from loading
            LOG.warning("embedder %s can't be used; %s takes its place", name, instead, exc_info=True)
            fine = False
        if fine:
            break
        name = instead
    return REGISTRY.get(name, HashedEmbedder)


def embedding(text: Column, name: str = "hashed") -> Column:
    ship(SparkSession.active())  # before the function is made: it takes the files that are known then
    make = factory(name)

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(list(np.asarray(model.embed_batch(s.tolist()), float)), index=s.index)

    return embed(text)


def purpose_text(purpose: Column) -> Column:
    return F.coalesce(F.nullif(purpose, F.lit("")), F.lit(NO_PURPOSE))


def with_embeddings(df: DataFrame, code: str = "function_code", purpose: str | None = None, name: str = "hashed") -> DataFrame:
    """df with `embedding`, and `purpose_embedding` if a purpose column is given."""
    out = df.withColumn("embedding", embedding(F.col(code), name))
    return out.withColumn("purpose_embedding", embedding(purpose_text(F.col(purpose)), name)) if purpose else out
