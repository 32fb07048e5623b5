"""Language identification with a byte convolutional network in numpy.

Bytes are embedded, filters of several widths run over a window of WINDOW bytes, each filter's largest response over
the window goes through a ReLU to a softmax over the languages. A text is cut into windows, all of it; its prediction
is the largest mean of the windows' log-probabilities, weighted by their bytes, and its score is that class's
probability. Windows that hold no letters don't vote.

Training: the languages are those of all labelled training documents. The network is fitted by Adam to all windows of a
bounded sample of them: of each language those distinct texts that come first by hash, until they have train_bytes / languages
bytes, and the text that goes beyond. The bound makes training cost the same at any size; prediction reads every byte of
every text.

Defined cases: a null text or one without letters gets `und` and score 0, and so does every text if no training
document has a language; rows whose lang is null are predicted but not learned from; repeated rows get the same
result each and are learned from once; very long texts are learned from and predicted whole; of equally likely languages the
first by name is taken; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import blas_threads
from .common import ship
from .spans import batch

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 16
#: The default of train_bytes.
TRAIN_BYTES = 4 << 20
EPOCHS, BATCH, RATE = 6, 64, 0.004
UNKNOWN = "und"
#: Windows whose responses are held at once, to stay in the CPU's cache.
TILE = 24

_LETTER = regex.compile(r"\p{L}")
_PAD = 32  # a space
_MAX = max(WIDTHS)


class ByteNet:
    """Parameters: e (256 x EMBED), f (_MAX * EMBED x filters of all widths, zero beyond a filter's width), b, w, c."""

    def __init__(self, languages: list[str], seed: int = 4) -> None:
        r = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.languages = languages
        self.e = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.zeros((_MAX * EMBED, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.f = (r.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.b = np.zeros(n, np.float32)
        self.w = r.normal(0, 0.3, (n, len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """The _MAX bytes' embeddings from each place of each window on."""
        x = self.e[windows].reshape(len(windows), -1)
        places = windows.shape[1] - _MAX + 1
        return np.lib.stride_tricks.sliding_window_view(x, _MAX * EMBED, 1)[:, :: EMBED][:, :places].reshape(-1, _MAX * EMBED)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        places = windows.shape[1] - _MAX + 1
        out = np.empty((len(windows), self.f.shape[1]), np.float32)
        for lo in range(0, len(windows), TILE):
            some = windows[lo : lo + TILE]
            out[lo : lo + TILE] = (self.columns(some) @ self.f).reshape(len(some), places, -1).max(1)
        return np.maximum(out + self.b, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.w + self.c
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        names = ("e", "f", "b", "w", "c")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        places, step = windows.shape[1] - _MAX + 1, 0
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for lo in range(0, len(order), BATCH):
                at = order[lo : lo + BATCH]
                win, n = windows[at], len(at)
                col = self.columns(win)
                z = (col @ self.f).reshape(n, places, -1)
                where = z.argmax(1)
                top = np.take_along_axis(z, where[:, None], 1)[:, 0] + self.b
                h = np.maximum(top, 0)
                s = h @ self.w + self.c
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), y[at]] -= 1
                p /= n
                dh = (p @ self.w.T) * (top > 0)
                picked = col.reshape(n, places, -1)[np.arange(n)[:, None], where]  # n x filters x column
                df = np.einsum("nk,nkc->ck", dh, picked) * self.mask
                dcol = dh[:, :, None] * self.f.T[None]
                ids = win[np.arange(n)[:, None, None], where[:, :, None] + np.arange(_MAX)]
                de = np.zeros_like(self.e)
                np.add.at(de, ids.reshape(-1), dcol.reshape(-1, EMBED))
                grads = {"e": de, "f": df, "b": dh.sum(0), "w": h.T @ p, "c": p.sum(0)}
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * grads[k]
                    v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                    setattr(self, k, getattr(self, k) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))


def cut(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All of a text in windows of WINDOW bytes, the last one padded with spaces, and their bytes."""
    n = -(-len(raw) // WINDOW)
    out = np.full(n * WINDOW, _PAD, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(raw) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), sizes


def _is_letter(w: np.ndarray) -> np.ndarray:
    return ((w | 32) - 97 < 26) | (w >= 128)


def held_out(doc_id: Column, of: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("windows", pa.binary())])
    for b in batches:
        yield batch(schema, [(lang, cut(text.encode("utf-8", "surrogatepass"))[0].tobytes()) for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])


def sampled(labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> tuple[list[str], DataFrame]:
    """All languages of (lang, text), and the sample's distinct rows: of each language the first by hash, by an even share of bytes.

    Rows beyond a bound of the hash, under which there are several times the share, are left out before the others are
    sorted, so that no task gets a whole language. Copies of a text count once.
    """
    d = labelled.select("lang", "text", F.xxhash64("text", F.lit(4)).alias("h"), F.octet_length("text").alias("size"))
    totals = d.select("lang", "h", "size").distinct().groupBy("lang").agg(F.sum("size").alias("size"), F.max("size").alias("largest")).collect()
    languages = sorted(r["lang"] for r in totals)
    if not languages:
        return [], d.select("lang", "text").limit(0)
    share, steps = train_bytes // len(languages), 1 << 30
    upto = {r["lang"]: min(steps, 1 + int(4 * (share + r["largest"]) / r["size"] * steps)) for r in totals}
    bound, at = F.create_map(*[F.lit(x) for pair in upto.items() for x in pair]), F.pmod("h", F.lit(steps))
    d = d.filter(at < F.element_at(bound, F.col("lang"))).dropDuplicates(["lang", "text"])
    before = F.sum("size").over(Window.partitionBy("lang").orderBy(at, "h", "text").rowsBetween(Window.unboundedPreceding, -1))
    return languages, d.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < share).select("lang", "text")


def trained(documents: DataFrame, train_bytes: int = TRAIN_BYTES) -> ByteNet | None:
    """A network fitted to a bounded sample of the labelled documents that aren't held out."""
    ship(documents.sparkSession)
    d = documents.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    languages, sample = sampled(d, train_bytes)
    if not languages:
        return None
    rows = sorted((r["lang"], bytes(r["windows"])) for r in sample.mapInArrow(_windows, "lang string, windows binary").collect())
    net = ByteNet(languages)
    if len(languages) > 1:
        before = blas_threads(1)
        windows = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
        net.fit(windows, np.repeat([languages.index(r[0]) for r in rows], [len(r[1]) // WINDOW for r in rows]))
        blas_threads(before)
    return net


def predicted(net: ByteNet | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """The language and score of each text; windows of many texts go through the network together."""
    out: list = [(UNKNOWN, 0.0)] * len(texts)
    if net is None:
        return out
    parts, owners, weights = [], [], []
    for i, text in enumerate(texts):
        if text and _LETTER.search(text):
            win, sizes = cut(text.encode("utf-8", "surrogatepass"))
            parts.append(win)
            weights.append(sizes)
            owners.append(np.full(len(win), i))
    if not parts:
        return out
    win, own = np.concatenate(parts), np.concatenate(owners)
    weight = np.concatenate(weights) * np.where(_is_letter(win).any(1), 1.0, 1e-6)
    logs = net.log_probabilities(win) * weight[:, None]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    z = np.add.reduceat(logs.astype(np.float64), starts, 0) / np.add.reduceat(weight, starts)[:, None]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    for i, k, q in zip(own[starts].tolist(), p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
        out[i] = (net.languages[k], min(1.0, q))
    return out


def identified(documents: DataFrame, net: ByteNet | None = None, *keep: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document, and the columns in keep."""
    net = net or trained(documents)
    ship(documents.sparkSession)
    d = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text"), *keep)
    names = [c for c in d.columns if c != "text"]
    out = d.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    out["lang_pred"].nullable = out["score"].nullable = True

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blas_threads(1)  # a task has one core
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = predicted(net, part.column("text").to_pylist())
                columns = [part.column(c) for c in names] + [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    return d.mapInArrow(predict, out)


def accepted(documents: DataFrame, times_chance: float = 1.2) -> DataFrame:
    """documents but those whose language can't be told: no letters, or a score that is close to chance."""
    ship(documents.sparkSession)
    net, columns = trained(documents), documents.columns
    least = times_chance / len(net.languages) if net and len(net.languages) > 1 else 0.0

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blas_threads(1)  # a task has one core
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = predicted(net, part.column(columns.index("text")).to_pylist())
                yield part.filter(pa.array([x[0] != UNKNOWN and x[1] >= least for x in got], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
