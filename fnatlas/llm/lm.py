"""Language-model scoring: a gated recurrent network with a class-factored output, in numpy.

Lexing: each task cuts its documents into blocks of about BLOCK_BYTES, numbers a block's words, and stores the documents as
these numbers and the block's words with their counts in training documents. A window over a word's rows, one for each
block, sums all counts and gives each block the sums of its own words, so no task holds the vocabulary.

Units: the TOP_WORDS most frequent words are a unit each; other words share one by the power of two of their count and by
SUBS groups of their last two bytes; the end and unseen words are units too. Units are dealt to classes, frequent
words to classes of about equal mass, the others by power. A word's probability is that of its class, a softmax of the
recurrent state, times that of its unit in the class, another softmax of the state, times the word's share of its
unit; so a token costs the same whatever the vocabulary's size. Each unit has an input vector.

Encoding: a block's sums meet its documents; two bytes a token stay (its unit), and the sums of what the network has no part in.

Training: truncated backpropagation over STEPS tokens with the state carried on, by Adam, on every token of every training
document. The network starts from a bounded sample (windows of SAMPLE_TOKENS from SAMPLE_DOCS documents of the smallest
hash), so that blocks agree on what a hidden state means. Then in ROUNDS rounds each training document is gone through once, in
blocks of about TRAIN_BYTES: those of a round begin with the same parameters, and their results are averaged by tokens. Half of
the words seen once count as unseen there.

Scoring: documents go forward in step, longest first, over windows of WINDOW tokens; the state is carried from window to
window to the document's end.

Defined cases: a null text counts as empty and has the end token only; without training documents all counts are 0
and scores are those of an empty model, 0; repeated rows get the same result each; very long texts are blocks of their own
and are scored whole; an empty table gives no rows; other columns are ignored, whatever their names; a null doc_id counts
as training.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import blas_threads
from .common import drop_stored, ship, stored
from .langid import held_out
from .spans import batch

NAMES = ("x", "u", "b", "w", "c", "w2", "c2")  # of the parameters
END = b""  # no word is empty
#: TAIL: powers of two that are told apart; tails beyond the largest one that occurs have no units.
TOP_WORDS, TOP_CLASSES, TAIL, SUBS = 1000, 48, 48, 32
HIDDEN, STREAMS, STEPS = 24, 64, 24
SAMPLE_DOCS, SAMPLE_TOKENS = 1024, 400
EPOCHS, RATE = 3, 0.006
#: Of the passes over all training documents. Blocks have up to BLOCK_STREAMS streams, fewer if that leaves under LEAST_STEPS updates.
ROUNDS, TRAIN_BYTES, BLOCK_STREAMS, LEAST_STEPS, BLOCK_RATE = 4, 8 << 20, 256, 64, 0.003
#: Windows of a block's pass whose gradients go into one update.
BLOCK_WINDOWS = 2
#: Groups in which a round's parameters are summed before the driver gets them.
SUMS = 8
BLOCK_BYTES = 32 << 20
SCORE_TOKENS = 4 << 20
WINDOW = 32
#: Documents that go in step, and rows of a softmax at once, to stay in the CPU's cache.
SCORE_DOCS, SCORE_ROWS = 512, 8192
GRADIENT_ROWS = 2048
FLOOR = 0.02
#: The bound of an exponent, which only weights of no use could reach.
MOST = 80

UNSEEN = 0  # unit and class of unseen words; then the end, the tail by power, and the top
_END_IN = 1
_TAIL_IN = 2


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def sub_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUBS


def exponentials(w: np.ndarray, c: np.ndarray, states: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Of w times the states plus c, a column for each state, and their sums; most: what no such number exceeds."""
    s = w @ states.T
    s += c[:, None]
    if most > MOST:
        np.minimum(s, MOST, out=s)
    np.exp(s, out=s)
    return s, s.sum(0) + 1e-30


_SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as words_of() cuts them, one after another in one array; and how many each text has. No word is a Python object."""
    texts = texts.fill_null("").cast(pa.binary())
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(raw)]
    first[begins] = inside[begins]  # words end where texts end
    at = np.flatnonzero(first)
    offsets = np.r_[np.cumsum(inside, dtype=np.int32)[at] - 1, np.count_nonzero(inside)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])])
    return words, np.diff(np.searchsorted(at, ends))


def planes(numbers: np.ndarray) -> bytes:
    """int32 numbers, first all their first bytes, then the second ones and so on, which Spark packs well."""
    return numbers.view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


_PARTS = "block long, doc_id long, held_out boolean, codes binary, idx int, word binary, c long"
_PARTS_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("codes", pa.binary()), ("idx", pa.int32()), ("word", pa.binary()), ("c", pa.int64())])


def _parts_of(block: int, cut: list[tuple]) -> Iterator[pa.RecordBatch]:
    """cut: of each batch the ids, which are held out, the words, and how many each document has."""
    coded = pa.concat_arrays([words for _, _, words, _ in cut]).dictionary_encode()
    numbers, a, docs = coded.indices.to_numpy() + np.int32(1), 0, []  # number 0 is the end
    for ids, held, _, each in cut:
        for d, h, n in zip(ids.to_pylist(), held.to_pylist(), each.tolist(), strict=True):
            docs.append((d, h, np.append(numbers[a : a + n], np.int32(0))))
            a += n
    yield batch(_PARTS_ARROW, [(block, d, h, planes(codes), None, None, None) for d, h, codes in docs])
    words = pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary])
    training = [codes for _, h, codes in docs if not h]
    counts = np.bincount(np.concatenate(training), minlength=len(words)) if training else np.zeros(len(words), np.int64)
    for lo in range(0, len(words), 100_000):
        n = min(100_000, len(words) - lo)
        nulls = [pa.nulls(n, _PARTS_ARROW.field(c).type) for c in ("doc_id", "held_out", "codes")]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *nulls, pa.array(np.arange(lo, lo + n, dtype=np.int32)), words.slice(lo, n), pa.array(counts[lo : lo + n].astype(np.int64))], schema=_PARTS_ARROW)


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    cut, size = [], 0
    for b in batches:
        if b.num_rows:
            cut.append((b.column(0), b.column(1), *words_in(b.column(2))))
            size += b.column(2).nbytes
        if size >= BLOCK_BYTES:
            yield from _parts_of(block, cut)
            block, cut, size = block + 1, [], 0
    if cut:
        yield from _parts_of(block, cut)


def lexed(documents: DataFrame, remainder: int = 1) -> DataFrame:
    """Rows of documents (block, doc_id, held_out, codes) and of words (block, idx, word, c), stored."""
    ship(documents.sparkSession)
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 5, remainder).alias("held_out"), "text")
    return stored(d.mapInArrow(_lex, _PARTS), "lexed")


@dataclass
class Counts:
    """parts: as lexed() gives them. words: of (the block), idx, c (the sum), key (a hash), sub, and the word itself in one row of it."""

    parts: DataFrame
    words: DataFrame


def counted(documents: DataFrame, remainder: int = 1) -> Counts:
    """The training documents' tokens by word, and by block; both stored."""
    parts = lexed(documents, remainder)
    one = Window.partitionBy("word")  # a row for each block at most
    w = parts.filter("word is not null").select(F.col("block").alias("of"), "idx", "word", F.sum("c").over(one).alias("c"), F.min("block").over(one).alias("first"))
    key = (F.crc32("word") - 2**31).cast("int").alias("key")
    sub = (F.crc32(F.substring("word", -2, 2)) % SUBS).cast("byte").alias("sub")
    w = w.filter("c > 0").select("of", "idx", "c", key, sub, F.when(F.col("of") == F.col("first"), F.col("word")).alias("word"))
    return Counts(parts, stored(w, "counts"))


def _key(word: bytes) -> int:
    return zlib.crc32(word) - 2**31


def _marks(counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number for each pair; equal ones are compared again."""
    return counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ keys.astype(np.uint64)


class Model:
    """Sizes of the training text, units and classes of words, and the network's parameters."""

    def __init__(self, n: int, v: int, top: list[tuple[bytes, int]], end: int, tail: np.ndarray, once: int, subs: np.ndarray | None = None, seed: int = 10) -> None:
        """tail: by power of two, the counts of all words but the end; subs: the same by group too. once: how many words have count 1."""
        self.n, self.v, self.end = n, v, end
        self.learned = 0  # tokens of the passes over all training documents
        tail = tail.astype(float)
        subs = np.repeat(tail[:, None] / SUBS, SUBS, 1) if subs is None else subs.astype(float)
        for w, c in top:
            tail[c.bit_length() - 1] -= c
            subs[c.bit_length() - 1, sub_of(w)] -= c
        self.tails = int(np.flatnonzero(np.r_[1.0, tail > 0])[-1]) or 1
        self.top_in = _TAIL_IN + self.tails * SUBS
        first_top, total, before = 2 + self.tails, max(1, sum(c for _, c in top)), 0
        mass = np.zeros(first_top + TOP_CLASSES)
        units = self.top_in + len(top)
        self.class_of = np.zeros(units, np.int32)  # by unit
        self.unit_mass = np.zeros(units)
        self.top: dict[bytes, tuple[int, int, int]] = {}
        for i, (w, c) in enumerate(top):
            k = first_top + min(TOP_CLASSES - 1, before * TOP_CLASSES // total)
            self.top[w] = (self.top_in + i, k, c)
            self.class_of[self.top_in + i], self.unit_mass[self.top_in + i] = k, c
            mass[k] += c
            before += c
        self.class_of[_END_IN], self.unit_mass[_END_IN], mass[_END_IN] = _END_IN, end, end
        self.class_of[_TAIL_IN : self.top_in] = _TAIL_IN + np.repeat(np.arange(self.tails), SUBS)
        self.unit_mass[_TAIL_IN : self.top_in] = np.maximum(subs[: self.tails].ravel(), 0)
        mass[_TAIL_IN:first_top] = np.maximum(tail[: self.tails], 0)
        self.mass = mass  # of the words of a class, which share it by their counts
        #: The units of class k are those from edges[k] to edges[k + 1].
        self.edges = np.searchsorted(self.class_of, np.arange(len(mass) + 1))
        prior = mass.copy()
        prior[UNSEEN] = once / 2 + 0.5
        prior[_TAIL_IN] = max(prior[_TAIL_IN] - once / 2, 0)
        prior += 1e-3
        self.prior = (prior / prior.sum()).astype(np.float32)
        of_class = np.maximum(np.bincount(self.class_of, self.unit_mass + 1e-3, len(mass)), 1e-3)
        self.unit_prior = ((self.unit_mass + 1e-3) / of_class[self.class_of]).astype(np.float32)
        #: log10 of a unit's share of its class.
        self.unit_share = np.log10(np.maximum(self.unit_mass, 1e-9) / np.maximum(mass[self.class_of], 1e-9))
        self.unit_share[UNSEEN] = 0
        r = np.random.default_rng(seed)
        # by gate: update, reset, new state; each gate's numbers lie together, so numpy takes them in long runs
        self.x = r.normal(0, 0.1, (3, units, HIDDEN)).astype(np.float32)
        self.u = r.normal(0, HIDDEN**-0.5, (3, HIDDEN, HIDDEN)).astype(np.float32)
        self.b = np.zeros((3, 1, HIDDEN), np.float32)
        self.b[0] = 1
        self.w = r.normal(0, 0.1, (HIDDEN, len(mass))).astype(np.float32)
        self.c = np.log(self.prior)
        self.w2 = r.normal(0, 0.1, (units, HIDDEN)).astype(np.float32)
        self.c2 = np.log(self.unit_prior)

    @property
    def once_in(self) -> int:
        """Codes from here on: words seen once that count as unseen in training, by group."""
        return len(self.class_of)

    def of(self, word: bytes, c: int) -> tuple[int, int, float]:
        """Unit, class, and log10 of the share in its class, of a word with count c."""
        if c <= 0:
            return UNSEEN, UNSEEN, 0.0
        if word == END:
            return _END_IN, _END_IN, 0.0
        if word in self.top:
            i, k, _ = self.top[word]
        else:
            power = min(self.tails, c.bit_length()) - 1
            i, k = _TAIL_IN + power * SUBS + sub_of(word), _TAIL_IN + power
        return i, k, float(np.log10(min(1.0, c / max(self.mass[k], c))))

    def of_all(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of many words whose counts aren't 0, after the unseen word's at place 0."""
        got = [(UNSEEN, UNSEEN, 0.0), *(self.of(w, int(c)) for w, c in zip(words, counts, strict=True))]
        i, k, share = zip(*got, strict=True)
        return np.array(i, np.int32), np.array(k, np.int32), np.array(share)

    def step(self, inputs: np.ndarray, h: np.ndarray) -> tuple:
        return self.gated(self.x.take(inputs, 1), h)

    def gated(self, x: np.ndarray, h: np.ndarray) -> tuple:
        """The new state, its gates, and what the gradient needs. Sigmoids and tanh go by exp, which numpy has in vector form; one that overflows gives the limit."""
        u = np.matmul(h, self.u)
        u += self.b
        zr = x[:2] + u[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.divide(1, zr, out=zr)
        z, r, un = zr[0], zr[1], u[2]
        n = r * un
        n += x[2]
        n *= 2
        np.exp(n, out=n)
        n += 1
        np.divide(-2, n, out=n)
        n += 1
        new = h - n
        new *= z
        new += n
        return new, z, r, un, n

    def most(self) -> tuple[float, float]:
        """What exponents of classes and of units in a class can't exceed, since states lie between -1 and 1."""
        return float((np.abs(self.w).sum(0) + self.c).max()), float((np.abs(self.w2).sum(1) + self.c2).max())

    def by_class(self, units: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """An order of tokens by class; and for each class with several units that occurs, where its tokens are in that order, and its units."""
        classes = self.class_of.take(units)
        order = np.argsort(classes.astype(np.uint16), kind="stable")
        ends = np.searchsorted(classes.take(order), np.arange(len(self.mass) + 1))
        some = np.flatnonzero((np.diff(ends) > 0) & (np.diff(self.edges) > 1)).tolist()
        return order, [(int(ends[k]), int(ends[k + 1]), int(self.edges[k]), int(self.edges[k + 1])) for k in some]

    def gradients(self, inputs: np.ndarray, classes: np.ndarray, units: np.ndarray | None, h: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss (natural logarithm, summed), its gradients over the number of streams, and the last state, of (streams, time) arrays."""
        streams, steps = inputs.shape
        used = np.ascontiguousarray(inputs.T)
        most, most_units = self.most()
        xs, goes_on = self.x.take(used, 1), (used != _END_IN).astype(self.u.dtype)[:, :, None]
        kept, before, hs = [], np.empty((steps, streams, HIDDEN), self.u.dtype), np.empty((steps, streams, HIDDEN), self.u.dtype)
        for t in range(steps):
            h0 = np.multiply(h, goes_on[t], out=before[t])
            h, z, r, un, n = self.gated(xs[:, t], h0)
            kept.append((z, r, un, n))
            hs[t] = h
        flat, y = hs.reshape(-1, HIDDEN), np.ascontiguousarray(classes.T).ravel()
        grads = {k: np.zeros_like(getattr(self, k)) for k in ("w", "c", "w2", "c2")}
        dhs, loss, wt = np.empty_like(flat), 0.0, np.ascontiguousarray(self.w.T)
        for lo in range(0, len(y), GRADIENT_ROWS):
            some, own = flat[lo : lo + GRADIENT_ROWS], y[lo : lo + GRADIENT_ROWS]
            each = np.arange(len(own))
            p, total = exponentials(wt, self.c, some, most)
            p *= 1 / total
            loss -= float(np.log(p[own, each] + 1e-30).sum())
            p[own, each] -= 1
            dhs[lo : lo + GRADIENT_ROWS] = p.T @ wt
            grads["w"] += (p @ some).T
            grads["c"] += p.sum(1)
        if units is not None:
            unit = np.ascontiguousarray(units.T).ravel()
            order, groups = self.by_class(unit)
            states, unit, back, hit = flat.take(order, 0), unit.take(order), np.zeros_like(flat), np.ones(len(order), flat.dtype)
            for a, e, lo, hi in groups:
                own, each = unit[a:e] - lo, np.arange(e - a)
                q, total = exponentials(self.w2[lo:hi], self.c2[lo:hi], states[a:e], most_units)
                q *= 1 / total
                hit[a:e] = q[own, each]
                q[own, each] -= 1
                np.matmul(q, states[a:e], out=grads["w2"][lo:hi])
                q.sum(1, out=grads["c2"][lo:hi])
                np.matmul(q.T, self.w2[lo:hi], out=back[a:e])
            loss -= float(np.log(hit + 1e-30).sum())
            dhs[order] += back
        dhs = dhs.reshape(steps, streams, HIDDEN)
        dx, du = (np.empty((3, steps, streams, HIDDEN), self.u.dtype) for _ in range(2))
        dh, ut = np.zeros((streams, HIDDEN), self.u.dtype), np.ascontiguousarray(self.u.transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            z, r, un, n = kept[t]
            dh += dhs[t]
            rest = 1 - z
            dn, dz, dr, dun = dx[2, t], dx[0, t], dx[1, t], du[2, t]
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= rest
            dn *= dh
            np.subtract(before[t], n, out=dz)
            dz *= dh
            dz *= z
            dz *= rest
            np.multiply(dn, r, out=dun)
            np.subtract(1, r, out=dr)
            dr *= dun
            dr *= un
            dh *= z
            dh += dz @ ut[0]
            dh += dr @ ut[1]
            dh += dun @ ut[2]
            dh *= goes_on[t]
        du[:2] = dx[:2]
        flat_in, dx, du = used.ravel(), dx.reshape(3, -1, HIDDEN), du.reshape(3, -1, HIDDEN)
        order = np.argsort(flat_in.astype(np.uint16), kind="stable")
        by = flat_in[order]
        first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
        grads["x"] = np.zeros_like(self.x)
        side = np.empty((len(order), 3, HIDDEN), dx.dtype)
        for k in range(3):
            side[:, k] = dx[k].take(order, 0)
        sums = np.add.reduceat(side.reshape(-1, 3 * HIDDEN), first, 0)
        grads["x"][:, by[first]] = sums.reshape(-1, 3, HIDDEN).transpose(1, 0, 2)
        grads["u"] = np.matmul(before.reshape(-1, HIDDEN).T, du)
        grads["b"] = np.matmul(np.ones((1, len(order)), du.dtype), du)
        for g in grads.values():
            g /= streams
        return loss, grads, h

    def fit(self, inputs: np.ndarray, classes: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, units: np.ndarray | None = None, windows: int = 1) -> list[float]:
        """Truncated backpropagation through (streams, time) arrays, inputs[:, t] coming before classes[:, t] and units[:, t]; an update for so many windows."""
        for k in NAMES:
            setattr(self, k, getattr(self, k).copy())
        names = [k for k in NAMES if units is not None or k not in ("w2", "c2")]
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        count, losses = 0, []
        streams, length = inputs.shape
        for _ in range(epochs):
            h, total, held = np.zeros((streams, HIDDEN), np.float32), 0.0, None
            for lo in range(0, length, STEPS):
                at = slice(lo, min(length, lo + STEPS))
                with np.errstate(over="ignore"):
                    loss, grads, h = self.gradients(inputs[:, at], classes[:, at], None if units is None else units[:, at], h)
                total += loss
                if held:
                    for k in names:
                        grads[k] += held[k]
                held = grads
                if lo // STEPS % windows < windows - 1 and lo + STEPS < length:
                    continue
                held = None
                norm = float(np.sqrt(sum(float(np.vdot(grads[k], grads[k])) for k in names)))
                cut = min(1.0, 5 / max(norm, 1e-9))
                count += 1
                up, root = rate / (1 - 0.9**count), (1 - 0.999**count) ** -0.5
                for k in names:
                    g = grads[k]
                    g *= cut
                    m[k] *= 0.9
                    m[k] += 0.1 * g
                    v[k] *= 0.999
                    g *= g
                    g *= 0.001
                    v[k] += g
                    np.sqrt(v[k], out=g)
                    g *= root
                    g += 1e-8
                    np.divide(m[k], g, out=g)
                    g *= up
                    getattr(self, k)[...] -= g
            losses.append(total / inputs.size)
        return losses

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in NAMES])

    def with_parameters(self, flat: np.ndarray) -> Model:
        """A copy with these parameters, as parameters() gives them."""
        out, at = copy.copy(self), 0
        for k in NAMES:
            old = getattr(self, k)
            setattr(out, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return out

    def learn(self, codes: np.ndarray, streams: int, epochs: int, rate: float, windows: int = 1) -> None:
        """Fits to all codes of documents that follow one another; the last stream is filled up from the start."""
        y = np.where(codes >= self.once_in, UNSEEN, codes).astype(np.int32)
        x = np.r_[np.int32(_END_IN), y[:-1]]
        shape = streams, -(-len(y) // streams)
        self.fit(np.resize(x, shape), np.resize(self.class_of[y], shape), epochs, rate, np.resize(y, shape), windows)

    def class_scores(self, inputs: list[np.ndarray], classes: list[np.ndarray], units: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """log10 P(class) of each token of each document; all documents go forward in step, longest first.

        With units, what the state says of the unit in its class comes to it: log10 of P(unit | class) over its share.
        """
        order = sorted(range(len(inputs)), key=lambda i: -len(inputs[i]))
        out: list = [None] * len(inputs)
        for lo in range(0, len(order), SCORE_DOCS):
            some = order[lo : lo + SCORE_DOCS]
            with np.errstate(over="ignore"):
                parts = self._in_step(some, inputs, classes, units)
            for i, got in zip(some, parts, strict=True):
                out[i] = got
        return out

    def _in_step(self, order: list[int], inputs: list[np.ndarray], classes: list[np.ndarray], units: list[np.ndarray] | None) -> list[np.ndarray]:
        lengths = np.array([len(inputs[i]) for i in order])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        flat_in = np.concatenate([np.r_[_END_IN, inputs[i][:-1]] for i in order]).astype(np.int32)
        flat_out = np.concatenate([classes[i] for i in order]).astype(np.int32)
        flat_unit = np.concatenate([units[i] for i in order]).astype(np.int32) if units is not None else None
        got = np.empty(len(flat_in), np.float32)
        h = np.zeros((len(order), HIDDEN), np.float32)
        active, t = len(order), 0
        (most, most_units), wt = self.most(), np.ascontiguousarray(self.w.T)
        while active:
            hs, places = [], []
            for _ in range(WINDOW):
                active = int(np.searchsorted(-lengths, -t, "left"))  # lengths above t
                if not active:
                    break
                at = starts[:active] + t
                h = self.step(flat_in[at], h[:active])[0]
                hs.append(h)
                places.append(at)
                t += 1
            if hs:
                at = np.concatenate(places)
                states = np.concatenate(hs)
                for lo in range(0, len(at), SCORE_ROWS):
                    here, some = at[lo : lo + SCORE_ROWS], states[lo : lo + SCORE_ROWS]
                    s, total = exponentials(wt, self.c, some, most)
                    y = flat_out[here]
                    got[here] = np.log10((1 - FLOOR) * s[y, np.arange(len(y))] / total + FLOOR * self.prior[y])
                    if flat_unit is not None:
                        unit = flat_unit[here]
                        order, groups = self.by_class(unit)
                        some, unit, hit = some.take(order, 0), unit.take(order), np.ones(len(order), np.float32)
                        for a, e, first, last in groups:
                            q, total = exponentials(self.w2[first:last], self.c2[first:last], some[a:e], most_units)
                            hit[a:e] = q[unit[a:e] - first, np.arange(e - a)] / total
                        got[here[order]] += np.log10((1 - FLOOR) * hit + FLOOR * self.unit_prior[unit]) - self.unit_share[unit]
        return [got[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def untrained(counts: Counts) -> Model:
    """The model of the counts, before its network has learned."""
    words = counts.words.filter("word is not null")
    power = F.least(F.lit(TAIL), F.length(F.bin("c"))).alias("power")
    tail, subs, end, n, v, once = np.zeros(TAIL, np.int64), np.zeros((TAIL, SUBS), np.int64), 0, 0, 0, 0
    groups = words.groupBy(power, "sub", (F.col("word") == F.lit(END)).alias("is_end"))
    for r in groups.agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect():  # at most 2 * TAIL * SUBS rows
        n, v = n + r["c"], v + r["v"]
        if r["is_end"]:
            end = r["c"]
        else:
            tail[r["power"] - 1] += r["c"]
            subs[r["power"] - 1, r["sub"]] += r["c"]
            once += r["once"]
    top = words.filter(F.col("word") != F.lit(END)).select("word", "c").orderBy(F.desc("c"), "word").limit(TOP_WORDS).collect()
    return Model(n, v, [(bytes(r["word"]), r["c"]) for r in top if r["c"] > 1], end, tail, once, subs)


def _window(codes: str = "codes") -> Column:
    """At most SAMPLE_TOKENS of the codes, two bytes each, from a hashed place."""
    last = F.greatest(F.lit(0), F.octet_length(codes) / 2 - SAMPLE_TOKENS).cast("long") + 1
    return F.substring(F.col(codes), (2 * (F.crc32(codes) % last) + 1).cast("int"), F.lit(2 * SAMPLE_TOKENS))


def sampled(training: DataFrame) -> DataFrame:
    """h, codes: windows of the SAMPLE_DOCS documents of the smallest hash. Only the hashes are sorted, so what reaches the driver is the sample."""
    d = training.select(F.xxhash64("doc_id", "codes").alias("h"), _window().alias("codes"))
    most = d.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    return d.filter(F.col("h") <= F.lit(most)).orderBy("h", "codes").limit(SAMPLE_DOCS)


def started(model: Model, training: DataFrame) -> Model:
    """The model fitted to a bounded sample of the encoded training documents; trained() goes on from it."""
    rows = sampled(training).collect()
    if rows:
        windows = [np.frombuffer(bytes(r["codes"]), np.uint16) for r in sorted(rows, key=lambda r: (r["h"], bytes(r["codes"])))]
        codes = np.concatenate([w if w[-1] == _END_IN else np.r_[w, np.uint16(_END_IN)] for w in windows])  # a window that ends within its text gets an end
        before = blas_threads(1)
        model.learn(codes, min(STREAMS, max(1, len(codes) // (2 * STEPS))), EPOCHS, RATE)
        blas_threads(before)
    return model


_SUMS = "part int, n long, total binary"
_SUMS_ARROW = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("total", pa.binary())])


def _learning(begin):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is a block: its documents by id, so that a task that runs twice learns the same."""
        rows = sorted(((d, c) for b in batches for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            blas_threads(1)  # a task has one core
            codes = np.frombuffer(b"".join(r[1] for r in rows), np.uint16)
            model = copy.copy(begin.value)  # fit() puts new arrays in the place of the parameters
            model.learn(codes, min(BLOCK_STREAMS, max(1, len(codes) // (STEPS * LEAST_STEPS))), 1, BLOCK_RATE, BLOCK_WINDOWS)
            yield batch(_SUMS_ARROW, [(TaskContext.get().partitionId() % SUMS, len(codes), model.parameters().tobytes())])

    return learn


def _summed(some: pa.Table) -> pa.Table:
    """The mean of some blocks' parameters, by their tokens."""
    blocks = sorted(zip(some.column("total").to_pylist(), some.column("n").to_pylist(), strict=True))
    n = sum(b[1] for b in blocks)
    mean = sum(np.frombuffer(x, np.float32).astype(np.float64) * (k / n) for x, k in blocks).astype(np.float32)
    return pa.Table.from_pylist([{"part": some.column("part")[0].as_py(), "n": n, "total": mean.tobytes()}], _SUMS_ARROW)


def trained(model: Model, encoded: DataFrame, size: int) -> Model:
    """The model after a pass over all encoded training documents; size: bytes of all texts."""
    spark = encoded.sparkSession
    training = encoded.filter("not held_out")
    model = started(model, training)
    blocks = max(1, -(-size // TRAIN_BYTES))
    rounds = min(ROUNDS, blocks)
    d = training.select("doc_id", "codes", F.xxhash64("doc_id", "codes", F.lit(1)).alias("h"))
    for k in range(rounds):
        begin = spark.sparkContext.broadcast(model)  # of fixed size
        mine = d.filter(F.pmod("h", F.lit(rounds)) == k).repartition(-(-blocks // rounds))  # document by document in turn, so blocks are even
        sums = mine.mapInArrow(_learning(begin), _SUMS).groupBy("part").applyInArrow(_summed, _SUMS).collect()
        if n := sum(r["n"] for r in sums):
            learned = model.learned + n
            model = model.with_parameters(sum(np.frombuffer(r["total"], np.float32).astype(np.float64) * (r["n"] / n) for r in sorted(sums, key=lambda r: r["part"])))
            model.learned = learned
    return model


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, share double, codes binary"
_CODED_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("share", pa.float64()), ("codes", pa.binary())])


def encode_block(model: Model, docs: list[tuple], idx: np.ndarray, counts: np.ndarray, keys: np.ndarray, subs: np.ndarray) -> list[tuple]:
    """Encoded rows of docs (doc_id, held_out, numbers of words); of numbers that training documents have, their words' counts, keys and groups. Number 0 is the end."""
    numbers = [unplaned(d[2]) for d in docs]
    size = 1 + max((int(x.max()) for x in numbers), default=0)
    c, key, sub = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    c[idx], key[idx], sub[idx] = counts, keys, subs
    power = np.minimum(model.tails, np.frexp(c.astype(float))[1])
    unit = np.where(c > 0, _TAIL_IN + (power - 1) * SUBS + sub, UNSEEN)
    if model.top:  # a word of the top is known by its count and its key
        names = np.array([(k, _key(w), i) for w, (i, _, k) in model.top.items()], np.int64)
        marks = _marks(names[:, 0], names[:, 1])
        names, marks = names[np.argsort(marks)], np.sort(marks)
        at = np.minimum(np.searchsorted(marks, _marks(c, key)), len(marks) - 1)
        found = (names[at, 0] == c) & (names[at, 1] == key)
        unit[found] = names[at[found], 2]
    unit[0], c[0] = (_END_IN, model.end) if model.end else (UNSEEN, 0)
    share = np.where(c > 0, np.log10(np.maximum(c, 1) / np.maximum(np.maximum(model.mass[model.class_of[unit]], c), 1)), 0.0)
    share[0] = 0.0
    code = np.where((c == 1) & (key & 1 == 1) & (unit >= _TAIL_IN), model.once_in + sub, unit).astype(np.uint16)
    base = np.log10((c + 0.5) / (model.n + 0.5 * (model.v + 1)))
    return [(d, held, len(x), int((c[x] > 0).sum()), float(base[x].sum()), float(share[x].sum()), code[x].tobytes()) for (d, held, _), x in zip(docs, numbers, strict=True)]


def encoded(documents: DataFrame, counts: Counts, model: Model, size: int) -> DataFrame:
    """The documents' tokens as codes, stored."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def encode(docs: pa.Table, words: pa.Table) -> pa.Table:
        rows = list(zip(*(docs.column(c).to_pylist() for c in ("doc_id", "held_out", "codes")), strict=True))
        known = [words.column(c).to_numpy() for c in ("idx", "c", "key", "sub")]
        return pa.Table.from_batches([batch(_CODED_ARROW, encode_block(held.value, rows, *known))])

    d = counts.parts.filter("codes is not null").select("block", "doc_id", "held_out", "codes")
    w = counts.words.select("of", "idx", "c", "key", "sub")
    return stored(d.groupBy("block").cogroup(w.groupBy("of")).applyInArrow(encode, _CODED), "encoded")


def scored(documents: DataFrame, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    spark = documents.sparkSession
    ship(spark)
    counts = counted(documents, remainder)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = untrained(counts)
    coded = encoded(documents, counts, model, size)
    drop_stored(counts.parts, counts.words)
    model = spark.sparkContext.broadcast(trained(model, coded, size))

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        blas_threads(1)  # a task has one core
        m = model.value
        units = [np.frombuffer(r[6], np.uint16).astype(np.int32) for r in rows]
        units = [np.where(i >= m.once_in, i - m.once_in + _TAIL_IN, i) for i in units]
        scores = m.class_scores(units, [m.class_of[i] for i in units], units) if m.n else [np.zeros(len(i)) for i in units]
        return batch(_OUT_ARROW, [(d, held, n, known, m.n, base, float(s.sum(dtype=np.float64) + share)) for (d, held, n, known, base, share, _), s in zip(rows, scores, strict=True)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, tokens = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(r)
                tokens += r[2]
                if tokens >= SCORE_TOKENS:
                    yield rows_of(rows)
                    rows, tokens = [], 0
        if rows:
            yield rows_of(rows)

    return coded.mapInArrow(score, _OUT)
