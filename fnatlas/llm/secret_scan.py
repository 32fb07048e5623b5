"""Secrets by a battery of randomness tests.

The base spans are fixed patterns. Candidates are the maximal runs of at least 20 characters of [A-Za-z0-9+/_=-] that aren't UUIDs,
which name things. For the encoding that its characters allow (decimal, hex, base32, lower case, alphanumeric, base64, ...) each is
tested for uniformity (chi-squared, Wilson-Hilferty), runs (of vowels and other characters where the encoding has words' letters, else
of the alphabet's halves), and serial correlation. Fisher's sum of the three gives the probability u of a random string looking as
uneven; log10 (1000 u) is the score: one in a thousand random strings is below 0, and names are lower. Nothing is added for mixed
character classes.

What names score is measured, per encoding: from all words of each document, some consecutive ones at a time, decoys are made the way names
are, in turn: run together in lower or upper case, in camel case, with numbers, as paths, with underscores or hyphens, and as a hex dump. Each
is scored at the beginning of each class of lengths, by the encoding that it has itself. Within an encoding and class of lengths a
candidate's p-value is the share of decoys that score as high, and the threshold is that of Benjamini and Hochberg over
all candidates of the cell, both from histograms with a bounded number of bins. Where names look as random as
random strings do (short runs of one letter case, digits alone), nothing is added.

Defined cases: a null text counts as empty; texts without white space are scanned in linear time; a text of many candidates is
judged in bounded batches; repeated rows get the same result each; an empty table gives no rows; with few decoys nothing is added; other
columns are ignored; doc_id must be a number.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored
from .spans import batch, digest, joined

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
ORDER = {k: i for i, k in enumerate(KINDS)}
LEAST = 20
#: The length classes begin here; decoys have these lengths.
LENGTHS = (20, 26, 32, 40, 64)
FALSE_RATE = 0.01
#: Scores are counted in bins of this width, from LOWEST to HIGHEST; characters that are scored at once.
BIN, LOWEST, HIGHEST, AT_ONCE = 0.05, -8.0, 3.0, 1 << 20

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_KEYWORDS = (b"passw", b"secret", b"token", b"key")


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UP, _LOW, _DEC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_RUN = _lut(_UP + _LOW + _DEC + "+/_=-")
_HEX = _lut("0123456789abcdef")
#: Encodings from the smallest alphabet on.
ENCODINGS = (_DEC, _DEC + "abcdef", _DEC + "ABCDEF", _LOW, _UP, _UP + "234567", _LOW + _DEC, _UP + _DEC, _UP + _LOW, _UP + _LOW + _DEC, _UP + _LOW + _DEC + "+/", _UP + _LOW + _DEC + "-_", _UP + _LOW + _DEC + "+/-_=")


#: Letters that words have most between others.
VOWELS = "aeiouyAEIOUY"
#: For each byte, the encodings that have it, as bits; each encoding's numbers of bytes, and which of them count as low in runs.
_HAS = np.zeros(256, np.int64)
_TABLES = []
for _i, _e in enumerate(ENCODINGS):
    _HAS[list(_e.encode())] |= 1 << _i
    _place, _low = np.zeros(256, np.int64), np.zeros(256, bool)
    _place[sorted(_e.encode())] = np.arange(len(_e))
    _words = len(set(_e) & set(_LOW)) == 26 or len(set(_e) & set(_UP)) == 26
    _low[list(VOWELS.encode()) if _words else sorted(_e.encode())[: len(_e) // 2]] = True
    _TABLES.append((len(_e), _place, _low))
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def _runs(mask: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """The maximal runs of True of at least that length."""
    stops = np.concatenate(([-1], np.flatnonzero(~mask), [len(mask)]))
    for i in np.flatnonzero(np.diff(stops) > least):
        yield int(stops[i]) + 1, int(stops[i + 1])


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _tail(z: np.ndarray) -> np.ndarray:
    return np.maximum(1e-300, 0.5 * _erfc(z / math.sqrt(2)).astype(float))


def encodings(x: np.ndarray) -> np.ndarray:
    """Of strings of one length, rows of bytes: each one's encoding with the smallest alphabet."""
    bits = np.bitwise_and.reduce(_HAS[x], axis=1)
    return np.log2(bits & -bits).astype(np.int64)


def scores(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings of one length, rows of bytes: their encodings and scores."""
    m, n = x.shape
    kind, out = encodings(x), np.full(m, LOWEST)
    if n < 8:
        return kind, out
    for e in np.unique(kind).tolist():
        at = np.flatnonzero(kind == e)
        k, place, low = _TABLES[e]
        code = place[x[at]]
        counts = np.bincount((np.arange(len(at))[:, None] * k + code).ravel(), minlength=len(at) * k).reshape(-1, k)
        chi = ((counts - n / k) ** 2).sum(1) * k / n
        d = k - 1
        p1 = _tail(((chi / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
        up = ~low[x[at]]
        a = up.sum(1).astype(float)
        ab = a * (n - a)
        runs = 1 + (up[:, 1:] != up[:, :-1]).sum(1)
        sd = np.sqrt(np.maximum(1e-9, 2 * ab * (2 * ab - n) / (n * n * (n - 1))))
        p2 = np.where(ab > 0, np.minimum(1.0, 2 * _tail(np.abs(runs - 1 - 2 * ab / n) / sd)), max(1e-12, 2.0 ** (1 - n)))
        y = code - code.mean(1, keepdims=True)
        var = (y * y).sum(1)
        r = np.abs((y[:, :-1] * y[:, 1:]).sum(1)) / np.maximum(var, 1e-12)
        p3 = np.where(var > 0, np.minimum(1.0, 2 * _tail(r * math.sqrt(n))), 1e-12)
        f = -(np.log(p1) + np.log(p2) + np.log(p3))  # half of Fisher's sum, chi-squared with 6 degrees
        out[at] = HIGHEST + np.log10(np.maximum(np.exp(-f) * (1 + f + f * f / 2), 1e-12))
    return kind, np.maximum(out, LOWEST)


def judged(found: list[bytes]) -> list[tuple[int, int]]:
    """Cell (encoding and class of lengths) and score bin of each string; a padding of = at its end doesn't count. Strings of one length are scored at once."""
    by: dict[int, list[int]] = defaultdict(list)
    bare = [s.rstrip(b"=") or s for s in found]
    for i, s in enumerate(bare):
        by[len(s)].append(i)
    out: list[tuple[int, int]] = [(0, 0)] * len(found)
    for n, all_at in by.items():
        step = max(1, AT_ONCE // n)
        for a in range(0, len(all_at), step):
            at = all_at[a : a + step]
            kind, score = scores(np.frombuffer(b"".join(bare[i] for i in at), np.uint8).reshape(len(at), n))
            for i, e, b in zip(at, kind.tolist(), score_bin(score).tolist(), strict=True):
                out[i] = (e * len(LENGTHS) + length_class(len(found[i])), b)
    return out


def randomness(s: str) -> float:
    """The score of one string."""
    return float(scores(np.frombuffer((s.rstrip("=") or s).encode(), np.uint8)[None])[1][0])


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def code_points(arr: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of bytes as spans of code points, counted in one pass over the bytes."""
    if not spans:
        return []
    ends = np.unique(np.array(spans).ravel())
    lead = (arr & 0xC0) != 0x80
    upto = np.cumsum(np.r_[np.count_nonzero(lead[: ends[0]]), [np.count_nonzero(lead[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]])
    place = dict(zip(ends.tolist(), upto.astype(int).tolist(), strict=True))
    return [(place[a], place[b]) for a, b in spans]


def base_spans(text: str, raw: bytes, hexes: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    out = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [("hex", a, b) for a, b in hexes]


_WORDS = re.compile(rb"[A-Za-z]+")
#: How decoys are made of words and a number: names in the ways that programs write them.
STYLES = ("lower", "upper", "camel", "lower_number", "upper_number", "camel_number", "base32", "path", "camel_path", "snake", "kebab_number", "mixed", "dump")


def named(words: list[bytes], number: int, style: str) -> bytes:
    """A name of some words and a number."""
    lower = [w.lower() for w in words]
    camel = [lower[0], *(w.capitalize() for w in lower[1:])]
    digits = str(number).encode()
    small = digits.translate(bytes.maketrans(b"0189", b"2345"))
    some = [w + (digits[:1] if i % 3 == 2 else b"") for i, w in enumerate(lower)]
    made = {
        "lower": lambda: b"".join(lower), "upper": lambda: b"".join(lower).upper(), "camel": lambda: b"".join(camel), "lower_number": lambda: digits[:2].join(lower), "upper_number": lambda: digits[:2].join(lower).upper(),
        "camel_number": lambda: b"".join(w + (digits[: 1 + i % 3] if i % 2 else b"") for i, w in enumerate(camel)), "base32": lambda: small[:2].join(lower).upper(), "path": lambda: b"/".join(some),
        "camel_path": lambda: b"/".join(w.capitalize() + (digits[:2] if i % 2 else b"") for i, w in enumerate(lower)), "snake": lambda: b"_".join(some), "kebab_number": lambda: b"-".join([*camel[:2], *some[2:]]),
        "mixed": lambda: b"".join(w + b"/_-+"[i % 4 : i % 4 + 1] for i, w in enumerate(some)), "dump": lambda: b" ".join(lower).hex().upper().encode(),
    }
    return made[style]()


def decoys(raw: bytes) -> list[bytes]:
    """Names of all words of a text: some consecutive words, of enough letters for the longest class, are a name, and styles take turns. Which
    style comes first, and the numbers, depend on the text. A name is no longer than the longest class asks for."""
    most, out, words, letters = LENGTHS[-1], [], [], 0
    h = zlib.crc32(raw)

    def made() -> bytes:
        i = h + len(out)
        return named(words, 10 + zlib.crc32(words[0], i & 0xFFFFFFFF) % 9990, STYLES[i % len(STYLES)])[:most]

    for w in _WORDS.findall(raw):
        if len(w) > 1:
            words.append(w[:most])
            letters += len(words[-1])
            if letters >= most:
                out.append(made())
                words, letters = [], 0
    if letters >= LENGTHS[0]:
        out.append(made())
    return out


def score_bin(score: np.ndarray) -> np.ndarray:
    return ((np.minimum(score, HIGHEST) - LOWEST) / BIN).astype(np.int64)


_SPAN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int32()), ("bin", pa.int32())]))
_CELLS = pa.list_(pa.struct([("cell", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))
_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base string, cands array<struct<a:long,b:long,cell:int,bin:int>>, decoys array<struct<cell:int,bin:int,n:long>>"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base", pa.string()), ("cands", _SPAN), ("decoys", _CELLS)])
_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def runs_of(text: str) -> tuple[list, list, list[bytes], bytes]:
    """Base spans, candidates' spans, their bytes, and the text's bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    arr = np.frombuffer(raw, np.uint8)
    hexes, runs = list(_runs(_HEX[arr], 16)), list(_runs(_RUN[arr], LEAST))
    runs = [(a, b) for a, b in runs if not (b - a == 36 and _UUID.fullmatch(text if len(text) == 36 else raw[a:b].decode()))]
    places = hexes + runs if len(raw) == len(text) else code_points(arr, hexes + runs)
    return base_spans(text, raw, places[: len(hexes)]), places[len(hexes) :], [raw[a:b] for a, b in runs], raw


def scan(text: str) -> tuple[list, list, list[bytes]]:
    """Base spans, candidates (start, end, cell, score bin) and the decoys of a text."""
    base, places, found, raw = runs_of(text)
    return base, [(*p, *j) for p, j in zip(places, judged(found), strict=True)], decoys(raw)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, found, made = [], [], []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            base, places, own, raw = runs_of(text or "")
            rows.append([doc_id, *(sum(s[0] == k for s in base) for k in BASE), joined(base, ORDER), places])
            found += own
            made += decoys(raw)
        of, k = judged(found), 0
        for r in rows:
            places = r[-1]
            r[-1] = [dict(zip(("a", "b", "cell", "bin"), (*p, *j), strict=True)) for p, j in zip(places, of[k : k + len(places)], strict=True)]
            k += len(places)
            r.append(None)
        # a batch's decoys are counted here, and go with its first row
        if rows:
            cells: dict[tuple, int] = defaultdict(int)
            for n in LENGTHS:
                for c in judged([d[:n] for d in made if len(d) >= n]):
                    cells[c] += 1
            rows[0][-1] = [dict(zip(("cell", "bin", "n"), (*c, n), strict=True)) for c, n in sorted(cells.items())]
        yield batch(_FOUND_ARROW, [tuple(r) for r in rows])


def thresholds(targets: dict[tuple[int, int], int], decoys: dict[tuple[int, int], int], rate: float = FALSE_RATE) -> list[int | None]:
    """By cell the lowest score bin that Benjamini and Hochberg's rule takes. Of counts by (cell, bin)."""
    out: list[int | None] = []
    for cell in range(len(ENCODINGS) * len(LENGTHS)):
        hit, null = ({b: v for (c, b), v in x.items() if c == cell} for x in (targets, decoys))
        n_t, n_d, above_t, above_d = sum(hit.values()), sum(null.values()), 0, 0
        best = None
        for b in range(max([-1, *hit, *null]), -1, -1):
            above_t += hit.get(b, 0)
            above_d += null.get(b, 0)
            if b in hit and (above_d + 1) / (n_d + 1) * n_t <= rate * above_t:
                best = b
        out.append(best)
    return out


def learned(found: DataFrame, rate: float = FALSE_RATE) -> list[int | None]:
    """The thresholds; the histograms have at most 13 encodings * 5 lengths * 221 bins each."""

    def count(df: DataFrame) -> dict[tuple[int, int], int]:
        return {(r["cell"], r["bin"]): r["n"] for r in df.groupBy("cell", "bin").agg(F.sum("n").alias("n")).collect()}

    cands = found.select(F.explode("cands").alias("c")).select("c.cell", "c.bin", F.lit(1).alias("n"))
    return thresholds(count(cands), count(found.select(F.explode("decoys").alias("c")).select("c.cell", "c.bin", "c.n")), rate)


def _decided(found: DataFrame, least: list[int | None]) -> DataFrame:
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                base = [(k, int(x), int(y)) for k, x, y in (s.split(":") for s in r["base"].split(",") if s)]
                spans = list(base)
                for c in r["cands"]:
                    if least[c["cell"]] is not None and c["bin"] >= least[c["cell"]] and not any(x < c["b"] and c["a"] < y for _, x, y in base):
                        spans.append(("random", c["a"], c["b"]))
                rows.append((r["doc_id"], *(r[f"n_{k}"] for k in BASE), digest(r["base"]), joined(spans, ORDER), len(spans) - len(base)))
            yield batch(_OUT_ARROW, rows)

    return found.mapInArrow(decide, _OUT)


def secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added for each document."""
    ship(documents.sparkSession)
    found = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, _FOUND), "secrets")
    return _decided(found, learned(found))
