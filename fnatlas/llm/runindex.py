"""Exact removal of repeated passages by run-length indexes of the text that repeats.

A window is 100 bytes of one text; one is removed, with all its bytes, if the same bytes begin earlier: at a smaller doc_id, or in
the same document at an earlier start.

Which text to index. A window's anchor is its 32 bytes of smallest hash, so equal windows have equal anchors at equal places.
Consecutive windows with one anchor are a piece: its bytes cover them all. Windows can only be equal if their pieces have the same anchor,
so anchors deal out the work, and a text is some three pieces for each 100 bytes. Pieces of the same bytes are collapsed: at once
among the texts of a segment (a bounded number of bytes, read by one task), then in buckets of anchors; all but the earliest are
removed whole. What is left of an anchor that occurs once needs nothing more. All other pieces, which agree in part, are indexed.

The index. A cell holds the pieces of some anchors, a few MB. Their Burrows-Wheeler transform is kept as runs: a character,
a length, the text's places at the run's first and last row, and, for the first row, how long it agrees with the row before. That
is all that matching statistics need: streamed over the text, a place's neighbour in sorted order and the length of their match
follow from those of the place before, but where a run begins. Windows that match in 100 bytes or more are linked to their
neighbours, and of each set of linked windows all but the earliest are removed.

Defined cases: a null text counts as empty; a text under 100 bytes loses nothing; matches never cross documents; rows of one
doc_id are versions of one document (only a smaller start is earlier among them; so rows that are equal in doc_id and text
remove nothing of each other and have the same result); a null doc_id comes after all others; very long texts are
cut into overlapping parts, and their anchors don't depend on the cut; the bytes may be any; an empty table gives no
rows; other columns are ignored; doc_id must be a number.

Skew: a passage of many documents is one row for each segment. An anchor with many different pieces (a frequent line that is shorter than a
window) isn't indexed but dealt out by its windows, whose digests are grouped over all tasks; anchors that would already fill a bucket are
found by counts before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, drop_stored, ship, small, spread_join, stored
from .packed import binaries, coded, from_steps, read, steps
from .spans import batch

WINDOW, ANCHOR = 100, 32
#: Bytes of text of a segment, of a bucket and of a cell; bytes that are gone through at once.
SEGMENT_BYTES, BUCKET_BYTES, CELL_BYTES, CHUNK = 16 << 20, 16 << 20, 7 << 18, 1 << 20
#: Different pieces of an anchor beyond which its windows are dealt out.
HOT = 50_000
#: Pieces of an anchor in a segment from which they are counted over all segments, and the count from which they skip the buckets.
LOCAL_HOT, VERY_HOT = 64, 1_000_000

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_PLACE = (1 << 24) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def words8(raw: bytes, order: str) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    n = len(raw) - 7
    out = np.empty(n, np.uint64)
    for j in range(min(8, n)):
        out[j::8] = np.frombuffer(raw, f"{order}u8", (n - j + 7) // 8, j)
    return out


def pieces(raw: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one after the other, between the cuts: where each piece begins, its windows, its anchor's hash."""
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    x = words8(raw, "<")
    m = len(raw) - ANCHOR + 1
    h = _mixed(reduce(np.add, (x[8 * i : 8 * i + m] * _ODD[i] for i in range(4))))
    least = (h & ~_U(_PLACE)) | np.arange(m, dtype=np.uint64)
    w, size = WINDOW - ANCHOR + 1, 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[w - size :][:n])
    at = (least & _U(_PLACE)).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    begins, ends = cuts[:-1], cuts[1:] - WINDOW + 1
    whole = ends > begins
    np.add.at(inside, begins[whole], 1)
    np.add.at(inside, ends[whole], -1)
    inside = np.cumsum(inside)[:n] > 0
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    new[begins[whole]] = True  # texts that touch
    start = np.flatnonzero(new)
    stops = np.r_[np.flatnonzero(new | ~inside), n]
    return start, stops[np.searchsorted(stops, start, "right")] - start, h[at[start]]


def merged(who: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in the order of who and start, with those that touch made one; ends rise with starts."""
    if not len(who):
        return who, start, end
    new = np.r_[True, (who[1:] != who[:-1]) | (start[1:] > end[:-1])]
    return who[new], start[new], end[np.r_[np.flatnonzero(new)[1:], len(who)] - 1]


def pairs_by_row(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The first index of each run of equal rows, and the runs' pairs (a, b) as bytes."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    data, at = coded(np.stack([a, b], axis=1).ravel())
    return first, binaries(data, at[2 * np.r_[first, len(row)]])


def pairs(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all rows, and how many each row has."""
    data = b"".join(rows)
    n = np.cumsum(np.r_[0, np.frombuffer(data, np.uint8) < 128])[np.cumsum([0, *map(len, rows)])]
    return read(data).astype(np.int64).reshape(-1, 2), np.diff(n) // 2


# ---- segments: pieces of texts, collapsed among a task's texts

_SEGMENT = "bucket int, key binary, dig binary, doc binary, nul binary, ver binary, pos binary, win binary, is_null boolean, doc_id long, version long, spans binary, heavy array<struct<key:long,n:long>>"
_BYTES = pa.binary()
_HEAVY = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))
_SEGMENT_ARROW = pa.schema(
    [("bucket", pa.int32()), *((c, _BYTES) for c in ("key", "dig", "doc", "nul", "ver", "pos", "win")), ("is_null", pa.bool_()), ("doc_id", pa.int64()), ("version", pa.int64()), ("spans", _BYTES), ("heavy", _HEAVY)]
)


def _padded(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SEGMENT_ARROW], schema=_SEGMENT_ARROW)


def _chunks(raws: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of bounded size: their bytes, cuts, and of each part its text and its offset in it."""
    parts, size = [], 0
    for i, raw in enumerate(raws):
        for a in range(0, max(1, len(raw) - WINDOW + 1), CHUNK):
            part = raw[a : a + CHUNK + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            if size + len(part) > CHUNK and parts:
                yield b"".join(p for p, _, _ in parts), np.cumsum([0, *(len(p) for p, _, _ in parts)]), np.array([d for _, d, _ in parts]), np.array([o for _, _, o in parts])
                parts, size = [], 0
            parts.append((part, i, a))
            size += len(part)
    if parts:
        yield b"".join(p for p, _, _ in parts), np.cumsum([0, *(len(p) for p, _, _ in parts)]), np.array([d for _, d, _ in parts]), np.array([o for _, _, o in parts])


def segment_rows(texts: list[tuple[bool, int, int, bytes]], buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of some texts (is_null, doc_id, version, bytes): collapsed pieces by bucket, removed spans, counts of hot anchors."""
    texts = sorted({t[:3]: t for t in texts}.values())
    found = []
    for raw, cuts, doc, offset in _chunks([t[3] for t in texts]):
        start, win, key = pieces(raw, cuts)
        part = np.searchsorted(cuts, start, "right") - 1
        dig = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + win + WINDOW - 1).tolist(), strict=True)), np.uint64, len(start))
        found.append((doc[part], start - cuts[part] + offset[part], win, key, dig))
    if not found:
        return
    row, pos, win, key, dig = (np.concatenate(x) for x in zip(*found, strict=True))
    nul, ids, ver = (np.array([t[i] for t in texts], d) for i, d in enumerate((bool, np.int64, np.int64)))
    value = np.cumsum(np.r_[0, (nul[1:] != nul[:-1]) | (ids[1:] != ids[:-1])])[row]  # versions of a document share it
    order = np.lexsort((pos, value, dig)) if ver.any() else np.argsort(dig, kind="stable")
    head = np.r_[True, dig[order][1:] != dig[order][:-1]]
    first = np.empty(len(order), np.int64)
    first[order] = order[head][np.cumsum(head) - 1]
    again = (value != value[first]) | (pos != pos[first])
    who, a, b = merged(row[again], pos[again], (pos + win + WINDOW - 1)[again])
    at, spans = pairs_by_row(who, a, b)
    if len(at):
        d = who[at]
        yield _padded(len(at), is_null=pa.array(nul[d]), doc_id=pa.array(ids[d]), version=pa.array(ver[d]), spans=spans)
    keep = np.flatnonzero(~again)
    hot, n = np.unique(key[keep], return_counts=True)
    if (n >= LOCAL_HOT).any():
        yield _padded(1, heavy=pa.array([[{"key": k, "n": c} for k, c in zip(hot[n >= LOCAL_HOT].view(np.int64).tolist(), n[n >= LOCAL_HOT].tolist(), strict=True)]], _HEAVY))
    bucket = ((key[keep] >> _U(32)) % _U(buckets)).astype(np.int32)
    keep = keep[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    cols: dict[str, list] = {c: [] for c in ("key", "dig", "doc", "nul", "ver", "pos", "win")}
    for s in np.split(keep, first[1:]):
        d = row[s]
        cols["key"].append((key[s] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes())
        cols["dig"].append(dig[s].tobytes())
        cols["doc"].append(coded(steps(ids[d]))[0].tobytes())
        cols["nul"].append(nul[d].tobytes() if nul[d].any() else None)
        cols["ver"].append(ver[d].tobytes() if ver[d].any() else None)
        cols["pos"].append(coded(pos[s])[0].tobytes())
        cols["win"].append(win[s].astype(np.uint8).tobytes())
    yield _padded(len(first), bucket=pa.array(bucket[first]), **{k: pa.array(v, _BYTES) for k, v in cols.items()})


# ---- buckets: which pieces are alike, and which must be indexed

_FOUND = "is_null boolean, doc_id long, version long, cell long, spans binary"
_FOUND_ARROW = pa.schema([("is_null", pa.bool_()), ("doc_id", pa.int64()), ("version", pa.int64()), ("cell", pa.int64()), ("spans", _BYTES)])


@dataclass
class _Rows:
    """Pieces of a bucket's rows."""

    key: np.ndarray
    dig: np.ndarray
    nul: np.ndarray
    doc: np.ndarray
    ver: np.ndarray
    pos: np.ndarray
    win: np.ndarray

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch) -> _Rows:
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for key, dig, doc, nul, ver, pos, win in zip(*(table.column(c).to_pylist() for c in ("key", "dig", "doc", "nul", "ver", "pos", "win")), strict=True):
            n = len(win)
            got = np.frombuffer(key, np.uint32), np.frombuffer(dig, np.uint64), np.frombuffer(nul, bool) if nul else np.zeros(n, bool), from_steps(read(doc)), np.frombuffer(ver, np.int64) if ver else np.zeros(n, np.int64), read(pos).astype(np.int64), np.frombuffer(win, np.uint8).astype(np.int64)
            for a, b in zip(out, got, strict=True):
                a.append(b)
        return _Rows(*(np.concatenate(x) for x in out))

    def taken(self, at: np.ndarray) -> _Rows:
        return _Rows(*(getattr(self, f)[at] for f in self.__dataclass_fields__))


def _found(r: _Rows, cell: np.ndarray | None) -> pa.Table:
    """Rows by cell and document. Without cells the pieces are spans to remove; with cells they are places and windows, -1 for hot ones."""
    order = np.lexsort((r.pos, r.ver, r.doc, r.nul, *([] if cell is None else [cell])))
    r = r.taken(order)
    c = np.zeros(len(order), np.int64) if cell is None else cell[order]
    change = (c[1:] != c[:-1]) | (r.nul[1:] != r.nul[:-1]) | (r.doc[1:] != r.doc[:-1]) | (r.ver[1:] != r.ver[:-1])
    row = np.cumsum(np.r_[0, change]) if len(order) else np.empty(0, np.int64)
    if cell is None:
        who, a, b = merged(row, r.pos, r.pos + r.win + WINDOW - 1)
        at, spans = pairs_by_row(who, a, b)
        at = np.flatnonzero(np.r_[True, change]) if len(order) else at
    else:
        at, spans = pairs_by_row(row, r.pos, r.win)
    cells = pa.nulls(len(at), pa.int64()) if cell is None else pa.array(c[at])
    return pa.table([pa.array(r.nul[at]), pa.array(r.doc[at]), pa.array(r.ver[at]), cells, spans], schema=_FOUND_ARROW)


def decided(bucket: pa.Table) -> pa.Table:
    """Of a bucket's pieces: those that an earlier one equals, and those to index, by cells."""
    r = _Rows.of(bucket)
    r = r.taken(np.lexsort((r.pos, r.doc, r.nul, r.dig, r.key)))
    n = len(r.key)
    new_key = np.r_[True, r.key[1:] != r.key[:-1]]
    head = new_key | np.r_[True, r.dig[1:] != r.dig[:-1]]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    again = (r.pos != r.pos[first]) | (r.doc != r.doc[first]) | (r.nul != r.nul[first])
    key = np.cumsum(new_key) - 1
    different = np.bincount(key, head)[key]
    rest = np.flatnonzero(~again & (different > 1))
    size = r.win[rest] + WINDOW
    before = np.cumsum(size) - size
    k = key[rest]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(rest) else rest
    cell = (before[at] // CELL_BYTES)[np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1] if len(rest) else rest
    cell = np.where(different[rest] > HOT, -1, bucket.column("bucket")[0].as_py() * (1 << 24) + cell)
    assert n == 0 or len(again) == n
    return pa.concat_tables([_found(r.taken(np.flatnonzero(again)), None), _found(r.taken(rest), cell)])


def _without(keys: np.ndarray, bucket_of: np.ndarray, hot: bool) -> Callable:
    """Bucket rows without the pieces of anchors that are very hot, or only these, as pieces of cell -1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                r = _Rows.of(one)
                is_hot = np.isin(r.key, keys[bucket_of == one.column("bucket")[0].as_py()])
                if hot:
                    at = np.flatnonzero(is_hot)
                    yield from _found(r.taken(at), np.full(len(at), -1, np.int64)).to_batches()
                elif not is_hot.any():
                    yield one
                elif not is_hot.all():
                    s = r.taken(np.flatnonzero(~is_hot))
                    cols = {"key": s.key.tobytes(), "dig": s.dig.tobytes(), "doc": coded(steps(s.doc))[0].tobytes(), "nul": s.nul.tobytes(), "ver": s.ver.tobytes(), "pos": coded(s.pos)[0].tobytes(), "win": s.win.astype(np.uint8).tobytes()}
                    yield pa.RecordBatch.from_arrays([one.column("bucket"), *(pa.array([cols[c]], _BYTES) for c in one.schema.names[1:])], schema=one.schema)

    return work


# ---- the run-length index of a cell


@dataclass
class RunIndex:
    """The runs of a Burrows-Wheeler transform, in sorted order."""

    char: np.ndarray
    length: np.ndarray
    #: The text's place that a run's first and last row begin at.
    first: np.ndarray
    last: np.ndarray
    #: How many bytes a run's first row has in common with the row before it.
    common: np.ndarray


def _remaining(n: int, ends: np.ndarray) -> np.ndarray:
    """How many bytes of its text stand at and after each place; 0 at the byte that ends a text."""
    size = np.diff(np.r_[-1, ends])
    return (np.repeat(ends, size) - np.arange(n)).astype(np.int32)


def sorted_suffixes(word: np.ndarray, rem: np.ndarray) -> np.ndarray:
    """The places of all suffixes of texts, sorted; equal ones in the order of the text. word: eight bytes, none beyond a text's end.

    Ranks by 5, 10, 20 bytes and so on; only places whose rank others share are sorted again. Numbers that hold a key and a place
    sort several times faster than keys alone whose order is asked for.
    """
    n = len(rem)
    bits = n.bit_length()
    sa = np.flatnonzero(rem > 0).astype(np.int32)
    h, low = 5, _U((1 << 24) - 1)
    w = (word[sa] & ~low) | (np.minimum(rem[sa], h).astype(np.uint64) << _U(21))  # a byte 0 isn't the end
    if bits <= 21:
        w = np.sort(w | np.arange(len(sa), dtype=np.uint64))
        sa = sa[(w & _U((1 << 21) - 1)).astype(np.int64)]
        w >>= _U(21)
    else:
        order = np.argsort(w)
        sa, w = sa[order], w[order]
    head = np.r_[True, w[1:] != w[:-1]]
    # a rank is the first row of those that share it, from 1
    rank = np.zeros(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(1, len(sa) + 1), 0))
    rows = np.flatnonzero(~(head & np.r_[head[1:], True]))
    longest = int(rem.max(initial=0))
    while len(rows) and h < longest:
        m = sa[rows]
        after = np.where(rem[m] > h, rank[np.minimum(m + h, n - 1)], 0)
        key = (rank[m].astype(np.int64) << bits) | after
        if 3 * bits <= 63:
            key = np.sort((key << bits) | np.arange(len(m)))
            m = m[key & ((1 << bits) - 1)]
            key >>= bits
        else:
            order = np.argsort(key)
            m, key = m[order], key[order]
        head = np.r_[True, key[1:] != key[:-1]]
        sa[rows] = m
        rank[m] = np.maximum.accumulate(np.where(head, rows + 1, 0))
        rows = rows[~(head & np.r_[head[1:], True])]
        h *= 2
    m = sa[rows]
    sa[rows] = (np.sort((rank[m].astype(np.int64) << bits) | m) & ((1 << bits) - 1)).astype(np.int32)
    return sa


def common_bytes(p: np.ndarray, q: np.ndarray, word: np.ndarray, rem: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at p and q have in common."""
    most = np.minimum(rem[p], rem[q])
    out = np.zeros(len(p), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = word[p[live] + out[live]] ^ word[q[live] + out[live]]
        same = x == 0
        other = x[~same]
        # leading bytes of zeros, by the place of the highest one
        n = np.zeros(len(other), np.int64)
        for k in range(1, 8):
            n += other < _U(1 << (64 - 8 * k))
        out[live[~same]] += n
        live = live[same]
        out[live] += 8
        live = live[out[live] < most[live]]
    return np.minimum(out, most)


def run_index(text: bytes, ends: np.ndarray) -> tuple[RunIndex, np.ndarray]:
    """The index of texts that stand one after the other, each with one byte after it (at ends); and the remaining bytes of each place."""
    rem = _remaining(len(text), ends)
    word = words8(text + bytes(7), ">")
    short = rem < 8
    word[short] &= ~((~_U(0)) >> (_U(8) * rem[short].astype(np.uint64)))
    sa = sorted_suffixes(word, rem)
    t = np.frombuffer(text, np.uint8)
    begin = np.zeros(len(text), bool)
    begin[np.r_[0, ends[:-1] + 1]] = True
    char = np.where(begin[sa], np.int16(256), t[sa - 1])
    head = np.r_[True, (char[1:] != char[:-1]) | (char[1:] == 256)]
    at = np.flatnonzero(head)
    stop = np.r_[at[1:], len(sa)]
    first, last = sa[at], sa[stop - 1]
    common = np.zeros(len(at), np.int64)
    common[1:] = common_bytes(first[1:], last[:-1], word, rem)
    return RunIndex(char[at], stop - at, first, last, common), rem


def matching_statistics(index: RunIndex, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the text, the place that is before it in sorted order and how many bytes they have in common."""
    run = np.full(n, -1, np.int64)
    run[index.first] = np.arange(len(index.first))
    begins = np.maximum.accumulate(np.where(run >= 0, np.arange(n), 0))
    run, step = run[begins], np.arange(n) - begins
    before = np.r_[index.first[:1], index.last[:-1]]
    return before[run] + step, index.common[run] - step


def repeated_windows(text: bytes, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the window at each place also begins at a place of smaller value. value: of each place, by which windows are earlier."""
    index, rem = run_index(text, ends)
    before, common = matching_statistics(index, len(text))
    place = np.arange(len(text))
    linked = (common >= WINDOW) & (rem >= WINDOW)
    top = np.where(linked, before, place)
    while True:
        up = top[top]
        if np.array_equal(up, top):
            break
        top = up
    least = value.copy()
    members = np.flatnonzero(linked)
    np.minimum.at(least, top[members], value[members])
    out = np.zeros(len(text), bool)
    full = rem >= WINDOW
    out[full] = value[full] > least[top[full]]
    return out


_PIECES = "cell long, is_null boolean, doc_id long, version long, spans binary, data binary, hot binary, pos long"
_PIECES_ARROW = pa.schema([("cell", pa.int64()), ("is_null", pa.bool_()), ("doc_id", pa.int64()), ("version", pa.int64()), ("spans", _BYTES), ("data", _BYTES), ("hot", _BYTES), ("pos", pa.int64())])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of a document's pieces, by cell; of hot pieces a digest of each window."""
    for b in batches:
        rows = []
        given = b.column("cells").to_pylist()
        found, n = pairs([c["spans"] for cells in given for c in cells])
        found, stop, k = found.tolist(), np.cumsum(n).tolist(), 0
        for is_null, doc_id, version, text, cells in zip(*(b.column(c).to_pylist() for c in ("is_null", "doc_id", "version", "text")), given, strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for c in cells:
                at = found[stop[k - 1] if k else 0 : stop[k]]
                k += 1
                if c["cell"] >= 0:
                    rows.append((c["cell"], is_null, doc_id, version, c["spans"], b"".join(raw[p : p + n + WINDOW - 1] for p, n in at), None, None))
                else:
                    rows += [(-1, is_null, doc_id, version, None, None, hashlib.blake2b(raw[i : i + WINDOW], digest_size=16).digest(), i) for p, n in at for i in range(p, p + n)]
                if len(rows) >= 20_000:
                    yield batch(_PIECES_ARROW, rows)
                    rows = []
        yield batch(_PIECES_ARROW, rows)


def indexed(cell: pa.Table) -> pa.Table:
    """The spans of a cell's pieces that are removed."""
    nul, doc, ver = (cell.column(c).to_numpy() for c in ("is_null", "doc_id", "version"))
    both, n = pairs(cell.column("spans").to_pylist())
    row = np.repeat(np.arange(len(n)), n)
    pos, win = both.T
    size = win + WINDOW - 1
    data = cell.column("data").to_pylist()
    parts, k = [], 0
    sizes = size.tolist()
    for raw, x in zip(data, n.tolist(), strict=True):
        a = 0
        for z in sizes[k : k + x]:
            parts.append(raw[a : a + z])
            a += z
        k += x
    text = b"\xff".join(parts) + b"\xff"
    ends = np.cumsum(size + 1) - 1
    order = np.lexsort((doc, nul))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.r_[0, (doc[order][1:] != doc[order][:-1]) | (nul[order][1:] != nul[order][:-1])])
    piece = np.repeat(np.arange(len(pos)), size + 1)
    offset = np.arange(len(text)) - np.repeat(ends - size, size + 1)
    start = pos[piece] + offset
    gone = np.flatnonzero(repeated_windows(text, ends, (rank[row[piece]] << 32) | start))
    # a run of windows of a piece is a span; spans of a row in order
    who, a = row[piece[gone]], start[gone]
    by = np.lexsort((a, who))
    who, a = who[by], a[by]
    who, a, b = merged(who, a, a + WINDOW)
    at, spans = pairs_by_row(who, a, b)
    d = who[at]
    return pa.table([pa.array(nul[d]), pa.array(doc[d]), pa.array(ver[d]), pa.nulls(len(at), pa.int64()), spans], schema=_FOUND_ARROW)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for is_null, doc_id, version, places in zip(*(b.column(c).to_pylist() for c in ("is_null", "doc_id", "version", "places")), strict=True):
            a = np.unique(np.array(places, np.int64))
            _, a, e = merged(np.zeros(len(a), np.int64), a, a + WINDOW)
            rows.append((is_null, doc_id, version, None, coded(np.stack([a, e], axis=1).ravel())[0].tobytes()))
        yield batch(_FOUND_ARROW, rows)


# ---- documents

KEY = ["is_null", "doc_id", "version"]
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(raw: bytes, spans: list[list[int]]) -> tuple[list[list[int]], bytes]:
    """The maximal removed runs of a text, of any spans, and the remaining bytes."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return runs, b"".join([*kept, raw[at:]])


def _keyed(documents: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id and text with the keys of a row: is_null, doc_id and, where ids repeat or are null, version; whether some ids repeat."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = stored(d.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("twice")), "twice")
    n = twice.count()
    d = (d.join(F.broadcast(twice), "doc_id", "left") if n <= 100_000 else spread_join(d, twice, "doc_id", "text", "left")) if n else d.withColumn("twice", F.lit(None).cast("boolean"))
    version = F.when(F.col("twice") | F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long"))
    return d.select(F.col("doc_id").isNull().alias("is_null"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), version.alias("version"), F.coalesce("text", F.lit("")).alias("text")), bool(n)


def _hot_spans(hot: DataFrame) -> DataFrame:
    """The removed spans of hot windows (hot, pos and keys): all but each window's earliest."""
    at: Column = F.struct("is_null", "doc_id", "pos")
    least = stored(hot.groupBy("hot").agg(F.min(at).alias("least"), F.count("*").alias("n")).filter("n > 1").select("hot", "least"), "least")
    again = spread_join(hot.withColumn("by", F.xxhash64(*KEY)), least, "hot", "by").filter(at > F.col("least"))
    return again.groupBy(*KEY).agg(F.collect_list("pos").alias("places")).mapInArrow(_windows, _FOUND)


def repeats(documents: DataFrame, segment_bytes: int | None = None) -> DataFrame:
    """is_null, doc_id (0 if null), version and spans: of documents (doc_id, text), lists of spans that are removed, stored."""
    spark = documents.sparkSession
    ship(spark)
    docs, some_repeat = _keyed(documents)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets, limit = max(1, -(-total // BUCKET_BYTES)), segment_bytes or SEGMENT_BYTES

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for b in batches:
            for is_null, doc_id, version, text in zip(*(b.column(c).to_pylist() for c in (*KEY, "text")), strict=True):
                if len(text) * 4 < WINDOW:
                    continue
                texts.append((is_null, doc_id, version, text.encode("utf-8", "surrogatepass")))
                size += len(texts[-1][3])
                if size >= limit:
                    yield from segment_rows(texts, buckets)
                    texts, size = [], 0
        yield from segment_rows(texts, buckets)

    made = stored(docs.filter(F.octet_length("text") >= WINDOW).mapInArrow(segments, _SEGMENT), "segments")
    blobs = made.filter("bucket is not null").select("bucket", "key", "dig", "doc", "nul", "ver", "pos", "win")
    local = made.filter("spans is not null").select(*KEY, F.lit(None).cast("long").alias("cell"), "spans")
    # counts add up to no more than all pieces, so the anchors beyond that share of them are at most 10,000
    beyond = max(VERY_HOT, total // ANCHOR // 10_000)
    very = made.filter("heavy is not null").select(F.explode("heavy").alias("h")).groupBy("h.key").agg(F.sum("h.n").alias("n")).filter(F.col("n") >= beyond)
    hot_keys = np.array([r["key"] for r in very.select("key").collect()], np.int64).view(np.uint64)
    if len(hot_keys):
        own, key32 = ((hot_keys >> _U(32)) % _U(buckets)).astype(np.int32), (hot_keys & _U(0xFFFFFFFF)).astype(np.uint32)
        local = local.unionByName(blobs.mapInArrow(_without(key32, own, True), _FOUND))
        blobs = blobs.mapInArrow(_without(key32, own, False), blobs.schema)
    found = stored(blobs.groupBy("bucket").applyInArrow(decided, _FOUND).unionByName(local), "found")
    drop_stored(made)
    rest = found.filter("cell is not null").groupBy(*KEY).agg(F.collect_list(F.struct("cell", "spans")).alias("cells"))
    texts = docs.dropDuplicates(KEY) if some_repeat else docs
    ids = stored(rest.select(*KEY).distinct(), "rest_ids")
    texts = texts.join(small(ids, ids.count()), KEY, "left_semi")
    parts = stored(texts.join(rest, KEY).mapInArrow(_fetched, _PIECES), "pieces")
    cells = parts.filter("cell >= 0").select("cell", *KEY, "spans", "data").groupBy("cell").applyInArrow(indexed, _FOUND)
    spans = found.filter("cell is null").unionByName(cells).unionByName(_hot_spans(parts.filter("cell < 0").select("hot", "pos", *KEY)))
    out = stored(spans.select(*KEY, "spans"), "spans")
    drop_stored(found, ids, parts)
    return out


def without_repeats(documents: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document, and with texts also kept: the remaining bytes."""
    docs, _ = _keyed(documents)
    spans = repeats(documents).groupBy(*KEY).agg(F.collect_list("spans").alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", _BYTES)] if texts else [])])
        for b in batches:
            rows, lists = [], [x or [] for x in b.column("spans").to_pylist()]
            both, n = pairs([s for x in lists for s in x])
            both, stop, k = both.tolist(), np.cumsum(np.r_[0, n]).tolist(), 0
            for is_null, doc_id, text, x in zip(*(b.column(c).to_pylist() for c in ("is_null", "doc_id", "text")), lists, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                runs, kept = removed(raw, both[stop[k] : stop[k + len(x)]])
                k += len(x)
                rows.append((None if is_null else doc_id, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            yield batch(out, rows)

    return docs.join(spans, KEY, "left").mapInArrow(finish, _OUT + ", kept binary" * texts)

