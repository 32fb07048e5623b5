"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns by turns, ending with an assistant. Turns
are repaired at least cost: each is kept, relabelled, or merged into the turn before it, and empty turns may be
inserted before it or at the end. Dynamic programming over the automaton's four states finds the repair.

One turn is a 4 x 4 matrix of costs, and matrices multiply by (min, +), so conversations of any length are cut:
turns are range-partitioned and sorted, and cut into chunks of CHUNK turns. Each chunk gives one matrix for each
conversation in it; a pass over these few rows fixes the states at the chunks' borders; then each chunk is repaired and
rendered by itself. Nothing holds a whole conversation: a row is an input turn's piece of the rendered text,
and the pieces of a conversation in order are its rendering.

Defined cases: turns are ordered by turn, null first, then a hash of role and text; repeated rows are turns of their
own; a null text counts as empty; roles are trimmed and lower-cased, aliases are mapped, null and others are unknown
and cheap to relabel; a null conv_id is a conversation; an empty table gives no rows; other columns are ignored; very long
texts go whole, and a chunk is as large as its turns. Ties go to keeping, then merging, then relabelling; where a
conversation lies over several chunks, to the smaller state at their border, so of repairs that cost the same another may be
chosen if rows are partitioned otherwise. In texts "<|" is written "<\\|", so they can't forge a turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored
from .spans import batch

#: States: nothing yet, and after a turn of each role. Roles: the same numbers, 0 for unknown.
NAMES = ("", "system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "agent": "assistant", "developer": "system", "instruction": "system"}
MERGE, RELABEL, GUESS, INSERT = 1, 4, 1, 2
CHUNK = 4096
_INF = 1 << 40
#: Empty turns to insert between a state and a turn of a role; those not here can't follow.
BETWEEN = {(0, 1): (), (0, 2): (), (0, 3): (2,), (1, 2): (), (1, 3): (2,), (2, 3): (), (2, 2): (3,), (3, 2): (), (3, 3): (2,)}
AT_END = {1: (2, 3), 2: (3,), 3: ()}
KEEP, JOIN, CHANGE = 0, 1, 2


def moves(role: int) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, action) of a turn, best actions first."""
    new = lambda q: 0 if role == q else (RELABEL if role else GUESS)
    out = [(s, q, new(q) + INSERT * len(ins), KEEP if role == q else CHANGE) for (s, q), ins in BETWEEN.items()]
    out += [(s, s, MERGE + new(s), JOIN) for s in (1, 2, 3)]
    return sorted(out, key=lambda m: (m[0], m[1], m[2], m[3]))


MOVES = [moves(r) for r in range(4)]


def matrix(role: int) -> np.ndarray:
    m = np.full((4, 4), _INF, np.int64)
    for s, q, c, _ in MOVES[role]:
        m[s, q] = min(m[s, q], c)
    return m


MATRICES = [matrix(r) for r in range(4)]
END = np.array([_INF, *(INSERT * len(AT_END[s]) for s in (1, 2, 3))], np.int64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(1), _INF)


def repair(roles: list[int], entry: int, leave: int | None) -> list[tuple[int, int, int]]:
    """(state before, state after, action) of each turn on the cheapest way from entry to leave, or to the best end."""
    cost, back = [0 if s == entry else _INF for s in range(4)], []
    for r in roles:
        new, how = [_INF] * 4, [None] * 4
        for s, q, c, action in MOVES[r]:
            if cost[s] + c < new[q] or (cost[s] + c == new[q] < _INF and action < how[q][1]):
                new[q], how[q] = cost[s] + c, (s, action)
        cost = new
        back.append(how)
    q = leave if leave is not None else min((1, 2, 3), key=lambda s: (cost[s] + END[s], -s))
    out = []
    for how in reversed(back):
        s, action = how[q]
        out.append((s, q, action))
        q = s
    return out[::-1]


def _header(role: int) -> str:
    return f"<|{NAMES[role]}|>\n"


CLOSE = "<|end|>\n"


def piece(text: str | None, before: int, after: int, action: int, last: bool) -> tuple[str, int]:
    """The rendering of a turn and how many empty turns were inserted in it."""
    text = (text or "").replace("<|", "<\\|")
    if action == JOIN:
        out, n = f"\n\n{text}", 0
    else:
        ins = BETWEEN[before, after]
        out, n = (CLOSE if before else "") + "".join(_header(r) + CLOSE for r in ins) + _header(after) + text, len(ins)
    if last:
        end = AT_END[after]
        out += CLOSE + "".join(_header(r) + CLOSE for r in end)
        n += len(end)
    return out, n


def role_number(role: Column) -> Column:
    known = {n: i for i, n in enumerate(NAMES) if n} | {a: NAMES.index(n) for a, n in ALIASES.items()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(role))), F.lit(0))


def _numbered(chunk: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            pos = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((part << 32) + pos // chunk), pa.array((part << 40) + pos)], [*b.schema.names, "chunk", "at"])

    return number


def _segments(rows: pa.Table) -> pa.Table:
    """One matrix for each conversation of a chunk, and how many turns it is of."""
    rows = rows.sort_by("at")
    out, conv, m, n = [], object(), None, 0
    chunk = rows.column("chunk")[0].as_py()
    for c, r in zip(rows.column("conv_id").to_pylist(), rows.column("role").to_pylist(), strict=True):
        if c != conv or m is None:
            if m is not None:
                out.append((conv, chunk, m.reshape(-1).tolist(), n))
            conv, m, n = c, MATRICES[r], 1
        else:
            m, n = times(m, MATRICES[r]), n + 1
    out.append((conv, chunk, m.reshape(-1).tolist(), n))
    return pa.Table.from_batches([batch(_SEG_ARROW, out)])


_SEG = "conv_id long, chunk long, costs array<long>, n long"
_SEG_ARROW = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("costs", pa.list_(pa.int64())), ("n", pa.int64())])
_BORDER = "conv_id long, chunk long, enter int, leave int, before long"
_BORDER_ARROW = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("before", pa.int64())])


def _joined(conv, segs: list[tuple[int, list[int]]]) -> list[tuple]:
    """The states at the borders of a conversation's chunks; leave is null at its end."""
    ways, v = [], np.array([0, _INF, _INF, _INF], np.int64)
    for _, costs in segs:
        m = np.array(costs, np.int64).reshape(4, 4)
        ways.append((v, m))
        v = np.minimum((v[:, None] + m).min(0), _INF)
    q = min((1, 2, 3), key=lambda s: (v[s] + END[s], -s))
    out = []
    for (chunk, _), (v, m) in zip(reversed(segs), reversed(ways), strict=True):
        s = int((v + m[:, q]).argmin())
        out.append((conv, chunk, s, q if out else None))
        q = s
    return out


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, segs, before, turns, first = None, [], {}, 0, True
    for b in batches:
        out = []
        for c, chunk, costs, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if first or c != conv:
                out += [(*row, before[row[1]]) for row in _joined(conv, segs)] if segs else []
                conv, segs, before, turns, first = c, [], {}, 0, False
            segs.append((chunk, costs))
            before[chunk], turns = turns, turns + n
        yield batch(_BORDER_ARROW, out)
    if segs:
        yield batch(_BORDER_ARROW, [(*row, before[row[1]]) for row in _joined(conv, segs)])


_OUT = "conv_id long, turn long, at long, role string, action string, n_inserted int, piece string"
_OUT_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("n_inserted", pa.int32()), ("piece", pa.string())])
_ACTIONS = ("keep", "merge", "relabel")


def _rendered(turns: pa.Table, borders: pa.Table) -> pa.Table:
    rows = turns.sort_by("at").to_pylist()
    states = {b["conv_id"]: (b["enter"], b["leave"], b["before"]) for b in borders.to_pylist()}
    out, i = [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j]["conv_id"] == rows[i]["conv_id"]:
            j += 1
        enter, leave, before = states[rows[i]["conv_id"]]
        for k, (s, q, action) in enumerate(repair([r["role"] for r in rows[i:j]], enter, leave), i):
            text, n = piece(rows[k]["text"], s, q, action, leave is None and k == j - 1)
            out.append((rows[k]["conv_id"], rows[k]["turn"], before + k - i, NAMES[q], _ACTIONS[action], n, text))
        i = j
    return pa.Table.from_batches([batch(_OUT_ARROW, out)])


def formatted(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, turn, at, role, action, n_inserted, piece for each turn; `at` numbers the pieces of a conversation, from 0."""
    ship(conversations.sparkSession)
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role_number(F.col("role")).alias("role"), "text", F.xxhash64("role", "text").alias("h"))
    order = ["conv_id", "turn", "h"]
    c = c.repartitionByRange(*order).sortWithinPartitions(*order).drop("h")
    turns = stored(c.mapInArrow(_numbered(chunk), "conv_id long, turn long, role int, text string, chunk long, at long"), "turns")
    segments = turns.select("conv_id", "role", "chunk", "at").groupBy("chunk").applyInArrow(_segments, _SEG)
    borders = segments.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_borders, _BORDER)
    return turns.groupBy("chunk").cogroup(borders.groupBy("chunk")).applyInArrow(_rendered, _OUT)


def conversation_texts(pieces: DataFrame) -> DataFrame:
    """conv_id and its rendering in one string, for conversations that fit in a row."""
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "").alias("rendered"))
