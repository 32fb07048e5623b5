"""Text spans as rows of Python: (start, end) in code points, their digest, and Arrow batches."""

from __future__ import annotations

import hashlib

import pyarrow as pa


def joined(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind as ordered, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def masked(text: str | None, spans: str) -> str | None:
    """text with each span replaced by its kind in angle brackets; of spans that overlap, the first and longest."""
    if text is None or not spans:
        return text
    got = sorted(((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))), key=lambda s: s[:2])
    out, at = [], 0
    for a, b, k in got:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
            at = -b
    return "".join(out) + text[at:]
