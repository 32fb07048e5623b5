"""Vectors in blocks of rows that Python workers take as matrices, and sums over all blocks that reach the driver as a few rows.

A fit that goes through the same rows again and again packs them once and then runs one job for each pass: every
partition returns one row of sums, partitions are added up in groups before the driver gets them, so it gets FAN rows at most, and
fewer of long sums: SUM_BYTES, or one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..session import blas_threads, ship

#: Rows of a block; bytes of vectors that are worth a task; rows of sums that the driver takes at once.
ROWS, PART_BYTES, FAN = 4096, 4 << 20, 64
#: Bytes of sums that the driver takes at once, if a row of them isn't more.
SUM_BYTES = 2 << 20

_PACKED = pa.schema([("n", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("key", pa.binary())])
_SUMS = pa.schema([("part", pa.int64()), ("sums", pa.binary())])


class Packed:
    """Rows of a table as blocks: vectors x (n, width), numbers y (n, any) and keys, kept for several passes."""

    def __init__(self, df: DataFrame, vec: str, y: Column | None = None, key: Column | None = None) -> None:
        ship(df.sparkSession)
        self.numbers = 0
        y = y if y is not None else F.array().cast("array<double>")
        rows = df.select(doubles(F.col(vec)).alias("x"), y.cast("array<double>").alias("y"), (key if key is not None else F.lit(0)).cast("long").alias("key"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, ROWS):
                    s = b.slice(a, ROWS)
                    flat = [c.flatten().to_numpy(zero_copy_only=False).astype(float).tobytes() for c in (s.column(0), s.column(1))]
                    key = s.column(2).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                    yield pa.RecordBatch.from_pylist([{"n": s.num_rows, "x": flat[0], "y": flat[1], "key": key}], schema=_PACKED)

        self.blocks = rows.filter("x is not null").mapInArrow(pack, "n long, x binary, y binary, key binary").persist(StorageLevel.MEMORY_AND_DISK)
        found = self.blocks.agg(F.sum("n").alias("n"), F.sum(F.octet_length("x")).alias("bytes")).first()
        self.rows, size = found["n"] or 0, found["bytes"] or 0
        self.width = size // 8 // self.rows if self.rows else 0
        few = max(1, -(-size // PART_BYTES))
        if few < self.blocks.rdd.getNumPartitions():
            self.blocks, old = self.blocks.coalesce(few).persist(StorageLevel.MEMORY_AND_DISK), self.blocks
            self.blocks.count()
            old.unpersist()

    def __enter__(self) -> Packed:
        return self

    def __exit__(self, *_) -> None:
        self.blocks.unpersist()

    def summed(self, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of work(x, y, keys) over all blocks; it returns arrays of one shape, of so many `numbers`, where they are many."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blas_threads(1)  # a task has one core
            total = None
            for b in batches:
                for n, x, y, key in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    got = work(np.frombuffer(x).reshape(n, -1), np.frombuffer(y).reshape(n, -1), np.frombuffer(key, np.int64))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "sums": np.asarray(total, float).tobytes()}], schema=_SUMS)

        def add(t: pa.Table) -> pa.Table:
            rows = sorted(zip(t.column("part").to_pylist(), t.column("sums").to_pylist(), strict=True))
            return pa.Table.from_pylist([{"part": rows[0][0], "sums": sum(np.frombuffer(s) for _, s in rows).tobytes()}], schema=_SUMS)

        sums, parts = self.blocks.mapInArrow(each, "part long, sums binary"), self.blocks.rdd.getNumPartitions()
        fan = max(1, min(FAN, SUM_BYTES // max(1, 8 * self.numbers)))
        while parts > fan:
            parts = max(fan // 2, math.isqrt(parts), 1)
            sums = sums.groupBy(F.pmod("part", F.lit(parts)).alias("g")).applyInArrow(lambda t: add(t.drop_columns(["g"]) if "g" in t.column_names else t), "part long, sums binary")
        rows = sorted((r["part"], bytes(r["sums"])) for r in sums.collect())
        return np.sum([np.frombuffer(s) for _, s in rows], axis=0)
