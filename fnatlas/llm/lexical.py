"""Ranked lexical search: an inverted index in shards, each gone through a document at a time, and a global merge.

A shard holds a bounded number of bytes of texts, and is made where its texts are read: nothing is shuffled to index. Its
documents are numbered in the order of their ids; each term has one row with its postings, numbers by their steps and
term frequencies, as variable-length integers; one row more has the documents' ids and lengths.

A search looks up the items' terms only, adds up document frequencies, and meets each shard with each block of items. In
a shard, the cursors of an item's terms stand in a heap by the documents that come next; all that stand in the
same span of documents move on together, so a span's documents are complete at once and go to a bounded heap keyed by score,
then doc_id. The shards' best are merged by two bounded windows. All is exact, in 64-bit integers.

Defined cases: a null text or one without terms is no document (it isn't counted and never found); each row is a document,
so repeated rows are found each, with equal scores; a null doc_id comes after all others of the same score; rows of one item_id
are one item with the terms of all; an item without terms, or whose terms no document has, has no rows; very long
texts are indexed whole, and a shard then holds that one; empty tables give no rows; other columns are ignored.

Skew: a term of all documents has one row a shard, not one a document; rows of frequent terms are dealt to several tasks when
they are looked up, and an item's best are first merged in parts.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, drop_stored, ship, spread_join, stored
from .packed import binaries, coded, from_steps, read, steps

#: Bytes of texts in a shard, unless one text has more; documents in a span; terms in a block of items.
SHARD_BYTES, SPAN, BLOCK_TERMS = 16 << 20, 1024, 50_000
#: Bytes of a side up to which it is broadcast; they are always measured first.
BROADCAST_BYTES = 8 << 20
#: Tasks at most that go through cells.
CELL_TASKS = 4096
#: Documents for each item.
BEST = 50

#: Characters below 128 that aren't of a term become spaces, A-Z become a-z; all others are as they are.
_TABLE = bytes(c if c > 127 or re.match(rb"[a-z0-9]", bytes([c])) else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


_INDEX = "shard long, term string, df long, docs binary, tfs binary, ids array<long>, lens array<long>"
_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("docs", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64()))])
#: Terms whose rows make a batch.
_ROWS = 5000


class _Shard:
    """Documents as they come, and then their rows."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lens: list[int] = []
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        words = terms(text)
        if not words:
            return
        tf = Counter(words)
        number = self.number
        self.found.append(np.array([[number.setdefault(w, len(number)) for w in tf], [len(self.ids)] * len(tf), list(tf.values())], np.int64))
        self.ids.append(doc_id)
        self.lens.append(len(words))
        self.size += len(text)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, doc, tf = np.concatenate(self.found, axis=1)
        doc = place[doc]
        at = np.lexsort((doc, term))
        term, doc, tf = term[at], doc[at], tf[at]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        gaps = steps(doc)
        gaps[first] = doc[first]
        (docs, d_at), (tfs, t_at) = coded(gaps), coded(tf)
        stops = np.r_[first, len(term)]
        names = list(self.number)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "ids": [self.ids[i] for i in order], "lens": [self.lens[i] for i in order]}], schema=_INDEX_ARROW)
        for a in range(0, len(first), _ROWS):
            s = stops[a : a + _ROWS + 1]
            n = len(s) - 1
            d, t = d_at[s], t_at[s]
            none = pa.nulls(n, pa.list_(pa.int64()))
            cols = [pa.array(np.full(n, shard)), pa.array(names[a : a + n], pa.binary()).cast(pa.string()), pa.array(np.diff(s)), binaries(docs[d[0] : d[-1]], d - d[0]), binaries(tfs[t[0] : t[-1]], t - t[0]), none, none]
            yield pa.RecordBatch.from_arrays(cols, schema=_INDEX_ARROW)


def indexed(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of documents (doc_id, text), stored: shard, term, df, docs, tfs; where term is null, a shard's ids and lens."""
    ship(documents.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, shard = TaskContext.get().partitionId() << 32, _Shard()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    shard.add(doc_id, text)
                if shard.size >= shard_bytes:
                    yield from shard.rows(n)
                    n, shard = n + 1, _Shard()
        if shard.ids:
            yield from shard.rows(n)

    return stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, _INDEX), "index")


def best_of(cursors: list[tuple[np.ndarray, np.ndarray]], most: int) -> list[tuple[int, int]]:
    """(score, -document) of the highest sums of (documents, what they score), smaller documents first if equal; in no order."""
    heap = [(int(docs[0]) // SPAN, i, 0) for i, (docs, _) in enumerate(cursors)]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []
    total = np.zeros(SPAN, np.int64)
    while heap:
        span = heap[0][0]
        base = span * SPAN
        total[:] = 0
        while heap and heap[0][0] == span:
            _, i, a = heap[0]
            docs, scores = cursors[i]
            b = a + int(np.searchsorted(docs[a : a + SPAN], base + SPAN))
            total[docs[a:b] - base] += scores[a:b]
            if b < len(docs):
                heapq.heapreplace(heap, (int(docs[b]) // SPAN, i, b))
            else:
                heapq.heappop(heap)
        full = len(best) == most
        for d in np.flatnonzero(total > (best[0][0] if full else 0)).tolist():
            entry = (int(total[d]), -base - d)
            if len(best) < most:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return best


def _searched(n: int, total: int, most: int, out: pa.Schema):
    def search(cell: pa.Table) -> pa.Table:
        of: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        rows = cell.filter(pa.compute.is_valid(cell.column("ids")))
        if not len(rows):  # items of a block meet each shard that has documents
            return out.empty_table()
        ids = rows.column("ids")[0].values
        lens = rows.column("lens")[0].values.to_numpy()
        m = 50 + (50 * lens * n) // total
        for term, w, docs, tfs in zip(*(cell.column(c) for c in ("term", "w", "docs", "tfs")), strict=True):
            if term.is_valid:
                d, tf = from_steps(read(docs.as_buffer())), read(tfs.as_buffer()).astype(np.int64)
                of[term.as_py()] = d, w.as_py() * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[d]))
        items, docs, scores = [], [], []
        for item, words in zip(rows.column("items")[0].values.field("item_id"), rows.column("items")[0].values.field("terms"), strict=True):
            best = best_of([of[t] for t in words.as_py() if t in of], most)
            items += [item] * len(best)
            docs += [-d for _, d in best]
            scores += [s for s, _ in best]
        return pa.table([pa.array([i.as_py() for i in items], out.field("item_id").type), ids.take(pa.array(docs, pa.int64())), pa.array(scores, pa.int64())], schema=out)

    return search


def _bytes(df: DataFrame, text: str) -> tuple[int, int]:
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text) + 40), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def search(index: DataFrame, items: DataFrame, most: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each of items (item_id, text), the documents of the stored index with the highest scores."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = index.sparkSession
    ship(spark)
    kind = items.schema["item_id"].dataType
    words = pa.schema([("item_id", to_arrow_type(kind)), ("term", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, w.decode()) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in dict.fromkeys(terms(text))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(words)], schema=words)

    result = f"item_id {kind.simpleString()}, doc_id long, score long"
    item_terms = asked = stored(items.select("item_id", "text").mapInArrow(split, f"item_id {kind.simpleString()}, term string").distinct(), "item_terms")
    of_shards = index.filter("term is null").select("shard", "ids", "lens")
    sizes = of_shards.agg(F.count("*").alias("shards"), F.sum(F.size("lens")).alias("n"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")).first()
    n, total = sizes["n"] or 0, sizes["total"] or 0
    n_terms, n_bytes = _bytes(asked, "term")
    if not n or not n_terms:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    few = n_bytes <= BROADCAST_BYTES
    n_blocks = -(-n_terms // block_terms)
    # rows of an item are in one block; a block's items are one row, as large as block_terms and one item allow
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int"))
    blocks = stored(asked.groupBy("block", "item_id").agg(F.collect_list("term").alias("terms")).groupBy("block").agg(F.collect_list(F.struct("item_id", "terms")).alias("items")), "blocks")
    wanted = stored(asked.groupBy("term").agg(F.collect_set("block").alias("blocks")), "wanted")
    postings = index.filter("term is not null").select("shard", "term", "df", "docs", "tfs")
    found = postings.join(F.broadcast(wanted), "term") if few else spread_join(postings, wanted, "term", "shard")
    looked_up = found = stored(found, "postings")
    # a term's w from its rows of all shards, added up before the shuffle
    w = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.sum("df") + 1))).cast("long")
    weights = stored(found.groupBy("term").agg(w.alias("w")), "weights")
    found = found.join(F.broadcast(weights), "term") if few else spread_join(found, weights, "term", "shard")
    found = found.select("shard", F.explode("blocks").alias("block"), "term", "w", "docs", "tfs")
    cells = of_shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    cells = cells.join(F.broadcast(blocks), "block") if few else spread_join(cells, blocks, "block", "shard")
    cells = found.unionByName(cells, allowMissingColumns=True)
    out = pa.schema([("item_id", to_arrow_type(kind)), ("doc_id", pa.int64()), ("score", pa.int64())])
    # cells are work more than bytes: as many tasks as cells, up to a bound
    cells = cells.repartition(min(CELL_TASKS, sizes["shards"] * n_blocks), "shard", "block")
    best = cells.groupBy("shard", "block").applyInArrow(_searched(n, total, most, out), result)
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*by))).filter(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*by))).filter(F.col("rank") <= most)
    best = stored(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
    drop_stored(item_terms, blocks, wanted, looked_up, weights)
    return best


def ranked(documents: DataFrame, items: DataFrame, most: int = BEST) -> DataFrame:
    """search() over an index of documents that is made for it and goes afterwards."""
    index = indexed(documents)
    best = search(index, items, most)
    drop_stored(index)
    return best
