"""Token ids in sorted-string-table shards.

File: data blocks, block index, Bloom filter, footer. A block is zstd-compressed and followed by its crc32; its
entries are (varint shared, varint rest, varint value bytes, rest of the key, value), where `shared` is the length of
the prefix that the key has in common with the key before it. A key is one byte (0: null, 1: a number) and the
document id as a big-endian number that sorts like the id. A value is the ids, 2 or 4 bytes each. The index has
each block's last key, offset and length; readers search it by bisection, after the Bloom filter. The footer, of
fixed size at the file's end, gives places, counts and a magic number.

Rows are range-partitioned and sorted by document id; each partition streams its shards to the shared folder, cuts
them at SHARD_BYTES, and returns a manifest row for each. A file's name is its attempt's own, so a task that runs
twice leaves an unnamed file and no half-read one. Where a vocabulary cuts texts as CUTTING says, white space never joins
tokens, so a chunk between ASCII white space is encoded once and remembered, about 2 * CHUNKS_KEPT chunks at most.
With another vocabulary whole texts go through the tokenizer.

Defined cases: a null text has the end id only; a null doc_id sorts first; repeated rows are entries of their own, next
to each other; very long texts are values of their own length in one block; an empty table writes no shard and gives no
rows; other columns are ignored, whatever their names; doc_id must be a number.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, ship, stored
from .spans import batch

END_ID = 1
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
#: With a batch's new chunks a generation stays under 349,525, beyond which Python's table of it takes twice the memory.
CHUNKS_KEPT = 300_000
#: Of texts that a task's Python worker and the JVM beside it hold at once.
TEXT_BYTES = 2 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"FNSST001"
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_ASCII = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")
#: Characters that stand for bytes in byte-level models: printable ones for themselves, the others from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: How a tokenizer has to normalise and cut texts so that chunks can be encoded by themselves, in the library's own terms.
CUTTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_FOOTER = struct.Struct("<QQQQQQB7x8s")
_BIAS = 1 << 63


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + _BIAS).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - _BIAS


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bits(key: bytes, size: int) -> Iterator[int]:
    import xxhash

    d = xxhash.xxh128_intdigest(key)
    a, b = d & (1 << 64) - 1, d >> 64 | 1
    return ((a + i * b) % size for i in range(BLOOM_HASHES))


def open_store(uri: str) -> tuple:
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Encoder:
    """Chunks between white space to their ids as bytes.

    Latin letters that ASCII punctuation without apostrophes follows are split at the punctuation, so such a chunk's ids
    are those of its lower-cased letters and of its punctuation. Both are single pieces for the BPE model, which is
    called for them directly, and letters are encoded once for all their chunks. Other chunks go through
    the whole tokenizer. Chunks live in two generations, so memory is bounded and frequent ones stay.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.piece = self.tokenizer.model.tokenize
        spec = json.loads(self.tokenizer.to_str())
        plain = not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"])
        self.by_chunks = plain and spec["model"]["type"] == "BPE" and all(spec[k] == v for k, v in CUTTING.items())
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encoded(self, chunks: list[bytes]) -> None:
        kind = f"<u{self.width}"
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False), strict=True):
            self.young[chunk] = np.array(e.ids, kind).tobytes()

    def _part(self, key: bytes) -> bytes:
        """The ids of lower-case letters or punctuation, one piece for the model."""
        v = self.young.get(key)
        if v is None:
            v = self.old.get(key)
            if v is None:  # printable ASCII stands for itself
                ids = [t.id for t in self.piece(key.decode() if key.isascii() else key.decode("latin-1").translate(_BYTE_CHARS))]
                v = struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)
            self.young[key] = v
        return v

    def _learn(self, chunks: set[bytes]) -> None:
        """Puts all of chunks into the young generation."""
        young, old, direct = self.young, self.old, []
        for c in chunks:
            if (v := old.get(c)) is not None:
                young[c] = v
            elif m := _ASCII.fullmatch(c):
                letters = self._part(m[1].lower())
                young[c] = letters + self._part(m[2]) if m[2] else letters
            elif m := _SIMPLE.fullmatch(c.decode("utf-8", "replace")):
                letters = self._part(m[1].lower().encode())
                young[c] = letters + self._part(m[2].encode()) if m[2] else letters
            else:
                direct.append(c)
        self._encoded(direct)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, with the end id."""
        end = np.array([END_ID], f"<u{self.width}").tobytes()
        if not self.by_chunks:
            whole = [text.encode("utf-8", "surrogatepass").decode("utf-8", "replace") if text else "" for text in texts]
            return [np.array(e.ids, f"<u{self.width}").tobytes() + end for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        cut = [text.encode("utf-8", "surrogatepass").split() if text else [] for text in texts]
        got = [list(map(self.young.get, chunks)) for chunks in cut]
        gaps = [(chunks, g, [i for i, v in enumerate(g) if v is None]) for chunks, g in zip(cut, got, strict=True) if None in g]
        if gaps:
            if len(self.young) > CHUNKS_KEPT:
                self.young, self.old = {}, self.young
            self._learn({chunks[i] for chunks, _, at in gaps for i in at})
            for chunks, g, at in gaps:
                for i in at:
                    g[i] = self.young[chunks[i]]
        return [b"".join(g) + end for g in got]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class TableWriter:
    """Streams one shard; keys must come in order."""

    def __init__(self, uri: str, width: int) -> None:
        import zstandard

        self.fs, path = open_store(uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.width, self.out = uri, width, self.fs.open_output_stream(path)
        self.zip = zstandard.ZstdCompressor(level=1)
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.size = self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.last, self.size, len(data)))
            self.size += len(data)
            self.block = bytearray()

    def close(self) -> tuple:
        self.flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        n_bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray(-(-n_bits // 8))
        for k in dict.fromkeys(self.keys):
            for b in _bits(k, n_bits):
                bloom[b >> 3] |= 1 << (b & 7)
        self.out.write(index + bloom + _FOOTER.pack(self.size, len(index), n_bits, len(self.keys), self.tokens, len(self.index), self.width, MAGIC))
        self.out.close()
        return self.uri, id_of(self.keys[0]), id_of(self.keys[-1]), len(self.keys), self.tokens


class TableReader:
    """Reads one shard: all of it in order, or the values of a document."""

    def __init__(self, uri: str) -> None:
        fs, path = open_store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.index_at, n_index, self.n_bits, self.n_docs, self.n_tokens, n_blocks, self.width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a table")
        tail = self.file.read_at(size - _FOOTER.size - self.index_at, self.index_at)
        raw, self.bloom, self.blocks, at = tail[:n_index], tail[n_index:], [], 0
        for _ in range(n_blocks):
            n, at = _unvarint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _unvarint(raw, at)
            length, at = _unvarint(raw, at)
            self.blocks.append((key, offset, length))
        self.last_keys = [b[0] for b in self.blocks]

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        _, offset, length = self.blocks[block]
        data = self.file.read_at(length, offset)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        raw, at, key = zstandard.ZstdDecompressor().decompress(data[:-4]), 0, b""
        while at < len(raw):
            shared, at = _unvarint(raw, at)
            rest, at = _unvarint(raw, at)
            n, at = _unvarint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + n]
            at += n

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in range(len(self.blocks)):
            for key, value in self.entries(b):
                yield id_of(key), self.ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each entry of a document, found by Bloom filter and bisection."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key, self.n_bits)):
            return []
        out = []
        for b in range(bisect_left(self.last_keys, key), len(self.blocks)):
            seen = list(self.entries(b))
            out += [self.ids(v) for k, v in seen if k == key]
            if seen[-1][0] > key:
                break
        return out

    def close(self) -> None:
        self.file.close()


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def write_tables(documents: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Writes all documents' ids to shards in folder. The stored manifest: part, seq, path, first_id, last_id, n_docs, n_tokens."""
    ship(documents.sparkSession, TEXT_BYTES)
    vocabulary = vocabulary or default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        encode, table, rows = encoder(vocabulary), None, []
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                for doc_id, value in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    table = table or TableWriter(f"{folder}/{part:06d}-{len(rows):04d}-{attempt}.sst", encode.width)
                    table.add(key_of(doc_id), value)
                    if table.size >= SHARD_BYTES:
                        rows.append((part, len(rows), *table.close()))
                        table = None
        if table:
            rows.append((part, len(rows), *table.close()))
        yield batch(_MANIFEST, rows)

    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    d = d.repartitionByRange("doc_id", "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
    return stored(d.mapInArrow(write, "part int, seq int, path string, first_id long, last_id long, n_docs long, n_tokens long"), "manifest")


_ENTRIES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
            table, rows = TableReader(path), []
            for doc_id, ids in table:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(rows) == 10_000:
                    yield batch(_ENTRIES, rows)
                    rows = []
            yield batch(_ENTRIES, rows)
            table.close()


def read_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, from the shards' files."""
    base = F.sum("n_tokens").over(Window.orderBy("part", "seq")) - F.col("n_tokens")
    shards = manifest.select("part", "path", base.alias("base"))
    return shards.repartition(max(1, manifest.count()), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_tables(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """All documents written to shards in the shared folder and read back."""
    return read_tables(write_tables(documents, new_path(documents.sparkSession, "tokens"), vocabulary))
