import sys
import zlib

import numpy as np
import pytest

from fnatlas.llm import token_store as ts
from fnatlas.llm.common import new_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(ts.default_vocabulary())


ODD = ["<|endoftext|>abc! it's WE'LL ÀÉ!! x<|startoftext|> 'S", "İstanbul ΑΣ ǅ é a b x²½ 你好 <|endoftext|>.", "don't\x1fstop ''s __ -- a'sb", "ſecret K ﬁ ß ẞ Ω", "́a ퟿", None, "", "  \n"]


def test_round_trip(spark, docs, texts, tokenizer):
    rows = [(d, t) for d, t, *_ in texts] + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(texts) :], "doc_id long, text string"))
    got = sorted(ts.token_tables(df).collect(), key=lambda r: r["start"])
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert len(got) == len(rows)
    for r, (d, t) in zip(got, rows, strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_lookup_in_many_blocks_and_shards(spark, tokenizer, monkeypatch):
    rows = [(i * 3 - 500, f"document {i} says {'very ' * (i % 40)}much") for i in range(900)] + [(8, "twice"), (8, "twice")]
    monkeypatch.setattr(ts, "BLOCK_BYTES", 700)
    folder = new_path(spark, "t")
    w = ts.TableWriter(f"{folder}/a.sst", 2)
    enc = ts.encoder(ts.default_vocabulary())
    for d, t in sorted(rows):
        w.add(ts.key_of(d), enc([t])[0])
    _, first, last, n, tokens = w.close()
    assert (first, last, n) == (-500, 2197, 902)
    r = ts.TableReader(f"{folder}/a.sst")
    assert len(r.blocks) > 20 and r.n_tokens == tokens and [d for d, _ in r] == sorted(d for d, _ in rows)
    for d, t in rows[:900:50]:
        assert [x.tolist() for x in r.get(d)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1]]
    assert len(r.get(8)) == 2 and r.get(9) == [] and r.get(None) == [] and r.get(10**12) == []
    r.close()


def test_corruption_is_found(spark):
    uri = f"{new_path(spark, 'c')}/a.sst"
    w = ts.TableWriter(uri, 2)
    w.add(ts.key_of(1), b"\1\0" * 50)
    w.close()
    path = uri.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[3] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(ts.TableReader(uri))


def test_keys_sort_like_ids():
    ids = [None, -(2**63), -5, 0, 1, 2**60, 2**63 - 1]
    keys = [ts.key_of(i) for i in ids]
    assert keys == sorted(keys) and [ts.id_of(k) for k in keys] == ids


def test_empty(no_docs):
    assert ts.token_tables(no_docs).collect() == []


def test_another_vocabulary(texts):
    """Its own way to cut texts is kept: the library's ids of whole texts, whether or not chunks may be encoded by themselves."""
    import public_tokenizers
    from tokenizers import Tokenizer

    for name, by_chunks in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = public_tokenizers.path(name)
        enc, plain = ts.Encoder(path), Tokenizer.from_file(path)
        assert enc.by_chunks == by_chunks
        some = [t for _, t, *_ in texts] + ["Two  spaces, don't JOIN\n\nlines <|endoftext|> 12", "a\u00a0b\u2003c"]
        for t, got in zip(some, enc(some), strict=True):
            want = plain.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(got, f"<u{enc.width}").tolist() == [*want, ts.END_ID]


def test_remembered_chunks_take_bounded_memory():
    enc = ts.Encoder(ts.default_vocabulary())
    for lo in range(0, 900_000, 10_000):
        enc([" ".join("".join(chr(97 + (i // 26**k) % 26) for k in range(5)) for i in range(lo, lo + 10_000))])
    held = {id(x): sys.getsizeof(x) for g in (enc.young, enc.old) for kv in g.items() for x in kv}
    assert sum(held.values()) + sys.getsizeof(enc.young) + sys.getsizeof(enc.old) < 100 << 20
