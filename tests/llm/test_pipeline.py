"""The pipeline's stages against plain code, each on its own input."""

import zlib

import numpy as np

import corpus_pipeline
from fnatlas.llm import langid, token_store
from fnatlas.llm.common import stored

from .test_decontam_mixing import brute as brute_hits
from .test_minhash import brute as brute_groups


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, f in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stored(f(spark, docs, sf), name)
        kept[name] = (before, {r["doc_id"]: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = kept["language_id"]
    gone = set(before) - set(after)
    assert all(not langid._LETTER.search(before[d]["text"]) for d in gone if len(before[d]["text"]) > 200)
    assert all(after[d] == before[d] for d in after)
    before, after = kept["near_dedup"]
    roots = brute_groups([(d, r["text"]) for d, r in before.items()])
    assert set(after) == {d for d, (_, root) in roots.items() if d == root} and len(after) < len(before)
    before, after = kept["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, *_, c in brute_hits([(d, r["text"]) for d, r in before.items()], items) if c}
    assert set(after) == set(before) - bad and bad
    before, after = kept["source_mixing"]
    size = {d: len(r["text"].split()) for d, r in before.items()}
    got = {d: len(r["text"].split()) for d, r in after.items()}
    assert abs(sum(got.values()) - 1.5 * sum(size.values())) < 30 and all(n <= 2 * size[d] for d, n in got.items())
    before, after = kept["token_output"]
    assert set(after) == set(before)
    enc, start = token_store.encoder(token_store.default_vocabulary()), 0
    for d in sorted(before):
        ids = np.frombuffer(enc([before[d]["text"]])[0], "<u2").astype("<u4")
        assert (after[d]["start"], after[d]["n_tokens"], after[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_awkward_rows_go_through(spark, sf, docs, texts):
    """Nulls, empty and long texts, repeated ids and rows, extra columns with clashing names."""
    columns, kept = docs.columns, {}
    for name, f in corpus_pipeline.STAGES:
        docs = stored(f(spark, docs, sf), name)
        kept[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert all((r["h"], r["size"], r["key"]) == ("x", "y", "k") for r in kept[name])
    ids = lambda name: [r["doc_id"] for r in kept[name]]
    assert not {5, 6, 7, 13} & set(ids("language_id"))  # no letters
    assert {1, 2, 3, 11, 12, 14, -5, 2**60 + 1, None} <= set(ids("language_id"))
    assert 2 not in ids("near_dedup") and ids("near_dedup").count(14) == 1 and None in ids("near_dedup") and 11 in ids("near_dedup")
    long = next(r for r in kept["source_mixing"] if r["doc_id"] == 11)
    assert len(long["text"].split()) > 10_000
    assert sorted(map(str, ids("token_output"))) == sorted(map(str, ids("source_mixing")))


def test_empty_table_goes_through(spark, sf, no_docs):
    docs = no_docs
    for name, f in corpus_pipeline.STAGES:
        docs = stored(f(spark, docs, sf), name)
        assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    q = entry.queries()
    assert "pipeline" in q
    for n in range(1, 13):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert set(entry.oracle_sql()) <= set(q)
