import zlib

import numpy as np

from fnatlas.llm import langid


def test_held_out_accuracy_and_rules(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identified(d, None, "lang").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9


def test_awkward_texts(docs, texts):
    got = langid.identified(docs, None).collect()
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] in (5, 6, 7, 13):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] != "und" and 0 < r["score"] <= 1
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and {5, 6, 7, 13}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_empty_and_unlabelled(docs, no_docs):
    from pyspark.sql import functions as F

    assert langid.identified(no_docs).collect() == []
    got = langid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


def test_windows_cover_the_whole_text():
    raw = bytes(range(65, 91)) * 40
    win, sizes = langid.cut(raw)
    assert win.reshape(-1)[: len(raw)].tobytes() == raw and sizes.sum() == len(raw)


def test_gradients():
    r = np.random.default_rng(0)
    net = langid.ByteNet(["a", "b", "c"])
    x = r.integers(97, 123, (12, 40)).astype(np.uint8)
    y = r.integers(0, 3, 12)
    before = -net.log_probabilities(x)[np.arange(12), y].mean()
    net.fit(x, y, epochs=60)
    assert -net.log_probabilities(x)[np.arange(12), y].mean() < before / 3


def test_rare_languages_and_whole_texts_are_learned(spark, monkeypatch):
    """A language of few short documents among many is learned, and the sample holds whole texts up to its share of bytes."""
    words = {"xx": "zzor qqua xxil", "yy": "aba ebe ibi", "rare": "kukk lull momm"}
    rows = [(i, " ".join([words["xx" if i % 2 else "yy"]] * (1 + i % 40)), "xx" if i % 2 else "yy") for i in range(3000)]
    rows += [(9000 + i, " ".join([words["rare"][i % 7 :]] * 40), "rare") for i in range(28)]
    d = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id long, text string, lang string")
    languages, sample = langid.sampled(d, 12_000)  # copies count once: there are 20 distinct texts of each common language
    got = [(r["lang"], r["text"]) for r in sample.collect()]
    assert languages == ["rare", "xx", "yy"] and len(set(got)) == len(got) and set(got) <= {(lang, t) for _, t, lang in rows}
    for lang in languages:
        size = [len(t) for k, t in got if k == lang]
        assert sum(size) - max(size) < 4000 and (lang == "rare" or sum(size) >= 2500)
    net = langid.trained(d)
    assert langid.predicted(net, ["momm lull kukk momm lull " * 9])[0][0] == "rare"
