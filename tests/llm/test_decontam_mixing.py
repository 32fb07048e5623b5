import re

import pytest
from pyspark.sql import functions as F

from fnatlas.llm import decontam, mixing

from .conftest import DOCS, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                got = wins.get(tuple(w[a : a + n]))
                if got:
                    hit |= set(range(a, a + n))
                    ids |= got
        out.append((d, len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


ITEMS = [
    (1, prose(11, 60)), (2, prose(12, 20)), (3, "only Three WORDS"), (4, "Single"), (5, ""), (6, None), (7, "Étude ÉCOLE deux mots de plus ς ΑΣ fin"), (8, prose(11, 60)), (None, prose(13, 15)), (9, "..."),
]


def contaminated_docs():
    a, b = prose(11, 60).split(), prose(13, 15).split()
    out = [
        (1, " ".join(a)), (2, prose(1, 40) + " " + " ".join(a[10:30]) + "! " + prose(2, 500)), (3, " ".join(a[10:22])), (4, "x only, three; words y Single z single"), (5, None), (6, ""), (7, "étude ÉCOLE deux mots de plus ς ΑΣ fin"),
        (8, "Étude ÉCOLE Deux mots de plus ς ΑΣ fin"), (9, "?? " + " ".join(b) + " ??"), (10, (" ".join(a[:13]) + " ") * 50), (10, (" ".join(a[:13]) + " ") * 50), (None, " ".join(a)), (12, "SINGLE " * 3000), (13, "..."), (14, "ÉTUDE école deux mots de plus σ ας fin"),
    ]
    return out + [(100 + i, prose(200 + i, 30) + " " + " ".join(a[5:25])) for i in range(40)]


def test_decontamination_matches_brute_force(spark):
    docs = contaminated_docs()
    df = spark.createDataFrame([(d, t, "en", "s", None, "h", *"abcde"[:5]) for d, t in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(i, t, "w") for i, t in ITEMS], "item_id long, text string, win string")
    import hashlib

    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.decontaminate(df, bench).collect()), key=str)
    want = sorted(((d, n, h, k, hashlib.sha256(ids.encode()).hexdigest(), c) for d, n, h, k, ids, c in brute(docs, ITEMS)), key=str)
    assert got == want
    clean = decontam.clean_documents(df, bench)
    assert clean.columns == df.columns and {r["h"] for r in clean.collect()} <= {"h"}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, *_, c in brute(docs, ITEMS) if not c)


def test_decontamination_of_empty_tables(spark, docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.decontaminate(no_docs, bench).collect() == []
    got = decontam.decontaminate(docs, bench.limit(0)).collect()
    assert len(got) == docs.count() and not any(r["contaminated"] or r["n_hit"] for r in got)


def level(sizes):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped = {}
    while True:
        free = [s for s in order if s not in capped]
        rest = 1.5 * sum(sizes.values()) - sum(capped.values())
        total = sum(weight[s] for s in free)
        target = {s: rest * weight[s] / total for s in free} if free else {}
        over = [s for s in free if target[s] > 2 * sizes[s] or sizes[s] == 0]
        if not over:
            return capped | target
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark, docs, texts):
    size = {}
    for _, t, _, s in texts:
        size[s] = size.get(s, 0) + len(SPACE.findall(t or ""))
    want = level(size)
    got = mixing.mix_counts(docs, 16)
    rows = got.collect()
    assert len(rows) == len(texts) and sorted(map(str, rows)) == sorted(map(str, got.collect()))
    by = {}
    source = {}
    for d, t, _, s in texts:
        source.setdefault((d, len(SPACE.findall(t or ""))), s)
    for r in rows:
        s = source[r["doc_id"], r["size"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == size[s] and 0 <= r["taken"] <= 2 * r["size"]
        by[s] = by.get(s, 0) + r["taken"]
    assert by == {s: pytest.approx(want[s], abs=1) for s in want}
    mixed = mixing.mixed_documents(docs, 16)
    out = mixed.collect()
    assert mixed.columns == docs.columns and all(r["h"] == "x" and r["words"] == "z" and r["n_chars"] == len(r["text"]) for r in out)
    count = {}
    for r in out:
        count[r["source"]] = count.get(r["source"], 0) + len(SPACE.findall(r["text"]))
    assert count == {s: n for s, n in by.items() if n}
    taken = {}
    for r in rows:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert {r["doc_id"] for r in out} == {d for d, n in taken.items() if n}


def test_mixing_empty(no_docs):
    assert mixing.mix_counts(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))


def test_shards_are_drawn(spark):
    t = spark.createDataFrame([("a", 0, 50_000, 60_000.0), ("b", 1, 20_000, 40_000.0)], "source string, sid long, source_size long, target double")
    n = {(r["shard"], r["sid"]): r["n"] for r in mixing.slots(t, 10, 500).groupBy("shard", "sid").agg(F.count("*").alias("n")).collect()}
    assert all(n[s, 0] + n[s, 1] == 500 for s in range(20)) and len({n[s, 0] for s in range(20)}) > 5
    assert all(240 < n[s, 0] < 360 for s in range(20))


def test_windows_beyond_the_broadcast_bound(spark, sf, monkeypatch):
    """Joins by shuffle give the rows of joins by broadcast."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.limit(20)).union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = lambda: sorted(map(str, decontam.decontaminate(docs, bench).collect()))
    want = rows()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert rows() == want and any("contaminated=True" in r for r in want)
