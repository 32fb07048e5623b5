"""Benchmark decontamination: a prefix-filtered set join, with DataFrame operations only.

Every benchmark window (13 consecutive words; a shorter item is one window) is a sequence of word shingles.
A document holds it only if it holds all of them, so the prefix that has to match is one shingle: the rarest
over all documents. The first scan counts the windows' shingles in the documents; the second joins document
shingles to the rarest ones, drops places where the window would leave the document (position and length
bounds) and compares all words of the window there. Up to BROADCAST_BYTES the windows go to the documents; beyond, only
places (document, position, key) are shuffled, counted by key before they are joined. Places get their windows' words, and only the
texts of documents with places come back for the comparison, once each: the ids of these documents go to the texts while they
are few, so other texts aren't shuffled at all.

Both scans fold letters with lower(), which is fast and finds at least the places that match after lower-casing
A-Z; texts that are not all ASCII are compared again under the exact rule.

Defined cases: null and wordless texts and items have no words, windows or hits; an item id that is null counts
as the empty string; repeated rows get the same result each; an empty benchmark or documents table gives no hits
or no rows; other columns are ignored, whatever their names; very long texts are cut into words whole, in the JVM. The
bytes of benchmark shingles decide between broadcast and shuffle, which give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, spread_join, stored

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
#: Bytes of a table of windows or shingles up to which it may be broadcast; they are measured first.
BROADCAST_BYTES = 64 << 20
#: Bytes of a broadcast row of a document's id and digest.
ID_BYTES = 32
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before letters are folded; Java finds them several times as fast as the complement of the separators.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def folded(text: Column) -> Column:
    """lower(), without the one case in which it depends on neighbouring words."""
    low = F.lower(text)
    return F.when(F.contains(text, F.lit("Σ")) | F.contains(text, F.lit("ς")), F.replace(low, F.lit("ς"), F.lit("σ"))).otherwise(low)


def windows(benchmark: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """item, win (the words, exact rule), fold (its words, folded), len: a row for each window."""
    full = lambda c: F.filter(F.split(c, SEPARATOR), lambda w: w != "")
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), full(ascii_lower(F.col("text"))).alias("w"), full(folded(F.col("text"))).alias("f"))
    b = b.filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window_words)))
    b = b.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))))
    return b.select("item", F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ").alias("win"), F.slice("f", F.col("at") + 1, F.col("len")).alias("fold"), "len")


def _key(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(words, at + i) for i in range(n)])


def occurrences(documents: DataFrame, wins: DataFrame) -> DataFrame:
    """Of documents (doc_id, h, text) and stored windows: doc_id, h, start, len, win for every place of a window."""
    each = wins.select("win", "fold", "len").distinct()
    at = each.withColumn("n", F.least("len", F.lit(SHINGLE_WORDS))).withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("n"))))
    key = F.coalesce(*[F.when(F.col("n") == n, _key(F.col("fold"), F.col("off"), n)) for n in range(1, SHINGLE_WORDS + 1)])
    shingles = stored(at.withColumn("key", key), "shingles")
    lengths = sorted(r[0] for r in shingles.select("n").distinct().collect())  # 1 to 3 of them
    if not lengths:
        return documents.select("doc_id", "h", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("win")).limit(0)
    d = documents.withColumn("words", F.split(folded(F.col("text")), SEPARATOR))
    d = d.select("doc_id", "h", "text", "words", F.posexplode_outer("words").alias("pos", "word"))
    if len(lengths) == 1:
        d = d.withColumn("key", _key(F.col("words"), F.col("pos"), lengths[0]))
    else:
        d = d.withColumn("key", F.explode_outer(F.array(*[_key(F.col("words"), F.col("pos"), n) for n in lengths])))
    keys = shingles.select("key").distinct()
    if shingles.count() * 8 <= BROADCAST_BYTES:
        seen = d.select("key").join(F.broadcast(keys), "key").groupBy("key").agg(F.count("*").alias("seen"))
    else:  # a common key is one row of each task
        seen = d.groupBy("key").agg(F.count("*").alias("seen")).join(keys, "key")
    seen = stored(seen, "seen")
    rare = shingles.join(seen, "key", "left").groupBy("win", "fold", "len").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "off", "key", "n")).alias("rarest"))
    # a window with a shingle that no document has is in none
    rare = stored(rare.filter("rarest.seen > 0").select("win", "fold", "len", "rarest.off", "rarest.key"), "rarest")
    size = rare.agg(F.sum(2 * F.octet_length("win") + 64)).first()[0] or 0
    start = F.col("pos") - F.col("off")
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.size("words"))
    if size <= BROADCAST_BYTES:
        found = d.join(F.broadcast(rare), "key").withColumn("start", start).filter(inside)
    else:
        places = d.select("doc_id", "h", "pos", "key", F.size("words").alias("n_words")).join(rare.select("key", "win", "off", "len"), "key")
        places = places.withColumn("start", start).filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
        places = stored(places.select(F.col("doc_id").alias("at_id"), F.col("h").alias("at_h"), "start", "win", "len").distinct(), "places")
        ids = places.select("at_id", "at_h").distinct()
        few = F.broadcast(ids) if ids.count() * ID_BYTES <= BROADCAST_BYTES else ids
        whole = documents.join(few, documents["doc_id"].eqNullSafe(few["at_id"]) & (documents["h"] == few["at_h"]), "left_semi")
        whole = whole.dropDuplicates(["doc_id", "h"]).withColumn("words", F.split(folded(F.col("text")), SEPARATOR))
        of = spread_join(places, rare.select("win", "fold"), "win", "at_h")
        found = whole.join(of, whole["doc_id"].eqNullSafe(of["at_id"]) & (whole["h"] == of["at_h"]))
    found = found.filter(F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("len")) == F.col("fold"))
    exact = F.array_join(F.slice(F.split(ascii_lower(F.col("text")), SEPARATOR), F.greatest(F.col("start"), F.lit(0)) + 1, F.col("len")), " ") == F.col("win")
    found = found.filter((F.octet_length("text") == F.length("text")) | exact)
    return found.select("doc_id", "h", "start", "len", "win")


def decontaminate(documents: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, h (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("h"))
    wins = stored(windows(benchmark), "windows")
    found = stored(occurrences(docs, wins), "found")
    places = found.groupBy("doc_id", "h", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = F.max("end").over(Window.partitionBy("doc_id", "h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.col("start"))))
    hit = places.withColumn("new", new).groupBy("doc_id", "h").agg(F.sum("new").alias("n_hit"))
    of = wins.select("win", "item").distinct()
    held = found.select("doc_id", "h", "win").distinct()
    size = wins.agg(F.sum(F.octet_length("win") + F.octet_length("item") + 64)).first()[0] or 0
    held = held.join(F.broadcast(of), "win") if size <= BROADCAST_BYTES else spread_join(held, of, "win", "h")
    items = held.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = hit.join(items, hit["doc_id"].eqNullSafe(items["doc_id"]) & (hit["h"] == items["h"])).select(hit["*"], "items")
    n = docs.select("doc_id", "h", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = n.join(hit, n["doc_id"].eqNullSafe(hit["doc_id"]) & (n["h"] == hit["h"]), "left").select(n["*"], "n_hit", "items")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the contaminated ones."""
    bad = decontaminate(documents, benchmark).filter("contaminated").select(F.col("doc_id").alias("_fn_id"), F.col("h").alias("_fn_bad")).distinct()
    d = documents.withColumn("_fn_h", F.xxhash64("text"))
    return d.join(bad, d["doc_id"].eqNullSafe(bad["_fn_id"]) & (d["_fn_h"] == bad["_fn_bad"]), "left_anti").select(documents.columns)
