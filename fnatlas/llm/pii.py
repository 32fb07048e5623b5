"""Personal data by weak supervision.

The base spans are fixed patterns. Candidates are the base spans and looser ones: numbers grouped like telephone
or card numbers, addresses written out with "at" and "dot", social security numbers, bank accounts, names
after a title. Six labelers vote yes, no or nothing on each: the pattern's shape, its check digits or ranges,
words before it, gazetteers, its neighbours, and signs of something else. The votes of all documents are counted by
pattern of votes, so that expectation-maximisation, which estimates each labeler's reliability for a true and a
false candidate, needs that bounded table only. A logistic span classifier is trained on the posteriors of at most train_spans
candidates, those of the smallest hash, and decides which candidates that aren't base spans are added. It sees what no
labeler votes on besides the votes: the span's shape and ends, and the words around it, hashed to FEATURES weights.

Defined cases: a null text counts as empty; long numbers and texts without white space are scanned in linear
time; of spans that overlap a base span none is added; repeated rows get the same result each; an empty table gives no
rows; other columns are ignored, whatever their names; doc_id must be a number.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored
from .spans import batch, digest, joined, masked

#: Kinds in their order.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "name")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Words that announce a kind, in four languages.
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "carte", "tarjeta", "karte", "credit"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp", "telefon", "telefono", "handy", "movil"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "name": ("name", "signed", "regards", "nom", "nombre"),
}
#: Gazetteers.
DOMAINS = frozenset("com org net edu gov mil int info biz io ai co me dev app uk us de fr es it nl be ch at eu ca au jp cn in br mx ru pl se no fi dk pt ie nz za".split())
COUNTRIES = frozenset("BE BR CH CZ DE DK ES FI FR GB GR HU IE IL IT LU NL NO PL PT RO SA SE SK TR".split())
FIRST_NAMES = frozenset("james mary john anna robert linda michael maria david elena thomas julia peter laura paul sarah mark emma jean marie pierre claire hans petra klaus sabine jose carmen juan lucia carlos sofia".split())

LABELERS = 6
#: Characters before a candidate in which the context labeler looks for words.
MATCH_CHARS = 48
EM_ROUNDS = 60
#: Hashed features of spans and their context, and the default of train_spans.
FEATURES, TRAIN_SPANS = 512, 20_000

_DIGIT = re.compile(r"[0-9]")
_EMAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUPED = re.compile(r"(?<![0-9A-Za-z_.+/-])(?:\([0-9]{2,5}\)[\x20-]?)?[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){1,6}(?![0-9A-Za-z_])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_WRITTEN = re.compile(r"(?<![\w.])([A-Za-z0-9._%+-]{1,64})\x20?[(\[{]at[)\]}]\x20?([A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]{1,63}){1,4})", re.ASCII | re.IGNORECASE)
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Mme|Herr|Frau|Sr|Sra)\.?\x20((?:[^\W\d_]{2,20}\x20){0,1}[^\W\d_]{2,20})")
_TITLES = ("Mr", "Ms", "Dr", "Prof", "Mme", "Herr", "Frau", "Sr")
_WORD_END = re.compile(r"[A-Za-z]+$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, from each @ outwards, so that long runs are read once."""
    end = 0
    for m in _EMAIL.finditer(text):
        a = m.start()
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            end = m.end()
            yield a, end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the base ones."""
    out = []
    if _DIGIT.search(text):
        for m in _GROUPED.finditer(text):
            n = sum("0" <= c <= "9" for c in m[0])
            if 7 <= n <= 19:
                out.append(("phone" if n <= 12 else "card", m.start(), m.end()))
        out += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
        out += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text)]
    if "(" in text or "[" in text or "{" in text:
        out += [("email", m.start(), m.end()) for m in _WRITTEN.finditer(text)]
    if any(t in text for t in _TITLES):
        out += [("name", m.start(1), m.end(1)) for m in _TITLE.finditer(text)]
    return out


def _valid(kind: str, s: str, digits: str) -> int:
    if kind == "card":
        return 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    if kind == "iban":
        t = s.replace(" ", "")
        return 1 if 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind == "phone":
        return 1 if 9 <= len(digits) <= 15 else -1
    return 0


def votes(text: str, kind: str, a: int, b: int, base: bool) -> list[int]:
    """What the labelers say of a candidate: 1, -1 or 0 each."""
    s = text[a:b]
    digits = re.sub(r"[^0-9]", "", s)
    before, after = text[max(0, a - MATCH_CHARS) : a], text[b : b + 8]
    low = before.lower()
    shape = 1 if base or kind in ("ssn", "iban") or (kind == "phone" and s[0] == "(") else 0
    known = 0
    if kind == "email":
        known = 1 if (m := _WORD_END.search(s)) and m[0].lower() in DOMAINS else -1
    elif kind == "iban":
        known = 1 if s[:2] in COUNTRIES else -1
    elif kind == "name":
        known = 1 if s.split(" ")[0].lower() in FIRST_NAMES else (0 if s[0].isupper() else -1)
    elif kind == "card":
        known = 1 if digits[:1] in ("3", "4", "5", "6") else -1
    prev, nxt = before[-1:], after[:1]
    apart = -1 if prev.isalnum() or nxt.isalnum() or prev in ("_", "/", "#") or nxt in ("_", "/") else 1
    other = 0
    if kind in ("phone", "card"):
        years = re.fullmatch(r"(?:19|20)[0-9]{2}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2}", s)
        other = -1 if years or re.search(r"[$€£%=]\s?$|\b(?:no|nr|isbn|v|version|page)\.?\s?$", low) or after[:1] in ("%", "€") else 0
    context = 1 if any(w in low for w in CONTEXT[kind]) else 0
    return [shape, _valid(kind, s, digits), context, known, apart, other]


def pattern(text: str, kind: str, a: int, b: int, base: bool) -> int:
    """Kind, length class and votes of a candidate as one number."""
    code = ORDER[kind] * 4 + min(3, (b - a) // 10)
    for v in votes(text, kind, a, b, base):
        code = code * 3 + v + 1
    return code


_SHAPES = str.maketrans({**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})


def span_features(text: str, kind: str, a: int, b: int) -> list[int]:
    """Which of FEATURES a candidate has: its shape, how it begins and ends, its neighbours and the words around it."""
    s, before, after = text[a:b], text[max(0, a - MATCH_CHARS) : a], text[b : b + MATCH_CHARS]
    shape = re.sub(r"(.)\1+", r"\1+", s.translate(_SHAPES))
    names = [f"shape {shape}", f"first {shape[:2]}", f"last {shape[-2:]}", f"sizes {' '.join(str(len(x)) for x in re.split(r'[^0-9A-Za-z]+', s))}"]
    names += [f"before {before[-1:].translate(_SHAPES)}", f"after {after[:1].translate(_SHAPES)}"]
    names += [f"left {w}" for w in before.lower().split()[-2:]] + [f"right {w}" for w in after.lower().split()[:2]]
    return [zlib.crc32(f"{kind} {n}".encode("utf-8", "surrogatepass")) % FEATURES for n in names]


def unpacked(code: int) -> tuple[int, int, list[int]]:
    got = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        got.append(v - 1)
    return code // 4, code % 4, got[::-1]


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes, and one-hot features of patterns."""
    parts = [unpacked(int(c)) for c in codes]
    kind, size = np.array([p[0] for p in parts], int).reshape(-1), np.array([p[1] for p in parts], int).reshape(-1)
    v = np.array([p[2] for p in parts], int).reshape(-1, LABELERS)
    x = np.concatenate([np.ones((len(parts), 1)), np.eye(len(KINDS))[kind], np.eye(4)[size], np.eye(3)[v + 1].reshape(len(parts), -1)], 1)
    return kind, v, x


def reliabilities(kind: np.ndarray, v: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation: posteriors of the patterns, P(vote | true or false), P(true) by kind.

    Pseudocounts say that a vote is more often right than wrong, which keeps true and false from changing places.
    """
    prior = np.array([[6.0, 3.0, 1.0], [1.0, 3.0, 6.0]])  # false, true by no, nothing, yes
    p = 1 / (1 + np.exp(-1.5 * v.sum(1)))
    for _ in range(rounds):
        table = np.repeat(prior[:, None, :], LABELERS, 1)
        for j in range(LABELERS):
            for value in range(3):
                at = v[:, j] == value - 1
                table[1, j, value] += (counts * p)[at].sum()
                table[0, j, value] += (counts * (1 - p))[at].sum()
        table /= table.sum(2, keepdims=True)
        share = np.array([(1 + (counts * p)[kind == k].sum()) / (2 + counts[kind == k].sum()) for k in range(len(KINDS))])
        logs = np.log(table)
        yes = np.log(share[kind]) + sum(logs[1, j, v[:, j] + 1] for j in range(LABELERS))
        no = np.log1p(-share[kind]) + sum(logs[0, j, v[:, j] + 1] for j in range(LABELERS))
        p = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
    return p, table, share


def classifier(x: np.ndarray, p: np.ndarray, counts: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on posteriors, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (counts * q * (1 - q))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (counts * (q - p)) + penalty * w)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, cands array<struct<kind:string,a:long,b:long,code:long,base:boolean,features:array<int>>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("code", pa.int64()), ("base", pa.bool_()), ("features", pa.list_(pa.int32()))]))
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base", pa.string()), ("cands", _SPAN)])
_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = text or ""
            base = base_spans(text)
            have = set(base)
            loose = [s for s in dict.fromkeys(loose_spans(text)) if s not in have]
            cands = [{"kind": k, "a": x, "b": y, "code": pattern(text, k, x, y, i < len(base)), "base": i < len(base), "features": span_features(text, k, x, y)} for i, (k, x, y) in enumerate(base + loose)]
            rows.append((doc_id, *(sum(s[0] == k for s in base) for k in BASE), joined(base, ORDER), cands))
        yield batch(_FOUND_ARROW, rows)


def _decided(found: DataFrame, by_code: dict[int, float], weights: np.ndarray) -> DataFrame:
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                base = [(c["kind"], c["a"], c["b"]) for c in r["cands"] if c["base"]]
                spans = list(base)
                for c in r["cands"]:
                    if not c["base"] and by_code[c["code"]] + weights[c["features"]].sum() > 0 and not any(x < c["b"] and c["a"] < y for _, x, y in base):
                        spans.append((c["kind"], c["a"], c["b"]))
                rows.append((r["doc_id"], *(r[f"n_{k}"] for k in BASE), digest(r["base"]), joined(spans, ORDER), len(spans) - len(base)))
            yield batch(_OUT_ARROW, rows)

    return found.mapInArrow(decide, _OUT)


def learned(found: DataFrame, train_spans: int = TRAIN_SPANS) -> tuple[dict[int, float], np.ndarray, dict]:
    """The classifier: its score of each pattern of votes and its weights of the hashed features; what was estimated. Patterns are at most 7 * 4 * 3^6."""
    c = found.select(F.explode("cands.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    codes, counts = np.array([r["code"] for r in c], np.int64), np.array([r["n"] for r in c], float)
    if not len(codes):
        return {}, np.zeros(FEATURES), {}
    kind, v, x = _features(codes)
    p, table, share = reliabilities(kind, v, counts)
    one = found.select("doc_id", F.explode("cands").alias("c")).select("c.code", "c.features", F.xxhash64("doc_id", "c.kind", "c.a", "c.b").alias("h"))
    sample = one.orderBy("h", "code", "features").limit(train_spans).collect()
    at = np.searchsorted(codes, [r["code"] for r in sample])
    hashed = np.zeros((len(sample), FEATURES))
    for i, r in enumerate(sample):
        np.add.at(hashed[i], r["features"], 1)
    w = classifier(np.concatenate([x[at], hashed], 1), p[at], np.ones(len(sample)))
    return dict(zip(codes.tolist(), (x @ w[: x.shape[1]]).tolist(), strict=True)), w[x.shape[1] :], {"votes": table, "share": share, "weights": w}


def personal_data(documents: DataFrame, train_spans: int = TRAIN_SPANS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each document."""
    ship(documents.sparkSession)
    found = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, _FOUND), "pii")
    by_code, weights, _ = learned(found, train_spans)
    return _decided(found, by_code, weights)


def redacted(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """documents, whose ids are distinct, with every span of personal_data() masked."""
    mask = F.pandas_udf(lambda t, s: t.combine(s, masked), "string")
    j = documents.join(spans.select("doc_id", "spans"), "doc_id", "left")
    return j.withColumn("text", F.when(F.coalesce("spans", F.lit("")) == "", F.col("text")).otherwise(mask("text", F.coalesce("spans", F.lit(""))))).select(documents.columns)
