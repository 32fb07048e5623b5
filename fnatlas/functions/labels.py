"""Rule-based labels of functions as Column expressions: no Python on the executors."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: Only \n ends a line; and word characters are those of Unicode where a text isn't all ASCII, which is several times slower.
_LINES, _UNICODE = "(?d)", "(?Ud)"


def is_ascii(code: Column) -> Column:
    return F.octet_length(code) == F.length(code)


def matches(code: Column, pattern: str, ignore_case: bool = False) -> Column:
    i = "(?i)" if ignore_case else ""
    return F.when(is_ascii(code), code.rlike(f"{i}{_LINES}{pattern}")).otherwise(code.rlike(f"{i}{_UNICODE}{pattern}"))


#: What has the case of an ASCII letter by Unicode's rules, and a letter in its place that only patterns that ignore case can match.
_CASED = (("\u212a", "K"), ("\u017f", "S"), ("\u0130", "I"), ("\u0131", "I"))
#: Kinds of other characters beyond ASCII, and one of that kind that no pattern names.
_KINDS = ((r"(?U)[[^\x00-\x7F]&&[\w]]+", "9"), (r"(?U)[[^\x00-\x7F]&&[\s]]+", " "), (r"[^\x00-\x7F]+", "#"))


def plain(code: Column) -> Column:
    """ASCII that has the labels of code, so that only this one pass goes by Unicode's character classes. Lines and braces are kept."""
    out = code
    for letter, other in _CASED:
        out = F.replace(out, F.lit(letter), F.lit(other))
    for kind, other in _KINDS:
        out = F.regexp_replace(out, kind, other)
    return F.when(is_ascii(code), code).otherwise(out)


def control_flow(code: Column) -> Column:
    """The control-flow keywords in the code, in their fixed order."""
    return F.array_compact(F.array(*[F.when(F.contains(code, F.lit(k)) & matches(code, rf"\b{k}\b"), F.lit(k)) for k in P.CONTROL_FLOW]))


def matches_any(code: Column, patterns: list[str], lowered: bool) -> Column:
    """Whether one of patterns matches in whatever case. lowered: code is lower-case ASCII, so only texts that hold the beginning of a match are matched."""
    found = matches(code, P.any_of(patterns), True)
    return functools.reduce(Column.__or__, [F.contains(code, F.lit(x)) for x in dict.fromkeys(map(P.begins_with, patterns))]) & found if lowered else found


def side_effects(code: Column, lowered: bool = False) -> Column:
    """Sorted side effects, or the one for none. lowered: code is that of lower(plain())."""
    found = F.array_compact(F.array(*[F.when(matches_any(code, p, lowered), F.lit(k)) for k, p in sorted(P.EFFECT_PATTERNS.items())]))
    return or_none(found)


def or_none(effects: Column) -> Column:
    """effects, evaluated once, or the one for none if empty."""
    return F.get(F.transform(F.array(effects), lambda e: F.when(F.size(e) > 0, e).otherwise(F.array(F.lit(P.NO_EFFECT)))), F.lit(0))


def brace_depth(code: Column) -> Column:
    """The largest depth of braces, wherever they stand."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc: Column, ch: Column) -> Column:
        d = acc["d"] + F.when(ch == "{", 1).otherwise(-1)
        return F.struct(d.alias("d"), F.greatest(acc["m"], d).alias("m"))

    braces = F.regexp_extract_all(code, F.lit(r"([{}])"), F.lit(1))
    return F.aggregate(braces, start, step, lambda acc: acc["m"])


def line_count(code: Column) -> Column:
    return F.size(F.split(code, "\n", -1))


def complexity_score(code: Column) -> Column:
    lines, kinds, depth = line_count(code), F.size(control_flow(code)), brace_depth(code)
    band = lambda c, hi, lo: F.when(c >= hi, 2).when(c >= lo, 1).otherwise(0)
    return band(lines, 51, 21) + band(kinds, 4, 2) + band(depth, 4, 3)


def complexity(code: Column) -> Column:
    s = complexity_score(code)
    return F.when(s >= 4, "high").when(s >= 2, "medium").otherwise("low")


def error_handling(code: Column, lowered: bool = False) -> Column:
    out = F.lit(P.NO_ERRORS)
    for k, p in reversed(P.ERROR_PATTERNS.items()):
        out = F.when(matches_any(code, p, lowered), F.lit(k)).otherwise(out)
    return out


def purpose(name: Column) -> Column:
    """A sentence from the function's name."""
    words = F.lower(F.replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")))
    out = F.when(F.contains(words, F.lit("\0")), F.lit(None))
    for key, verb in P.PURPOSE_VERBS:
        out = out.when(F.contains(words, F.lit(key)), F.concat(F.lit(f"{verb} "), F.trim(F.replace(words, F.lit(key), F.lit("")))))
    some = lambda keys: words.rlike("|".join(keys))
    out = out.when(some(P.PURPOSE_FREE), F.concat(F.lit("Cleans up or frees "), words)).when(some(P.PURPOSE_ALLOC), F.concat(F.lit("Allocates or creates "), words))
    return out.otherwise(F.concat(F.lit("Performs "), words, F.lit(" operation")))


def label_struct(name: Column, code: Column) -> Column:
    """All labels of a function as one struct."""
    return F.struct(
        purpose(name).alias("high_level_purpose"), control_flow(code).alias("control_flow_elements"), side_effects(code).alias("side_effects"),
        complexity(code).alias("complexity"), error_handling(code).alias("error_handling"),
    )


LABELS_DDL = "struct<high_level_purpose:string,control_flow_elements:array<string>,side_effects:array<string>,complexity:string,error_handling:string>"


def without_rare(effects: Column, rare: tuple[str, ...] = ("assertions", "network")) -> Column:
    """Effects without the rare ones, in their order."""
    return or_none(F.filter(effects, lambda e: ~e.isin(*rare)))


def merged_complexity(c: Column) -> Column:
    return F.when(c == "high", "medium").otherwise(c)


def primary_effect(effects: Column) -> Column:
    return F.coalesce(F.get(F.filter(effects, lambda e: e != P.NO_EFFECT), F.lit(0)), F.lit(P.NO_EFFECT))


def parse_llm_labels(answer: Column, code: Column) -> Column:
    """Labels from a model's JSON answer, with or without a fence; the defaults where it can't be read."""
    body = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    got = F.from_json(body, "high_level_purpose string, side_effects array<string>, complexity string, error_handling string", {"mode": "PERMISSIVE"})
    fine = F.coalesce(F.get_json_object(body, "$").isNotNull() & body.startswith("{"), F.lit(False))
    return F.struct(
        F.when(fine, F.coalesce(got["high_level_purpose"], F.lit("Unknown"))).otherwise("Unknown").alias("high_level_purpose"),
        control_flow(code).alias("control_flow_elements"),
        F.when(fine & got["side_effects"].isNotNull(), got["side_effects"]).otherwise(F.array(F.lit(P.NO_EFFECT))).alias("side_effects"),
        F.coalesce(got["complexity"], F.lit(P.NO_COMPLEXITY)).alias("complexity"),
        F.coalesce(got["error_handling"], F.lit(P.NO_ERRORS)).alias("error_handling"),
    )
