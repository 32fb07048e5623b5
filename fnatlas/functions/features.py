"""The 20 base and 20 hardware features of a function's code as Column expressions in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .labels import is_ascii, matches


def distinct_hits(code: Column, patterns: list[str]) -> Column:
    """How many of the patterns match at all."""
    out = F.lit(0)
    for p in patterns:
        out = out + matches(code, p).cast("int")
    return out


def occurrences(code: Column, pattern: str) -> Column:
    return F.when(is_ascii(code), F.regexp_count(code, F.lit(f"(?d){pattern}"))).otherwise(F.regexp_count(code, F.lit(f"(?Ud){pattern}")))


def capped(x: Column, n: int) -> Column:
    return F.least(x / F.lit(float(n)), F.lit(1.0))


def flag(x: Column) -> Column:
    return x.cast("int").cast("double")


def parameter_count(code: Column) -> Column:
    """Commas and one in the first parameter list before a brace; 0 for (void), () or none."""
    params = F.regexp_extract(code, "(?Ud)" + P.PARAMETERS, 0)
    none = (params == "") | F.contains(params, F.lit("(void)")) | F.contains(params, F.lit("()"))
    return F.when(none, 0).otherwise(F.regexp_count(params, F.lit(",")) + 1)


def base_features(code: Column) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name, pats, cap in P.BASE_GROUPS:
        k = distinct_hits(code, pats)
        out[f"{name}_count_norm"], out[f"{name}_present"] = capped(k, cap), flag(k > 0)
    out["lines_norm"] = capped(F.size(F.split(code, "\n", -1)), 50)
    out["func_calls_norm"] = capped(occurrences(code, P.FUNC_CALL), 20)
    out["control_flow_norm"] = capped(occurrences(code, P.CONTROL), 10)
    out["pointer_ops_norm"] = capped(occurrences(code, P.POINTER), 10)
    out["param_count_norm"] = capped(parameter_count(code), 5)
    out["return_count_norm"] = capped(occurrences(code, P.RETURN), 5)
    for name, p in (("has_null", P.HAS_NULL), ("has_sizeof", P.HAS_SIZEOF), ("has_struct_access", P.HAS_STRUCT), ("has_array_access", P.HAS_ARRAY)):
        out[name] = flag(matches(code, p))
    return out


def hardware_features(code: Column) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name, pats, cap in P.HARDWARE_GROUPS:
        k = distinct_hits(code, pats)
        out[f"{name}_count_norm"], out[f"{name}_present"] = capped(k, cap), flag(k > 0)
    for name, pats in P.PRESENT_GROUPS:
        out[f"{name}_present"] = flag(matches(code, P.any_of(pats)))
    bits = F.lit(0)
    for p in P.BITWISE:
        bits = bits + occurrences(code, p)
    out["bitwise_density"] = capped(bits, 8)
    brace = F.instr(code, "{")
    head = F.when(brace > 0, F.substring(code, F.lit(1), brace - 1)).otherwise(F.substring(code, 1, 200))
    out["is_driver_lifecycle"] = flag(matches(head, P.LIFECYCLE))
    for name, pats in (("has_device_struct", P.DEVICE_STRUCT), ("has_module_macro", P.MODULE_MACRO), ("has_inline_asm", P.INLINE_ASM), ("has_compiler_attr", P.COMPILER_ATTR)):
        out[name] = flag(matches(code, P.any_of(pats)))
    return out


def feature_names(hardware: bool = False) -> list[str]:
    base = [x for n, _, _ in P.BASE_GROUPS for x in (f"{n}_count_norm", f"{n}_present")]
    base += ["lines_norm", "func_calls_norm", "control_flow_norm", "pointer_ops_norm", "param_count_norm", "return_count_norm", "has_null", "has_sizeof", "has_struct_access", "has_array_access"]
    if not hardware:
        return base
    more = [x for n, _, _ in P.HARDWARE_GROUPS for x in (f"{n}_count_norm", f"{n}_present")] + [f"{n}_present" for n, _ in P.PRESENT_GROUPS]
    return [*base, *more, "bitwise_density", "is_driver_lifecycle", "has_device_struct", "has_module_macro", "has_inline_asm", "has_compiler_attr"]


def feature_vector(code: Column, hardware: bool = False) -> Column:
    cols = base_features(code) | (hardware_features(code) if hardware else {})
    return F.array(*[cols[n] for n in feature_names(hardware)])
