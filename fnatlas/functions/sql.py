"""The engine for SQL: a table function that extracts, and scalar functions that label.

register(spark) makes them known to a session:

    SELECT f.file_path, t.function_name, c_complexity(t.function_code)
    FROM files f, LATERAL c_functions(f.content) t

c_functions(content) gives a row for each function: function_name, function_code, start_line, end_line. It is a Python table function, since
C is tokenized; the labels (c_control_flow, c_side_effects, c_complexity, c_error_handling, c_brace_depth) are SQL functions over built-in
expressions, so they are inlined into the plan and run in generated code. A null text has no functions, and null labels but
for those that the rules give to what they don't find.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import patterns as P


class _Functions:
    def eval(self, content: str):
        from ..operators.extract import by_tokens

        yield from by_tokens(content or "")


def _matches(pattern: str, flags: str = "") -> str:
    """As labels.matches(): Unicode's word characters where a text isn't all ASCII."""
    return f"(CASE WHEN octet_length(code) = length(code) THEN code RLIKE r'{flags}(?d){pattern}' ELSE code RLIKE r'{flags}(?Ud){pattern}' END)"


def _some(named: list[tuple[str, str]]) -> str:
    return "array_compact(array(" + ", ".join(f"CASE WHEN {m} THEN '{k}' END" for k, m in named) + "))"


def _definitions() -> dict[str, tuple[str, str]]:
    flow = _some([(k, _matches(rf"\b{k}\b")) for k in P.CONTROL_FLOW])
    effects = _some([(k, _matches(P.any_of(p), "(?i)")) for k, p in sorted(P.EFFECT_PATTERNS.items())])
    errors = "CASE " + " ".join(f"WHEN {_matches(P.any_of(p), '(?i)')} THEN '{k}'" for k, p in P.ERROR_PATTERNS.items()) + f" ELSE '{P.NO_ERRORS}' END"
    depth = "aggregate(regexp_extract_all(code, '([{}])', 1), struct(0 AS d, 0 AS m), (a, c) -> struct(a.d + if(c = '{', 1, -1) AS d, greatest(a.m, a.d + if(c = '{', 1, -1)) AS m), a -> a.m)"
    lines = r"size(split(code, '\n', -1))"
    band = lambda x, hi, lo: f"CASE WHEN {x} >= {hi} THEN 2 WHEN {x} >= {lo} THEN 1 ELSE 0 END"
    score = f"{band(lines, 51, 21)} + {band('size(c_control_flow(code))', 4, 2)} + {band('c_brace_depth(code)', 4, 3)}"
    return {
        "c_control_flow": ("ARRAY<STRING>", flow), "c_side_effects": ("ARRAY<STRING>", f"transform(array({effects}), e -> if(size(e) > 0, e, array('{P.NO_EFFECT}')))[0]"), "c_error_handling": ("STRING", errors),
        "c_brace_depth": ("INT", depth), "c_complexity": ("STRING", f"transform(array({score}), s -> CASE WHEN s >= 4 THEN 'high' WHEN s >= 2 THEN 'medium' ELSE 'low' END)[0]"),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, in place of those of the same names; their names."""
    ship(spark)
    spark.udtf.register("c_functions", F.udtf(_Functions, returnType="function_name string, function_code string, start_line int, end_line int"))
    made = _definitions()
    for name, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(code STRING) RETURNS {kind} RETURN {body}")
    return ["c_functions", *made]
