"""Functions of C files: one file row to many function rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ctokens import KEYWORDS, functions
from ..session import ship

#: Fixed value: the pattern of a definition's head where files are read by pattern.
_HEAD = re.compile(r"(?:^|\n)\s*(?:static\s+|inline\s+|extern\s+)*(?:const\s+)?[\w\s\*]+?\s+(\w+)\s*\([^)]*\)\s*\{", re.MULTILINE)

_OUT = "function_name string, function_code string, file_path string, start_line int, end_line int"
_ARROW = pa.schema([("function_name", pa.string()), ("function_code", pa.string()), ("file_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])

_SKIPPED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|[{}]""", re.DOTALL)


def matching_brace(code: str, at: int) -> int:
    """Where the brace at `at` is closed, outside comments and literals; `at` itself if nowhere."""
    depth = 0
    for m in _SKIPPED.finditer(code, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return m.start()
    return at


def by_tokens(code: str) -> Iterator[tuple[str, str, int, int]]:
    """name, code, first and last line of each definition."""
    line, at = 1, 0
    for f in functions(code):
        line += code.count("\n", at, f.start)
        at = f.start
        yield f.name, code[f.start : f.end], line, line + code.count("\n", f.start, f.end)


def by_pattern(code: str) -> Iterator[tuple[str, str, int, int]]:
    """The same by the head's pattern; keywords are no names, and what a function holds is no function."""
    end = -1
    for m in _HEAD.finditer(code):
        if m[1] in KEYWORDS or m.start(1) <= end:
            continue
        brace = m.end() - 1
        close = matching_brace(code, brace)
        if close > brace:
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            yield m[1], code[start : close + 1], code.count("\n", 0, start) + 1, code.count("\n", 0, close) + 1
            end = close


def extract_functions(files: DataFrame, method: str = "tokens") -> DataFrame:
    """Of files (file_path, content), a row for each function definition. A file that can't be read gives none."""
    ship(files.sparkSession)
    found = by_pattern if method == "pattern" else by_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(n, c, path, x, y) for n, c, x, y in found(code or "")]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    return files.select("file_path", "content").mapInArrow(run, _OUT)


def functions_per_file(functions_df: DataFrame) -> DataFrame:
    return functions_df.groupBy("file_path").agg(F.count("*").alias("n_functions"))


def function_totals(functions_df: DataFrame) -> DataFrame:
    return functions_df.agg(F.count("*").alias("n_functions"), F.count_distinct("file_path").alias("n_files"))


def with_ast_features(df: DataFrame, code: str = "function_code") -> DataFrame:
    """df with ast_features: 15 values in [0, 1]."""
    from ..functions.ctokens import ast_features

    ship(df.sparkSession)
    f = F.pandas_udf(lambda s: s.map(ast_features), "array<double>")
    return df.withColumn("ast_features", f(F.col(code)))


def with_shape(df: DataFrame, code: str = "function_code") -> DataFrame:
    """df with shape: how many calls, ifs and returns a function has, its cyclomatic number and its depths."""
    from ..functions.ctokens import shape

    ship(df.sparkSession)
    names = ("n_calls", "n_ifs", "n_returns", "cyclomatic", "loop_depth", "branch_depth")

    def shapes(codes: pd.Series) -> pd.DataFrame:
        got = [shape(c or "") for c in codes]
        return pd.DataFrame([(s.counts["call"], s.counts["if"], s.counts["return"], s.cyclomatic, s.loops, s.branches) for s in got], columns=names)

    f = F.pandas_udf(shapes, ", ".join(f"{n} int" for n in names))
    return df.withColumn("shape", f(F.col(code)))
