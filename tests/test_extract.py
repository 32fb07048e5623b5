import pytest

from fnatlas.functions.ctokens import COUNTED, ast_features, functions, shape
from fnatlas.operators.extract import by_pattern, by_tokens, extract_functions, functions_per_file, matching_brace

SOURCE = '''/* é { not code */
#include <x.h>
#define WRAP(a) do { \\
  a; } while (0)
static int g = 3;
struct s { int a; };
int proto(int);
static inline int *foo(struct s *p, int n)
{
    char c = '{'; const char *q = "}\\\\"; /* } */ // }
    for (int i = 0; i < n; i++) { while (n) { n--; } }
    if (n && p) { goto out; } else if (n) { call(n); } else n = 2;
out:
    return n ? p : 0;
}
extern "C" { void bar(void) { do { a += 1; } while (b); } }
int arr[] = { 1, 2 };
unsigned long baz (void) __attribute__((noinline)) { return 1; }
'''


def test_functions_and_lines():
    got = list(by_tokens(SOURCE))
    assert [(n, a, b) for n, _, a, b in got] == [("foo", 8, 15), ("bar", 16, 16), ("baz", 18, 18)]
    assert got[0][1].startswith("static inline int *foo") and got[0][1].endswith("}")


def test_pattern_finds_no_keywords():
    code = "int f(int a)\n{\n    if (a) {\n        g();\n    }\n    for (;;) {\n    }\n    return 1;\n}\n\nint h(void) { return 2; }\n"
    assert [(n, a, b) for n, _, a, b in by_pattern(code)] == [("f", 1, 9), ("h", 11, 11)]


@pytest.mark.parametrize("code", ["", "   ", "int proto(void);", "int f(int a) {", "{ } }", "#define X {", '"unclosed', "/* open", "'", "struct s { int x; } y;", "typedef int (*fp)(void);", "int (*table[])(void) = { a, b };", "enum e { A, B };"])
def test_nothing_to_find(code):
    assert list(by_tokens(code)) == []


def test_old_shapes():
    assert [f.name for f in functions("int *\nfoo(a)\n{ }\nstruct s bar(void) { }\nint main() { { } { } }")] == ["foo", "bar", "main"]
    assert [f.name for f in functions("int a(void) { }\r\nint b(void)\r\n{\r\n}\r\n")] == ["a", "b"]


def test_matching_brace():
    code = 'x { "}" /* } */ { } \'}\' }'
    assert matching_brace(code, 2) == len(code) - 1
    assert matching_brace("a { b", 2) == 2
    assert matching_brace('f { "\\\\" }', 2) == 9  # an escaped backslash ends the literal


def test_shape():
    s = shape(next(by_tokens(SOURCE))[1])
    assert s.counts == {"assignment": 1, "declaration": 3, "call": 1, "return": 1, "if": 2, "for": 1, "while": 1, "do": 0, "switch": 0, "goto": 1, "break": 0, "continue": 0}
    assert (s.loops, s.branches, s.cyclomatic) == (2, 2, 1 + 2 + 1 + 1 + 1 + 1)
    t = shape("int f(int a) { switch (a) { case 1: a = 2; break; case 2: { continue; } default: return 0; } do { a++; } while (a || b); }")
    assert (t.counts["switch"], t.counts["do"], t.counts["while"], t.counts["break"], t.counts["assignment"], t.cyclomatic) == (1, 1, 0, 1, 1, 1 + 3 + 1 + 1)


def test_feature_range():
    f = ast_features(SOURCE)
    assert len(f) == 15 and all(0 <= x <= 1 for x in f) and sum(f[: len(COUNTED)]) == pytest.approx(1)
    assert sum(ast_features("")[: len(COUNTED)]) == 0 and ast_features(None)[-1] == 1 / 20
    ast_features("} } ) ( { if else while ( case :" * 50)


def test_rows(spark):
    df = spark.createDataFrame([("a.c", SOURCE), ("b.c", None), ("c.c", "int x;")], "file_path string, content string")
    got = extract_functions(df)
    assert sorted((r["function_name"], r["start_line"]) for r in got.collect()) == [("bar", 16), ("baz", 18), ("foo", 8)]
    assert [tuple(r) for r in functions_per_file(got).collect()] == [("a.c", 3)]
