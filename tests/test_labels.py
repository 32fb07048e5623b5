"""Column expressions against Python's re on the same strings, and the rules' edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from fnatlas.functions import features as X
from fnatlas.functions import labels as L
from fnatlas.functions import patterns as P

CODES = [
    "int f(void) { return -1; }", "static int g(int a, char *b)\n{\n  if (!b) { return NULL; }\n  for (;;) while (a) { a--; }\n  return 0;\n}", "void h() { p = malloc(sizeof(int)); free(p); }",
    "int k(struct s *x) { x->regs = 1; volatile int *q = x->reg_base; writel(BIT(3) | 0x1F, x->base); return x.y[2]; }", "void n() { socket(1); inet_pton(a, b); g_total++; s_x = 2; }",
    "int e(void) { errno = 0; perror(x); assert(y); return 0; /* fatal error */ }", "int r() { return 0;\nerror(); }", "", "no braces at all", "{{{}}}}", "int probe(struct platform_device *d) { devm_kzalloc(d); request_irq(1); spin_lock(l); }",
    "int foo_probe(int x) { __asm__(y); if (unlikely(x)) { } }", "switch (a) { case 1: goto out; default: break; } out: RETURN(1); iff; returning", "FILE *f = fopen(a); fprintf(f, b); puts(c); printf(d);", "é int ünï(void) { return café; } // PRINTF free",
]


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame(list(enumerate(CODES)), "id int, code string").repartition(2)


def values(codes, column):
    return [r[0] for r in codes.orderBy("id").select(column).collect()]


def test_control_flow(codes):
    assert values(codes, L.control_flow(F.col("code"))) == [[k for k in P.CONTROL_FLOW if re.search(rf"\b{k}\b", c)] for c in CODES]


def test_side_effects(codes):
    want = []
    for c in CODES:
        got = sorted(k for k, ps in P.EFFECT_PATTERNS.items() if any(re.search(p, c, re.I) for p in ps))
        want.append(got or ["none"])
    assert values(codes, L.side_effects(F.col("code"))) == want


def test_error_handling(codes):
    want = [next((k for k, ps in P.ERROR_PATTERNS.items() if any(re.search(p, c, re.I) for p in ps)), "none") for c in CODES]
    assert values(codes, L.error_handling(F.col("code"))) == want


def depth(c):
    d = m = 0
    for ch in c:
        d += (ch == "{") - (ch == "}")
        m = max(m, d)
    return m


def test_depth_and_complexity(codes):
    assert values(codes, L.brace_depth(F.col("code"))) == [depth(c) for c in CODES]
    want = []
    for c in CODES:
        lines, kinds = len(c.split("\n")), sum(bool(re.search(rf"\b{k}\b", c)) for k in P.CONTROL_FLOW)
        s = (2 if lines > 50 else lines > 20) + (2 if kinds >= 4 else kinds >= 2) + (2 if depth(c) >= 4 else depth(c) >= 3)
        want.append("high" if s >= 4 else "medium" if s >= 2 else "low")
    assert values(codes, L.complexity(F.col("code"))) == want


def test_purpose(spark):
    names = ["initDevice", "get_value", "offset", "target", "setMode", "read_all", "writeBlock", "free_list", "destroyAll", "cleanup", "create_node", "allocPage", "doWork", "HTTPServer"]
    want = ["Initializes device", "Retrieves value", "Sets off", "Retrieves tar", "Sets mode", "Reads all", "Writes block", "Cleans up or frees free list", "Cleans up or frees destroy all", "Cleans up or frees cleanup", "Allocates or creates create node", "Allocates or creates alloc page", "Performs do work operation", "Performs httpserver operation"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    assert [r[0] for r in df.orderBy("id").select(L.purpose(F.col("name"))).collect()] == want


def test_features_against_re(codes):
    cols = X.base_features(F.col("code")) | X.hardware_features(F.col("code"))
    got = [r.asDict() for r in codes.orderBy("id").select(*[c.alias(n) for n, c in cols.items()]).collect()]
    assert list(cols) == X.feature_names(True) and len(cols) == 40
    for c, g in zip(CODES, got, strict=True):
        assert all(0 <= v <= 1 for v in g.values())
        for name, pats, cap in (*P.BASE_GROUPS, *P.HARDWARE_GROUPS):
            k = sum(bool(re.search(p, c)) for p in pats)
            assert g[f"{name}_count_norm"] == pytest.approx(min(k / cap, 1)) and g[f"{name}_present"] == float(k > 0)
        assert g["func_calls_norm"] == pytest.approx(min(len(re.findall(P.FUNC_CALL, c)) / 20, 1))
        assert g["pointer_ops_norm"] == pytest.approx(min(len(re.findall(P.POINTER, c)) / 10, 1))
        assert g["has_array_access"] == float(bool(re.search(P.HAS_ARRAY, c)))
        assert g["bitwise_density"] == pytest.approx(min(sum(len(re.findall(p, c)) for p in P.BITWISE) / 8, 1))
    assert got[10]["is_driver_lifecycle"] == 1 and got[11]["is_driver_lifecycle"] == 0
    assert [g["param_count_norm"] for g in got[:3]] == [0, pytest.approx(0.4), 0]
    assert not any(len({g[n] for g in got}) < 2 for n in ("memory_present", "io_present", "mmio_present", "devm_present", "has_inline_asm", "has_compiler_attr", "has_device_struct"))


def test_label_arrays(spark):
    df = spark.createDataFrame([(["assertions", "io"],), (["network"],), (["none"],), (["memory", "io"],)], "e array<string>")
    assert [r[0] for r in df.select(L.without_rare(F.col("e"))).collect()] == [["io"], ["none"], ["none"], ["memory", "io"]]
    assert [r[0] for r in df.select(L.primary_effect(F.col("e"))).collect()] == ["assertions", "network", "none", "memory"]


def test_model_answers(spark):
    answers = ['{"high_level_purpose": "A", "side_effects": ["io"], "complexity": "low", "error_handling": "none"}', '```json\n{"high_level_purpose": "B"}\n```', "sorry", None, "", "[1]", '{"side_effects": null}']
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "id int, a string").orderBy("id")
    got = [r[0] for r in df.select(L.parse_llm_labels(F.col("a"), F.lit("if (x) return;"))).collect()]
    assert [g["high_level_purpose"] for g in got] == ["A", "B", "Unknown", "Unknown", "Unknown", "Unknown", "Unknown"]
    assert [g["side_effects"] for g in got] == [["io"]] + [["none"]] * 6
    assert {g["complexity"] for g in got[1:]} == {"medium"} and all(g["control_flow_elements"] == ["if", "return"] for g in got)


def test_literal_codes_and_labels(spark):
    """Inputs and outputs written out, so that the lists can't drift with the tests that are made from them."""
    rows = [
        ("read_line", 'int read_line(FILE *f) {\n  if (!fgets(buf, 9, f)) { perror("x"); return -1; }\n  return 0;\n}', ["if", "return"], ["io"], "low", "returns_code", "Reads line"),
        ("make_node", "struct n *make_node(int v) {\n  struct n *p = malloc(8);\n  g_count++;\n  return p;\n}", ["return"], ["global_state", "memory"], "low", "none", "Performs make node operation"),
        ("sendAll", "int sendAll(int s) {\n  while (n) { for (;;) { switch (n) { case 1: goto out; } } }\n  send(s, b, n, 0);\n  errno = 0;\nout:\n  return n;\n}", ["for", "while", "switch", "goto", "return"], ["network"], "high", "uses_errno", "Performs send all operation"),
        ("initIrq", "static inline void initIrq(void) {\n  writel(1, dev->regs);\n  BUG_ON(x);\n}", [], ["hardware"], "low", "assertions", "Initializes irq"),
        ("add", "int add(int a, int b) { return a + b; }", ["return"], ["none"], "low", "none", "Performs add operation"),
        ("free_buffer", "void free_buffer(char *b) { KFREE(b); free_it(b); }", [], ["memory"], "low", "none", "Cleans up or frees free buffer"),
        ("notes", "// reprintf, mallocs, xsocket and rebind are no calls", [], ["none"], "low", "none", "Performs notes operation"),
    ]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "function_name string, function_code string")
    got = {r["function_name"]: r["l"] for r in df.select("function_name", L.label_struct(F.col("function_name"), F.col("function_code")).alias("l")).collect()}
    for name, _, flow, effects, cx, errors, purpose in rows:
        l = got[name]
        assert (name, l["control_flow_elements"], l["side_effects"], l["complexity"], l["error_handling"], l["high_level_purpose"]) == (name, flow, effects, cx, errors, purpose)


def test_names_tried_together_match_as_alone():
    import random
    import re

    r = random.Random(1)
    lists = [*P.EFFECT_PATTERNS.values(), *P.ERROR_PATTERNS.values(), P.MEMORY, P.IO, P.SYNC, P.REGMAP]
    words = [w for v in lists for p in v for w in re.findall(r"\w{3,}", p)]
    for v in lists:
        one, many = re.compile(P.any_of(v)), [re.compile(p) for p in v]
        for _ in range(2000):
            t = r.choice(["", "x", "_", " "]) + r.choice(words) + r.choice(["", " (", "(", "_x", " ", "1"]) + r.choice(["", ";", "x"])
            assert bool(one.search(t)) == any(m.search(t) for m in many)


def test_plain_text_has_the_labels_of_its_code(spark):
    odd = ["e\u00e4tern", "ext\u00e9rn", "extern\u00e9", "\u00a0extern\u3000", "\u0131f", "\u0130f if\u00df", "if\u2014for", "mem\u017fet", "\u212afree", "\u212amalloc \u212aMALLOC", "as\u017fert", "kmalloc", "\u212aMALLOC(", "g\u00e4x", "g_\u00e4", "return \u00e4 error",
           "return\u20030\u00b7 error", "return -1\u0661", "return\u2003-1", "static\u00a0int\u00a0x\u0308 =", "volatile\u2028u32 *", "pr\u0131ntf", "PR\u0130NTF(", "while\u0301", "goto\u200d", "\U0001f600for\U00010400", "a\u0085\nb\u2028c\n", "{\u00e4{\u2014}", "\u4f60if\u597d", "return\u1680NULL", "r->regs[0]", "Inet_aton x", "BUG_ON(x)", "Volatile int *p", "STATIC int y =", "s_\u00df", "a\u00e4 s_\u00e4 ="]
    rows = [(x,) for x in odd] + [(f"{a} {b}\n{c}",) for a, b, c in zip(odd, odd[5:] + odd[:5], odd[11:] + odd[:11], strict=True)]
    d = spark.createDataFrame(rows, "code string").withColumn("plain", L.plain(F.col("code"))).withColumn("low", F.lower("plain"))
    of = lambda c, low: F.struct(L.line_count(F.col(c)), L.control_flow(F.col(c)), L.side_effects(F.col(low), low == "low"), L.complexity(F.col(c)), L.error_handling(F.col(low), low == "low"), L.brace_depth(F.col(c)))
    for r in d.select("code", "plain", of("code", "code").alias("a"), of("plain", "low").alias("b")).collect():
        assert r["plain"].isascii() and tuple(r["a"]) == tuple(r["b"]), r["code"]
