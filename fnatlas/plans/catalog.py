"""Registered queries of the engine's own operators, and their SQL oracles for DuckDB, generated from the same fixed values."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import labels as L
from ..functions import patterns as P
from ..functions.embedders import with_embeddings
from ..functions.sql import register as register_sql
from ..functions.vectors import doubles
from ..operators import evaluation as E
from ..operators import forest
from ..operators import learning as M
from ..operators import similarity as S
from ..operators import gridsearch as G
from ..operators.extract import extract_functions, function_totals, functions_per_file, with_ast_features
from ..operators.joint import JointLogistic
from ..operators.mlp import Perceptron
from ..operators.sampling import oversampled
from ..session import dealt
from . import derived as D
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _from_part(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    view = f"part_{zlib.crc32(sf.encode()):08x}"
    dealt(table(spark, sf, "part").select("p_partkey"), "p_partkey").createOrReplaceTempView(view)
    return spark.sql(sql.replace("FROM part", f"FROM {view}"))


def c_functions(spark: SparkSession, sf: str) -> DataFrame:
    return _from_part(spark, sf, D.C_FUNCTIONS)


def c_files(spark: SparkSession, sf: str) -> DataFrame:
    return _from_part(spark, sf, D.C_FILES_SPARK)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def units(spark: SparkSession, sf: str) -> DataFrame:
    return S.unit_vectors(vectors(spark, sf))


def nearest(spark: SparkSession, sf: str, k: int) -> DataFrame:
    u = units(spark, sf)
    return S.top_k(u, u, k, digits=6)


def doc_tags(spark: SparkSession, sf: str) -> DataFrame:
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "lang")
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"), F.col("lang")))
    return l.join(d, "doc_id").select("doc_id", F.array_sort(tags).alias("tags"))


def one_nn(spark: SparkSession, sf: str, near: DataFrame | None = None) -> DataFrame:
    """vec_id, label, predicted: by the label of the nearest other vector; near: neighbours, if they are there already."""
    v = vectors(spark, sf).select("vec_id", "label")
    n = (near.filter("rank = 1") if near is not None else nearest(spark, sf, 1)).select(F.col("q").alias("vec_id"), "c")
    p = v.select(F.col("vec_id").alias("c"), F.col("label").alias("predicted"))
    return v.join(n, "vec_id").join(p, "c").select("vec_id", "label", "predicted")


def centroid_scores(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, class, score, truth: cosine to each class's centroid; there are as many rows as vectors times classes."""
    v = vectors(spark, sf).select("vec_id", "label", doubles(F.col("embedding")).alias("v"))
    d = v.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    c = d.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))
    c = c.agg(F.collect_list(F.struct("label", "centroid")).alias("centroids"))  # one row of a closed label domain
    from ..functions.vectors import cosine

    j = v.crossJoin(F.broadcast(c)).withColumn("one", F.explode("centroids"))
    return j.select("vec_id", F.col("one.label").alias("class"), F.round(cosine(F.col("v"), F.col("one.centroid")), 6).alias("score"), (F.col("label") == F.col("one.label")).alias("truth"))


# ---------------------------------------------------------------- SQL pieces

_UNITS = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS nrm FROM e),
sims AS (SELECT a.vec_id AS q, b.vec_id AS c, round(coalesce(list_dot_product(a.v, b.v) / nullif(a.nrm * b.nrm, 0), 0), 6) AS sim, a.label AS ql, b.label AS cl FROM u a JOIN u b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rank FROM sims)
"""
_FNS = f"f AS ({D.C_FUNCTIONS})"


def _sql_any(code: str, pats: list[str], ignore: bool = False) -> str:
    return f"regexp_matches({code}, '{'(?i)' if ignore else ''}{P.any_of(pats)}')"


def _sql_hits(code: str, pats: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({code}, '{p}') AS INT)" for p in pats) + ")"


def _sql_count(code: str, pat: str) -> str:
    return f"len(regexp_extract_all({code}, '{pat}'))"


_CF = "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(function_code, '\b{k}\b') THEN '{k}' END" for k in P.CONTROL_FLOW) + "], lambda x: x IS NOT NULL)"
_SE_RAW = "list_filter([" + ", ".join(f"CASE WHEN {_sql_any('function_code', p, True)} THEN '{k}' END" for k, p in sorted(P.EFFECT_PATTERNS.items())) + "], lambda x: x IS NOT NULL)"
_SE = f"CASE WHEN len({_SE_RAW}) = 0 THEN ['none'] ELSE {_SE_RAW} END"
_EH = "CASE " + " ".join(f"WHEN {_sql_any('function_code', p, True)} THEN '{k}'" for k, p in P.ERROR_PATTERNS.items()) + " ELSE 'none' END"
_WORDS = r"lower(replace(regexp_replace(function_name, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' '))"
_PURPOSE = (
    "CASE " + " ".join(f"WHEN contains({_WORDS}, '{k}') THEN '{v} ' || trim(replace({_WORDS}, '{k}', ''))" for k, v in P.PURPOSE_VERBS)
    + f" WHEN regexp_matches({_WORDS}, '{'|'.join(P.PURPOSE_FREE)}') THEN 'Cleans up or frees ' || {_WORDS} WHEN regexp_matches({_WORDS}, '{'|'.join(P.PURPOSE_ALLOC)}') THEN 'Allocates or creates ' || {_WORDS}"
    + f" ELSE 'Performs ' || {_WORDS} || ' operation' END"
)
_DEPTH = """depths AS (
  SELECT fn_id, max(d) AS depth FROM (
    SELECT fn_id, sum(CASE ch WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY fn_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS d
    FROM (SELECT fn_id, unnest(regexp_extract_all(function_code, '[{}]')) AS ch, unnest(range(1, len(regexp_extract_all(function_code, '[{}]')) + 1)) AS i FROM f))
  GROUP BY fn_id)"""
_LINES = "(length(function_code) - length(replace(function_code, chr(10), '')) + 1)"
_SCORE = f"(CASE WHEN {_LINES} > 50 THEN 2 WHEN {_LINES} > 20 THEN 1 ELSE 0 END + CASE WHEN len({_CF}) >= 4 THEN 2 WHEN len({_CF}) >= 2 THEN 1 ELSE 0 END + CASE WHEN depth >= 4 THEN 2 WHEN depth >= 3 THEN 1 ELSE 0 END)"
_CX = f"CASE WHEN {_SCORE} >= 4 THEN 'high' WHEN {_SCORE} >= 2 THEN 'medium' ELSE 'low' END"
_LABELED = f"{_FNS}, {_DEPTH}, lab AS (SELECT f.fn_id, function_name, function_code, file_path, {_PURPOSE} AS purpose, {_CF} AS flow, {_SE} AS effects, {_CX} AS complexity, {_EH} AS errors FROM f JOIN depths USING (fn_id))"


# ---------------------------------------------------------------- similarity


@query(f"WITH {_UNITS} SELECT ql AS label, round(avg(o), 6) AS overlap, count(*) AS n FROM (SELECT q, ql, avg(CASE WHEN ql = cl THEN 1.0 ELSE 0.0 END) AS o FROM ranked WHERE rank <= 5 GROUP BY q, ql) GROUP BY ql")
def knn_overlap_at_k(spark, sf):
    """The flagship: neighbours of every vector, and how much their labels agree, by label."""
    labels = vectors(spark, sf).select(F.col("vec_id").alias("id"), F.array(F.col("label").cast("string")).alias("tags"), "label")
    o = S.overlap_at_k(nearest(spark, sf, 5), labels)
    return o.join(labels.select(F.col("id").alias("q"), "label"), "q").groupBy("label").agg(F.round(F.avg("overlap"), 6).alias("overlap"), F.count("*").alias("n"))


@query(f"WITH {_UNITS} SELECT q, c, sim, rank FROM ranked WHERE rank <= 5")
def knn_top5(spark, sf):
    return nearest(spark, sf, 5).select("q", "c", "sim", "rank")


@query(f"WITH {_UNITS} SELECT c AS vec_id, sim FROM sims WHERE q = 7 ORDER BY sim DESC, c LIMIT 5")
def knn_single_query(spark, sf):
    return S.similar_to_row(vectors(spark, sf), 7, 5).select("vec_id", F.round("sim", 6).alias("sim"))


@query(f"WITH {_UNITS} SELECT q, c, sim FROM sims WHERE q < c ORDER BY sim DESC, q, c LIMIT 5")
def top_pairs(spark, sf):
    u = units(spark, sf)
    return S.top_k(u, u, 5, pairs_once=True, digits=6).select("q", "c", "sim")


@query(f"WITH {_UNITS} SELECT q, coalesce(d.text, 'Unknown purpose') AS summary FROM ranked LEFT JOIN documents d ON d.doc_id = c WHERE rank = 1")
def nn_summary(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return S.neighbour_summary(nearest(spark, sf, 1), texts)


@query(f"WITH {_UNITS} SELECT q, c, sim FROM ranked WHERE rank <= 3 AND sim > 0.35 AND ql <> cl")
def conflicting_neighbors(spark, sf):
    labels = vectors(spark, sf).select(F.col("vec_id").alias("id"), F.array(F.col("label").cast("string")).alias("tags"))
    return S.conflicting(nearest(spark, sf, 3), labels, 0.35).select("q", "c", "sim")


# ---------------------------------------------------------------- labels


@query(f"WITH {_FNS} SELECT fn_id, array_to_string({_CF}, ',') AS flow FROM f")
def control_flow_elements(spark, sf):
    return c_functions(spark, sf).select("fn_id", F.array_join(L.control_flow(F.col("function_code")), ",").alias("flow"))


@query(f"WITH {_FNS} SELECT value, count(*) AS n FROM (SELECT unnest({_CF}) AS value FROM f) GROUP BY value")
def control_flow_distribution(spark, sf):
    return E.distribution(c_functions(spark, sf).select(L.control_flow(F.col("function_code")).alias("x")), "x")


@query(f"WITH {_FNS} SELECT fn_id, array_to_string({_SE}, ',') AS effects FROM f")
def side_effects(spark, sf):
    return c_functions(spark, sf).select("fn_id", F.array_join(L.side_effects(F.col("function_code")), ",").alias("effects"))


def _effects(spark, sf):
    return c_functions(spark, sf).select("fn_id", L.side_effects(F.col("function_code")).alias("effects"))


@query(f"WITH {_FNS} SELECT value, count(*) AS n FROM (SELECT unnest({_SE}) AS value FROM f) GROUP BY value")
def side_effect_distribution(spark, sf):
    return E.distribution(_effects(spark, sf), "effects")


@query(f"WITH {_FNS} SELECT array_to_string({_SE}, '+') AS combination, count(*) AS n FROM f GROUP BY 1")
def effect_combos(spark, sf):
    return E.combinations(_effects(spark, sf), "effects")


@query(f"WITH {_FNS}, {_DEPTH} SELECT fn_id, CAST(depth AS INT) AS depth FROM depths")
def brace_depth(spark, sf):
    return c_functions(spark, sf).select("fn_id", L.brace_depth(F.col("function_code")).alias("depth"))


@query(f"WITH {_LABELED} SELECT fn_id, complexity FROM lab")
def complexity(spark, sf):
    return c_functions(spark, sf).select("fn_id", L.complexity(F.col("function_code")).alias("complexity"))


@query(f"WITH {_LABELED} SELECT complexity, count(*) AS n FROM lab GROUP BY 1")
def complexity_distribution(spark, sf):
    return complexity(spark, sf).groupBy("complexity").agg(F.count("*").alias("n"))


@query(f"WITH {_FNS} SELECT fn_id, {_EH} AS errors FROM f")
def error_handling(spark, sf):
    return c_functions(spark, sf).select("fn_id", L.error_handling(F.col("function_code")).alias("errors"))


@query(f"WITH {_FNS} SELECT fn_id, {_PURPOSE} AS purpose FROM f")
def purpose_text(spark, sf):
    return c_functions(spark, sf).select("fn_id", L.purpose(F.col("function_name")).alias("purpose"))


@query(f"WITH {_LABELED} SELECT fn_id, purpose, array_to_string(flow, ',') AS flow, array_to_string(effects, ',') AS effects, complexity, errors FROM lab")
def label_all(spark, sf):
    l = F.col("labels")
    d = pipeline.labeled(c_functions(spark, sf))
    return d.select("fn_id", l.high_level_purpose.alias("purpose"), F.array_join(l.control_flow_elements, ",").alias("flow"), F.array_join(l.side_effects, ",").alias("effects"), l.complexity.alias("complexity"), l.error_handling.alias("errors"))


_KEPT = "list_filter(effects, lambda x: x NOT IN ('assertions', 'network'))"


@query(f"WITH {_LABELED}, k AS (SELECT fn_id, effects, CASE WHEN len({_KEPT}) = 0 THEN ['none'] ELSE {_KEPT} END AS cleaned FROM lab) SELECT fn_id, array_to_string(cleaned, ',') AS cleaned, array_to_string(effects, ',') <> array_to_string(cleaned, ',') AS changed FROM k")
def clean_rare_labels(spark, sf):
    e = _effects(spark, sf).withColumn("k", L.without_rare(F.col("effects")))
    return e.select("fn_id", F.array_join("k", ",").alias("cleaned"), (F.array_sort("effects") != F.array_sort("k")).alias("changed"))


@query(f"WITH {_LABELED} SELECT CASE WHEN complexity = 'high' THEN 'medium' ELSE complexity END AS merged, count(*) AS n, CAST(sum(CASE WHEN complexity = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS n_changed FROM lab GROUP BY 1")
def merge_complexity(spark, sf):
    c = complexity(spark, sf)
    return c.groupBy(L.merged_complexity(F.col("complexity")).alias("merged")).agg(F.count("*").alias("n"), F.count_if(F.col("complexity") == "high").alias("n_changed"))


@query(f"WITH {_LABELED} SELECT fn_id, coalesce(list_filter(effects, lambda x: x <> 'none')[1], 'none') AS primary_effect FROM lab")
def primary_effect(spark, sf):
    return _effects(spark, sf).select("fn_id", L.primary_effect(F.col("effects")).alias("primary_effect"))


_LLM = """CASE CAST(p_partkey % 5 AS INT)
 WHEN 0 THEN '{"high_level_purpose": "Part ' || p_partkey || '", "side_effects": ["io", "memory"], "complexity": "low", "error_handling": "none"}'
 WHEN 1 THEN '```json' || chr(10) || '{"high_level_purpose": "Fenced", "side_effects": ["network"], "complexity": "high"}' || chr(10) || '```'
 WHEN 2 THEN 'no json here' WHEN 3 THEN '```' || chr(10) || '{"high_level_purpose": "Plain"}' || chr(10) || '```' ELSE '{"side_effects": []}' END"""


@query("""SELECT CAST(p_partkey AS BIGINT) AS fn_id,
 CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'Part ' || p_partkey WHEN 1 THEN 'Fenced' WHEN 3 THEN 'Plain' ELSE 'Unknown' END AS purpose,
 CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'io,memory' WHEN 1 THEN 'network' WHEN 4 THEN '' ELSE 'none' END AS effects,
 CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS complexity FROM part""")
def parse_llm_json(spark, sf):
    a = _from_part(spark, sf, f"SELECT CAST(p_partkey AS BIGINT) AS fn_id, {_LLM} AS answer FROM part")
    g = a.select("fn_id", L.parse_llm_labels(F.col("answer"), F.lit("")).alias("g"))
    return g.select("fn_id", F.col("g.high_level_purpose").alias("purpose"), F.array_join("g.side_effects", ",").alias("effects"), F.col("g.complexity").alias("complexity"))


@query(f"WITH {_LABELED} SELECT fn_id, array_to_string(flow, ',') AS flow, array_to_string(effects, ',') AS effects, complexity, errors FROM lab")
def labels_in_sql(spark, sf):
    """Labels by the functions that are registered for SQL."""
    register_sql(spark)
    view = f"fns_{zlib.crc32(sf.encode()):08x}"
    c_functions(spark, sf).createOrReplaceTempView(view)
    return spark.sql(f"SELECT fn_id, array_join(c_control_flow(function_code), ',') AS flow, array_join(c_side_effects(function_code), ',') AS effects, c_complexity(function_code) AS complexity, c_error_handling(function_code) AS errors FROM {view}")


# ---------------------------------------------------------------- features


def _sql_features(hardware: bool) -> str:
    code, cols = "function_code", []
    cap = lambda x, n: f"least({x} / {float(n)}, 1.0)"
    flag = lambda x: f"CAST(CAST({x} AS INT) AS DOUBLE)"
    groups = P.HARDWARE_GROUPS if hardware else P.BASE_GROUPS
    for name, pats, n in groups:
        h = _sql_hits(code, pats)
        cols += [(f"{name}_count_norm", cap(h, n)), (f"{name}_present", flag(f"{h} > 0"))]
    if hardware:
        cols += [(f"{n}_present", flag(_sql_any(code, p))) for n, p in P.PRESENT_GROUPS]
        cols.append(("bitwise_density", cap("(" + " + ".join(_sql_count(code, p) for p in P.BITWISE) + ")", 8)))
        head = f"CASE WHEN strpos({code}, '{{') > 0 THEN substr({code}, 1, strpos({code}, '{{') - 1) ELSE substr({code}, 1, 200) END"
        cols.append(("is_driver_lifecycle", flag(f"regexp_matches({head}, '{P.LIFECYCLE}')")))
        cols += [(n, flag(_sql_any(code, p))) for n, p in (("has_device_struct", P.DEVICE_STRUCT), ("has_module_macro", P.MODULE_MACRO), ("has_inline_asm", P.INLINE_ASM), ("has_compiler_attr", P.COMPILER_ATTR))]
    else:
        params = f"regexp_extract({code}, '{P.PARAMETERS}')"
        count = f"CASE WHEN {params} = '' OR contains({params}, '(void)') OR contains({params}, '()') THEN 0 ELSE length({params}) - length(replace({params}, ',', '')) + 1 END"
        cols += [("lines_norm", cap(_LINES, 50)), ("func_calls_norm", cap(_sql_count(code, P.FUNC_CALL), 20)), ("control_flow_norm", cap(_sql_count(code, P.CONTROL), 10)), ("pointer_ops_norm", cap(_sql_count(code, P.POINTER), 10))]
        cols += [("param_count_norm", cap(f"({count})", 5)), ("return_count_norm", cap(_sql_count(code, P.RETURN), 5))]
        cols += [(n, flag(f"regexp_matches({code}, '{p}')")) for n, p in (("has_null", P.HAS_NULL), ("has_sizeof", P.HAS_SIZEOF), ("has_struct_access", P.HAS_STRUCT), ("has_array_access", P.HAS_ARRAY))]
    return f"WITH {_FNS} SELECT fn_id, " + ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {n}" for n, x in cols) + " FROM f"


@query(_sql_features(False))
def features_base20(spark, sf):
    cols = X.base_features(F.col("function_code"))
    return c_functions(spark, sf).select("fn_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query(_sql_features(True))
def features_hw20(spark, sf):
    cols = X.hardware_features(F.col("function_code"))
    return c_functions(spark, sf).select("fn_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query()
def ast_features(spark, sf):
    from ..functions.ctokens import AST_NAMES

    d = with_ast_features(c_functions(spark, sf))
    return d.select("fn_id", *[F.round(F.get("ast_features", F.lit(i)), 6).alias(n) for i, n in enumerate(AST_NAMES)])


#: What each statement of the derived functions adds, counted by hand: modulus, remainder, calls, ifs, returns, decisions, loop depth, branch depth.
_ADDS = (
    (7, 2, 1, 0, 0, 0, 0, 0), (11, 3, 1, 0, 0, 0, 0, 0), (13, 4, 1, 0, 0, 0, 0, 0), (13, 5, 1, 0, 0, 0, 0, 0), (13, 6, 1, 0, 0, 0, 0, 0), (17, 1, 2, 0, 0, 0, 0, 0),
    (17, 2, 1, 0, 0, 0, 0, 0), (17, 4, 2, 0, 0, 0, 0, 0), (17, 5, 1, 0, 0, 0, 0, 0), (17, 6, 1, 0, 0, 0, 0, 0), (17, 7, 2, 0, 0, 0, 0, 0), (17, 8, 3, 0, 0, 0, 0, 0),
    (17, 9, 2, 0, 0, 0, 0, 0), (17, 10, 1, 0, 0, 0, 0, 0), (17, 11, 1, 0, 0, 0, 0, 0), (17, 12, 2, 0, 0, 0, 0, 0), (17, 13, 1, 0, 0, 0, 0, 0), (17, 14, 1, 0, 0, 0, 0, 0),
    (17, 15, 1, 0, 0, 0, 0, 0), (17, 16, 1, 1, 0, 1, 0, 1), (19, 1, 2, 0, 0, 0, 0, 0), (19, 2, 1, 0, 0, 0, 0, 0), (19, 5, 1, 0, 0, 0, 0, 0), (19, 6, 1, 0, 0, 0, 0, 0), (19, 7, 1, 0, 0, 0, 0, 0),
    (23, 1, 0, 0, 0, 1, 1, 0), (23, 2, 0, 0, 0, 1, 1, 0), (23, 3, 0, 2, 0, 4, 2, 2), (23, 4, 0, 0, 0, 3, 0, 1), (23, 5, 0, 0, 0, 2, 1, 0), (23, 6, 0, 2, 0, 2, 0, 2),
    (29, 1, 0, 1, 1, 1, 0, 1), (29, 2, 0, 1, 1, 1, 0, 1), (29, 3, 0, 1, 1, 1, 0, 1), (29, 6, 0, 0, 1, 0, 0, 0), (29, 8, 1, 0, 0, 0, 0, 0), (29, 9, 2, 0, 0, 0, 0, 0),
)


def _added(column: int, join: str = " + ", first: str = "0") -> str:
    parts = [f"CASE WHEN p_partkey % {a[0]} = {a[1]} THEN {a[column]} ELSE 0 END" for a in _ADDS if a[column]]
    return join.join([first, *parts])


@query(f"""SELECT CAST(p_partkey AS BIGINT) AS fn_id, CAST({_added(2)} AS INT) AS n_calls, CAST({_added(3)} AS INT) AS n_ifs, CAST({_added(4)} + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS n_returns,
 CAST({_added(5, first="1")} AS INT) AS cyclomatic, CAST(greatest({_added(6, ", ")}) AS INT) AS loop_depth, CAST(greatest({_added(7, ", ")}) AS INT) AS branch_depth FROM part""")
def ast_counts(spark, sf):
    from ..operators.extract import with_shape

    d = with_shape(c_functions(spark, sf))
    return d.select("fn_id", *[F.col(f"shape.{c}").alias(c) for c in ("n_calls", "n_ifs", "n_returns", "cyclomatic", "loop_depth", "branch_depth")])


@query()
def hashed_embedding(spark, sf):
    d = with_embeddings(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x, 6).cast("string")), ",").alias("embedding"))


# ---------------------------------------------------------------- extraction

_LINE_COUNT = "(length(function_code) - length(replace(function_code, chr(10), '')) + 1)"
_PLACED = f"placed AS (SELECT *, {D.HEADER_LINES} + 1 + coalesce(sum({_LINE_COUNT} + 1) OVER (PARTITION BY file_path ORDER BY fn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM f)"


@query(f"WITH {_FNS}, {_PLACED} SELECT function_name, function_code, file_path, CAST(first AS INT) AS start_line, CAST(first + {_LINE_COUNT} - 1 AS INT) AS end_line FROM placed", "extract_functions")
def extract_functions_tokens(spark, sf):
    return extract_functions(c_files(spark, sf))


@query(f"WITH {_FNS}, {_PLACED} SELECT function_name, function_code, file_path, CAST(first AS INT) AS start_line, CAST(first + {_LINE_COUNT} - 1 AS INT) AS end_line FROM placed")
def extract_functions_pattern(spark, sf):
    return extract_functions(c_files(spark, sf), "pattern")


@query(f"WITH {_FNS}, {_PLACED} SELECT function_name, function_code, file_path, CAST(first AS INT) AS start_line, CAST(first + {_LINE_COUNT} - 1 AS INT) AS end_line FROM placed")
def functions_in_sql(spark, sf):
    """Extraction by the table function that is registered for SQL."""
    register_sql(spark)
    view = f"files_{zlib.crc32(sf.encode()):08x}"
    c_files(spark, sf).createOrReplaceTempView(view)
    return spark.sql(f"SELECT t.function_name, t.function_code, f.file_path, t.start_line, t.end_line FROM {view} f, LATERAL c_functions(f.content) t")


@query(f"WITH {_FNS} SELECT file_path, count(*) AS n_functions FROM f GROUP BY file_path", "functions_per_file")
def functions_by_file(spark, sf):
    return functions_per_file(extract_functions(c_files(spark, sf)))


@query(f"WITH {_FNS} SELECT count(*) AS n_functions, count(DISTINCT file_path) AS n_files FROM f")
def function_counts(spark, sf):
    return function_totals(extract_functions(c_files(spark, sf)))


@query()
def analyze_file(spark, sf):
    a = pipeline.analyzed(c_files(spark, sf))
    return a.select("file_path", F.size("functions").alias("n_functions"), F.to_json("functions").alias("functions"), "warning")


# ---------------------------------------------------------------- lengths


@query("SELECT min(length(text)) AS min_len, max(length(text)) AS max_len, round(avg(length(text)), 6) AS mean_len, round(quantile_cont(length(text), 0.5), 6) AS median_len, round(quantile_cont(length(text), 0.25), 6) AS p25_len FROM documents")
def text_length_stats(spark, sf):
    s = E.length_stats(table(spark, sf, "documents"), "text")
    return s.select(F.col("min_len").cast("long").alias("min_len"), F.col("max_len").cast("long").alias("max_len"), *[F.round(c, 6).alias(c) for c in ("mean_len", "median_len", "p25_len")])


@query(f"WITH {_FNS} SELECT min(length(function_code)) AS min_len, max(length(function_code)) AS max_len, round(avg(length(function_code)), 6) AS mean_len, round(quantile_cont(length(function_code), 0.5), 6) AS median_len, round(quantile_cont(length(function_code), 0.25), 6) AS p25_len FROM f")
def code_length_stats(spark, sf):
    s = E.length_stats(c_functions(spark, sf), "function_code")
    return s.select(F.col("min_len").cast("long").alias("min_len"), F.col("max_len").cast("long").alias("max_len"), *[F.round(c, 6).alias(c) for c in ("mean_len", "median_len", "p25_len")])


@query("WITH n AS (SELECT CAST(length(text) AS DOUBLE) AS x FROM documents), b AS (SELECT min(x) AS lo, max(x) AS hi FROM n) SELECT CAST(least(19, floor((x - lo) * 20 / (hi - lo))) AS INT) AS bin, count(*) AS n FROM n, b GROUP BY 1")
def length_histogram(spark, sf):
    return E.histogram(table(spark, sf, "documents"), F.length("text"), 20)


@query(f"WITH {_FNS} SELECT fn_id, function_name, length(function_code) AS len FROM f WHERE length(function_code) < (SELECT quantile_cont(length(function_code), 0.25) FROM f) ORDER BY fn_id LIMIT 10")
def short_functions(spark, sf):
    return E.short_rows(c_functions(spark, sf), "function_code", "fn_id").select("fn_id", "function_name", F.length("function_code").cast("long").alias("len"))


# ---------------------------------------------------------------- metrics

_ONE = f"WITH {_UNITS}, p AS (SELECT q AS vec_id, ql AS label, cl AS predicted FROM ranked WHERE rank = 1)"
_REPORT = """
, cls AS (SELECT DISTINCT c FROM (SELECT label AS c FROM p UNION ALL SELECT predicted FROM p)),
cnt AS (SELECT CAST(c AS VARCHAR) AS class, CAST(sum(CASE WHEN label = c AND predicted = c THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN label <> c AND predicted = c THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN label = c AND predicted <> c THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM p, cls GROUP BY c),
per AS (SELECT class, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, CAST(tp + fn AS BIGINT) AS support FROM cnt)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per
UNION ALL SELECT 'micro avg', round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6), round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6), round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 6), CAST(sum(tp + fn) AS BIGINT) FROM cnt
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'samples avg', round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6), round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6), round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6), count(*) FROM p
"""


def _sets(spark, sf, near=None):
    return one_nn(spark, sf, near).select("vec_id", F.array(F.col("label").cast("string")).alias("y_true"), F.array(F.col("predicted").cast("string")).alias("y_pred"))


@query(_ONE + _REPORT)
def classification_report(spark, sf):
    r = E.classification_report(_sets(spark, sf))
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


@query(_ONE + " SELECT round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM p")
def subset_accuracy(spark, sf):
    return E.subset_accuracy(_sets(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"), "n")


@query(_ONE + " SELECT vec_id, label, predicted, length(text) AS text_length FROM p JOIN documents d ON d.doc_id = p.vec_id WHERE label <> predicted ORDER BY length(text), vec_id LIMIT 5")
def misclassified_shortest(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    r = E.misclassified(_sets(spark, sf).join(d, "vec_id"), "text", "vec_id")
    return r.select("vec_id", F.get("y_true", F.lit(0)).cast("int").alias("label"), F.get("y_pred", F.lit(0)).cast("int").alias("predicted"), F.col("text_length").cast("long").alias("text_length"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM e),
m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY label, pos),
c AS (SELECT label, list(m ORDER BY pos) AS cen FROM m GROUP BY label),
s AS (SELECT c.label AS class, e.label = c.label AS truth, round(list_dot_product(v, cen) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(cen, cen))), 6) AS score FROM e, c),
g AS (SELECT class, truth, score, t / 10.0 AS threshold FROM s, range(1, 10) r(t)),
f AS (SELECT class, CAST(threshold AS DOUBLE) AS threshold, coalesce(2.0 * sum(CASE WHEN score >= threshold AND truth THEN 1 ELSE 0 END) / nullif(2.0 * sum(CASE WHEN score >= threshold AND truth THEN 1 ELSE 0 END) + sum(CASE WHEN score >= threshold AND NOT truth THEN 1 ELSE 0 END) + sum(CASE WHEN score < threshold AND truth THEN 1 ELSE 0 END), 0), 0) AS f1 FROM g GROUP BY class, threshold),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f1 DESC, threshold) AS k FROM f)
SELECT class, CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END AS threshold, round(f1, 6) AS f1 FROM r WHERE k = 1""")
def threshold_search(spark, sf):
    return E.threshold_search(centroid_scores(spark, sf)).select("class", "threshold", F.round("f1", 6).alias("f1"))


@query("SELECT lang, count(*) AS n, round(CAST((SELECT count(*) FROM documents) AS DOUBLE) / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight FROM documents GROUP BY lang")
def class_weights(spark, sf):
    return M.class_weights(table(spark, sf, "documents"), "lang").select("lang", "n", F.round("weight", 6).alias("weight"))


@query(f"WITH t AS ({D.DOC_TAGS}), x AS (SELECT doc_id, string_split(tag_text, ',') AS tags FROM t) SELECT doc_id, " + ", ".join(f"CAST(list_contains(tags, '{c}') AS INT) AS is_{c}" for c in ("de", "en", "es", "fr", "quality", "toxic")) + " FROM x")
def label_binarize(spark, sf):
    t = doc_tags(spark, sf)
    return M.binarised(t, "tags", M.classes_of(t, "tags")).drop("tags")


@query("""WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings),
s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM x GROUP BY pos)
SELECT vec_id, CAST(pos AS INT) AS pos, round((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END, 6) + 0.0 AS z FROM x JOIN s USING (pos)""")
def standard_scale(spark, sf):
    d = M.standard_scaled(vectors(spark, sf), "embedding")
    return d.select("vec_id", F.posexplode("scaled").alias("pos", "z")).select("vec_id", "pos", (F.round("z", 6) + 0.0).alias("z"))


@query(f"WITH {_FNS}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT fn_id, CAST(len(v) + 1 AS INT) AS dims, round(list_sum(v) + length(function_code), 6) AS total FROM f JOIN e ON e.vec_id = f.fn_id")
def feature_concat(spark, sf):
    j = c_functions(spark, sf).join(vectors(spark, sf), F.col("fn_id") == F.col("vec_id"))
    j = j.withColumn("all", M.concatenated(F.col("embedding"), F.array(F.length("function_code").cast("double"))))
    return j.select("fn_id", F.size("all").alias("dims"), F.round(F.aggregate("all", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT vec_id, CASE WHEN vec_id % 10 < 3 THEN 'test' ELSE 'train' END AS split FROM embeddings")
def modulo_split(spark, sf):
    return vectors(spark, sf).select("vec_id", M.modulo_split(F.col("vec_id")).alias("split"))


_DIGEST = "md5(CAST({} AS VARCHAR) || '-42')"


@query(f"SELECT vec_id, CASE WHEN CAST('0x' || substr({_DIGEST.format('vec_id')}, 1, 8) AS BIGINT) % 100 < 30 THEN 'test' ELSE 'train' END AS split FROM embeddings")
def hash_split(spark, sf):
    return vectors(spark, sf).select("vec_id", M.hash_split(F.col("vec_id")).alias("split"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, label, other, avg(dist) AS m FROM d GROUP BY vec_id, label, other),
s AS (SELECT vec_id, max(CASE WHEN label = other THEN m END) AS a, min(CASE WHEN label <> other THEN m END) AS b FROM m GROUP BY vec_id)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM s""")
def silhouette(spark, sf):
    return E.silhouette(vectors(spark, sf), "vec_id", "embedding", "label").select(F.round("silhouette", 6).alias("silhouette"), "n")


_TAGS = f"WITH t AS ({D.DOC_TAGS}), g AS (SELECT e.label AS cluster, list_sort(string_split(tag_text, ',')) AS tags FROM t JOIN embeddings e ON e.vec_id = t.doc_id)"


def _clustered(spark, sf):
    return doc_tags(spark, sf).join(vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster")), "doc_id")


@query(_TAGS + ", c AS (SELECT cluster, array_to_string(tags, '+') AS combo, count(*) AS k FROM g GROUP BY 1, 2) SELECT cluster, CAST(sum(k) AS BIGINT) AS n, round(max(k) / CAST(sum(k) AS DOUBLE), 6) AS purity FROM c GROUP BY cluster")
def label_purity(spark, sf):
    return E.label_purity(_clustered(spark, sf), "cluster", "tags").select("cluster", "n", F.round("purity", 6).alias("purity"))


@query(_TAGS + " SELECT cluster, value, count(*) AS n FROM (SELECT cluster, unnest(tags) AS value FROM g) GROUP BY 1, 2")
def cluster_profile(spark, sf):
    return E.cluster_profile(_clustered(spark, sf), "cluster", "tags")


@query(f"WITH {_UNITS}, p AS (SELECT q, CASE WHEN q % 10 < 3 THEN 'test' ELSE 'train' END AS split, CASE WHEN ql = cl THEN 1.0 ELSE 0.0 END AS ok FROM ranked WHERE rank = 1), a AS (SELECT avg(CASE WHEN split = 'train' THEN ok END) AS tr, avg(CASE WHEN split = 'test' THEN ok END) AS te FROM p) SELECT round(tr, 6) AS train_score, round(te, 6) AS test_score, CASE WHEN tr - te > 0.15 THEN 'OVERFITTING' WHEN tr - te < -0.05 THEN 'UNDERFITTING' ELSE 'OK' END AS status FROM a")
def overfit_status(spark, sf):
    p = one_nn(spark, sf).select(M.modulo_split(F.col("vec_id")).alias("split"), (F.col("label") == F.col("predicted")).cast("double").alias("ok"))
    a = p.agg(F.avg(F.when(F.col("split") == "train", F.col("ok"))).alias("tr"), F.avg(F.when(F.col("split") == "test", F.col("ok"))).alias("te"))
    return a.select(F.round("tr", 6).alias("train_score"), F.round("te", 6).alias("test_score"), E.overfit_status(F.col("tr"), F.col("te")).alias("status"))


@query(_ONE.replace("p AS (", "p0 AS (") + """, p AS (SELECT *, CASE WHEN vec_id % 10 < 3 THEN 'test' ELSE 'train' END AS split FROM p0),
cls AS (SELECT DISTINCT split, c FROM (SELECT split, label AS c FROM p UNION ALL SELECT split, predicted FROM p)),
cnt AS (SELECT p.split, c, 2.0 * sum(CASE WHEN label = c AND predicted = c THEN 1 ELSE 0 END) AS t2, sum(CASE WHEN (label = c) <> (predicted = c) THEN 1 ELSE 0 END) AS miss FROM p JOIN cls ON p.split = cls.split GROUP BY p.split, c),
f AS (SELECT split, avg(coalesce(t2 / nullif(t2 + miss, 0), 0)) AS f1 FROM cnt GROUP BY split)
SELECT f.split, round(f1, 6) AS f1_macro, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM f JOIN p ON p.split = f.split GROUP BY f.split, f1""")
def split_metrics(spark, sf):
    """Macro F1 and accuracy of a single label on the training and the test part."""
    p = E.tallied(_sets(spark, sf).withColumn("split", M.modulo_split(F.col("vec_id"))), "split", "y_true", "y_pred")
    out = None
    for part in ("test", "train"):
        d = p.filter(F.col("split") == part)
        f = E.classification_report(d, n="n").filter("class = 'macro avg'").select(F.lit(part).alias("split"), F.round("f1", 6).alias("f1_macro"))
        f = f.crossJoin(E.subset_accuracy(d, n="n").select(F.round("accuracy", 6).alias("accuracy")))  # one row each
        out = f if out is None else out.unionByName(f)
    return out


@query()
def silhouette_by_k(spark, sf):
    got = M.silhouette_sweep(vectors(spark, sf), "vec_id", "embedding")
    return spark.createDataFrame([(k, round(s, 6), k == M.best_k(got)) for k, s in got], "k int, silhouette double, best boolean")


@query(f"WITH {_UNITS}, s AS (SELECT vec_id FROM embeddings ORDER BY {_DIGEST.format('vec_id')}, vec_id LIMIT 10) SELECT q, round(avg(CASE WHEN ql = cl THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM ranked JOIN s ON s.vec_id = q WHERE rank <= 5 GROUP BY q")
def sampled_overlap(spark, sf):
    """Overlap of ten hashed queries, the way the report samples."""
    u = units(spark, sf)
    labels = vectors(spark, sf).select(F.col("vec_id").alias("id"), F.array(F.col("label").cast("string")).alias("tags"))
    return S.overlap_at_k(S.top_k(E.hashed_sample(u, "id"), u, 5, digits=6), labels).select("q", F.round("overlap", 6).alias("overlap"))


# ---------------------------------------------------------------- models (rows only)


@query()
def kmeans_clusters(spark, sf):
    v = vectors(spark, sf)
    return M.kmeans(v, "embedding", 4, key="vec_id").select("vec_id", "cluster")


@query()
def pca_project(spark, sf):
    d, _ = M.pca_projected(vectors(spark, sf), "embedding", 8)
    return d.select("vec_id", F.array_join(F.transform("pca", lambda x: F.round(F.abs(x), 4).cast("string")), ",").alias("pca"))


def _trained(kind: str, **options) -> Query:
    def run(spark, sf):
        v = vectors(spark, sf).withColumn("label_name", F.col("label").cast("string")).drop("label").withColumn("split", M.modulo_split(F.col("vec_id")))
        if kind == "rf":
            return forest.predicted(v.filter("split = 'train'"), v, "embedding", "label_name", **options).select("vec_id", "split", "label_name", "predicted")
        model = M.train_single(v.filter("split = 'train'"), "embedding", "label_name", kind, **options)
        return M.predict_single(model, v, "embedding").select("vec_id", "split", "label_name", "predicted")

    return run


for _kind in ("lr", "svm", "rf"):
    QUERIES[f"train_{_kind}"] = _trained(_kind)


@query()
def train_mlp(spark, sf):
    v = vectors(spark, sf).withColumn("label_name", F.col("label").cast("string")).drop("label").withColumn("split", M.modulo_split(F.col("vec_id")))
    train = v.filter("split = 'train'")
    model = Perceptron.fitted(train, "embedding", "label_name", M.classes_of(train.select(F.array("label_name").alias("c")), "c"))
    return model.predicted(v, "embedding").select("vec_id", "split", "label_name", "predicted")


@query()
def multilabel_binary(spark, sf):
    t = doc_tags(spark, sf).join(vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    model = JointLogistic.fitted(t, "embedding", "tags", M.trainable(t, "tags"))
    return model.predicted(t, "embedding").select("doc_id", F.array_join("tags", ",").alias("tags"), F.array_join("predicted", ",").alias("predicted"))


GRID = [G.Point(c, balanced) for c in (0.01, 0.1, 1.0, 10.0) for balanced in (True, False)]


@query("""WITH f AS (SELECT (CAST('0x' || substr(md5(vec_id || '-42'), 1, 8) AS BIGINT)) % 3 AS fold FROM embeddings WHERE label IS NOT NULL)
SELECT 'fold ' || fold AS what, count(*) AS n FROM f GROUP BY fold
UNION ALL SELECT 'points in round ' || r, n FROM (VALUES (0, 8), (1, 4), (2, 2)) t(r, n) UNION ALL SELECT 'best points', 1""")
def grid_search(spark, sf):
    """How many rows the folds hold, how many points each round, and that one is best; what is best is tested against separate fits."""
    v = vectors(spark, sf).withColumn("name", F.col("label").cast("string"))
    names = M.classes_of(v.select(F.array("name").alias("c")).filter("name is not null"), "c")
    t = G.searched(v, "vec_id", "embedding", "name", names, GRID, one=True, refit=False).table(spark, GRID)
    folds = t.filter("round = 0").groupBy("fold").agg(F.max("n").alias("n")).select(F.concat(F.lit("fold "), "fold").alias("what"), "n")
    points = t.groupBy("round").agg(F.count_distinct("point").alias("n")).select(F.concat(F.lit("points in round "), "round").alias("what"), "n")
    best = t.filter("best").agg(F.count_distinct("point").alias("n")).select(F.lit("best points").alias("what"), "n")
    return folds.unionByName(points).unionByName(best)


@query("""WITH c AS (SELECT toxic AS class, count(*) AS n FROM labels JOIN embeddings ON vec_id = doc_id GROUP BY 1)
SELECT class, n, (SELECT max(n) FROM c) - n AS n_made, (SELECT max(n) FROM c) - n AS n_between, CAST(0 AS BIGINT) AS n_of_others FROM c""")
def oversampled_classes(spark, sf):
    """Rows of each class, rows made for it, those that stand between their two rows, and those that a row of another class took part in."""
    d = table(spark, sf, "labels").join(vectors(spark, sf).withColumnRenamed("vec_id", "doc_id").drop("label"), "doc_id").select("doc_id", "embedding", F.col("toxic").alias("class"))
    rows = oversampled(d, "doc_id", "embedding", "class")
    one = lambda c: d.select(F.col("doc_id").alias(c), doubles(F.col("embedding")).alias(f"v_{c}"), F.col("class").alias(f"class_{c}"))
    made = rows.filter("made_of is not null").join(one("made_of"), "made_of").join(one("towards"), "towards")
    off = F.aggregate(F.zip_with("embedding", F.zip_with("v_made_of", "v_towards", lambda a, b: a + F.col("share") * (b - a)), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    m = made.groupBy("class").agg(F.count("*").alias("n_made"), F.count_if((off < 1e-9) & F.col("share").between(0, 1)).alias("n_between"), F.count_if((F.col("class_made_of") != F.col("class")) | (F.col("class_towards") != F.col("class"))).alias("n_of_others"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.groupBy("class").agg(F.count("*").alias("n")).join(m, "class", "left").select("class", "n", *map(zero, ("n_made", "n_between", "n_of_others")))


@query()
def evaluation_report(spark, sf):
    near = nearest(spark, sf, 5).persist()  # the search is gone through once; five short rows for each vector
    sets = _sets(spark, sf, near)
    labels = vectors(spark, sf).select(F.col("vec_id").alias("id"), F.array(F.col("label").cast("string")).alias("tags"))
    clusters = E.label_purity(_clustered(spark, sf), "cluster", "tags")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    texts = sets.join(d, "vec_id")
    wrong = E.misclassified(texts, "text", "vec_id").select("vec_id", "y_true", "y_pred", "text_length")
    sizes = E.failure_sizes(sets.join(d, "vec_id", "left"), "text")
    conflicts = S.conflicting(near.filter("rank <= 3"), labels, 0.35).filter("q < c").select("q", "c", "sim")
    r = E.report(sets, S.overlap_at_k(near, labels), clusters, wrong, conflicts=conflicts, sizes=sizes)
    return r.select(F.to_json(F.struct(*r.columns)).alias("report"))


@query()
def stored_pipeline(spark, sf):
    """Trains on the derived functions of nine files in ten, stores the pipeline, loads it and labels those of the others."""
    import atexit
    import contextlib
    import uuid

    from ..session import shared_dir
    from ..sources import trees

    def swept() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            trees.delete(spark, folder)

    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(swept)
    fns = c_functions(spark, sf)
    other = F.crc32(F.col("file_path").cast("binary")) % 10 == 0
    pipeline.labeled(fns.filter(~other)).write.mode("overwrite").parquet(f"{folder}/labeled")
    pipeline.run(spark, "", folder, skip_labeling=True, pca_dims=16)
    p = pipeline.Predictor(spark, f"{folder}/pipeline")
    fns.filter(other).write.parquet(f"{folder}/others")  # what makes a function's code runs once, and not again for features of it
    return p.predicted(spark.read.parquet(f"{folder}/others")).select("fn_id", F.array_join("predicted_effects", ",").alias("effects"), F.col("predicted_complexity").alias("complexity"), F.col("predicted_errors").alias("errors"))
