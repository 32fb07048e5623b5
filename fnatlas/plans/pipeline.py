"""The whole pipeline over a source tree, and inference on single files."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.embedders import NO_PURPOSE, with_embeddings
from ..functions.features import feature_vector
from ..operators import evaluation as E
from ..operators import gridsearch, joint
from ..operators import learning as M
from ..operators import similarity as S
from ..operators.clustering import Clusterings
from ..operators.extract import extract_functions, with_ast_features
from ..operators.mlp import Perceptron
from ..sources import trees


LOG = logging.getLogger(__name__)


def labeled(functions_df: DataFrame) -> DataFrame:
    return functions_df.withColumn("labels", L.label_struct(F.col("function_name"), F.col("function_code")))


#: What a language model is asked; the labels' names are fixed values.
PROMPT = """Read the C function below and answer with one JSON object and nothing else. Its fields:
- "high_level_purpose": one sentence on what the function does
- "side_effects": an array of those that apply of "io", "memory", "hardware", "network", "global_state"; ["none"] if none does
- "complexity": "low" (under 20 lines, few branches), "medium" (20 to 50 lines, some branches or loops) or "high" (over 50 lines, nested)
- "error_handling": "returns_code", "uses_errno", "assertions" or "none"

Function:
"""
PROMPT_CODE = 4000  # characters of a function that are sent: the limit is the model's, rules read whole functions


def prompt(code: Column) -> Column:
    return F.concat(F.lit(PROMPT), F.substring(F.coalesce(code, F.lit("")), 1, PROMPT_CODE), F.lit("\n"))


def labeled_by(functions_df: DataFrame, ask=None, connect=None) -> DataFrame:
    """Labels from a model: `ask` maps a pandas Series of prompts to answers; `connect` gives such a function.

    Without them, or if connect fails, rules label. A batch whose call fails has the defaults of answers that can't be read.
    """
    if ask is None and connect is not None:
        try:
            ask = connect()
        except Exception:  # noqa: BLE001  whatever keeps a client from starting
            ask = None
    if ask is None:
        return labeled(functions_df)

    def answers(prompts: pd.Series) -> pd.Series:
        try:
            return ask(prompts)
        except Exception:  # noqa: BLE001  a service's failure must not end the job
            return pd.Series([None] * len(prompts), index=prompts.index, dtype=object)

    got = F.coalesce(F.pandas_udf(answers, "string")(prompt(F.col("function_code"))), F.lit(""))
    return functions_df.withColumn("labels", L.parse_llm_labels(got, F.col("function_code")))


def featured(df: DataFrame, hardware: bool = False, ast: bool = True, embedder: str = "hashed") -> DataFrame:
    """df with embeddings of code and purpose, hybrid and structure features; each computed once."""
    out = with_embeddings(df.withColumn("purpose", F.col("labels.high_level_purpose")), "function_code", "purpose", embedder)
    out = out.withColumn("hybrid_features", feature_vector(F.col("function_code"), hardware))
    return with_ast_features(out) if ast else out


@dataclass
class Assembly:
    """How rows become feature vectors: the columns, means and deviations of those that are scaled, and a projection."""

    parts: list[str]
    scaling: dict[str, dict[str, list[float]]]
    pca: object = None

    @staticmethod
    def fitted(train: DataFrame, pca_dims: int | None = None) -> Assembly:
        scaled = [c for c in ("hybrid_features", "ast_features") if c in train.columns]
        parts = ["embedding", *scaled] + ["purpose_embedding"] * ("purpose_embedding" in train.columns)
        return Assembly(parts, {c: M.scaling(train, c) for c in scaled}, M.pca_fitted(train, "embedding", pca_dims) if pca_dims else None)

    def __call__(self, df: DataFrame) -> DataFrame:
        """df with `features`: the embedding or its projection, scaled hybrid and structure features, the purpose's embedding."""
        out = M.pca_applied(self.pca, df, "embedding", "_pca") if self.pca else df
        of = lambda c: M.scaled_by(F.col(c), self.scaling[c]) if c in self.scaling else F.col("_pca" if c == "embedding" and self.pca else c)
        return out.withColumn("features", M.concatenated(*map(of, self.parts))).drop("_pca")


def assembled(df: DataFrame, train: DataFrame, pca_dims: int | None = None) -> DataFrame:
    return Assembly.fitted(train, pca_dims)(df)


LABELS = ("effects", "complexity", "errors")
#: Percent of the training rows that thresholds are tuned on.
VALIDATION = 20


@dataclass(frozen=True)
class Options:
    """Options of the models, by the kind that has them."""

    c: float = 1.0  # lr, svm: the inverse of the penalty, over the sum of weights
    max_iter: int = 100  # lr
    grid: tuple[float, ...] = ()  # lr: values of c to choose from for each label, by cross-validation; none is c itself
    kernel: str = "rbf"  # svm
    gamma: str | float = "scale"
    cosines: int = M.COSINES
    trees: int = 100  # rf
    max_depth: int | None = 20  # none is as deep as can be
    min_leaf: int = 1
    layers: tuple[int, ...] = (256, 128)  # mlp
    learning_rate: float = 1e-3
    max_rounds: int = 500
    early_stopping: bool = True

    def of(self, kind: str, rows: int) -> dict:
        """What train_single() takes for a kind, on so many rows."""
        if kind == "svm":
            return {"kernel": self.kernel, "gamma": self.gamma, "cosines": self.cosines, "reg": 1 / (self.c * max(1, rows))}
        return {"trees": self.trees, "max_depth": self.max_depth, "min_leaf": self.min_leaf} if kind == "rf" else {}


def _chosen(train: DataFrame, held: Column, label: str, names: list[str], balanced: bool, o: Options) -> float:
    """The c of a label's regressions."""
    if len(o.grid) < 2 or not names:
        return o.grid[0] if o.grid else o.c
    rows = train.filter(~held) if label == "effects" else train
    best = gridsearch.searched(rows, "fn_id", "features", label, names, [gridsearch.Point(c, balanced) for c in o.grid], label != "effects", max_iter=o.max_iter, refit=False).best.c
    LOG.info("%s: c %s of %s", label, best, o.grid)
    return best


def _fits(train: DataFrame, held: Column, kinds: dict[str, str], classes: dict[str, list[str]], balanced: bool, o: Options) -> tuple[dict[str, joint.JointLogistic | Perceptron], dict[str, float]]:
    """The models of labels whose kind is lr, fitted together, and those whose kind is mlp; the c of the former. Effects aren't fitted to the rows held."""
    heads = [joint.Head(x, names, x != "effects", ~held if x == "effects" else None, _chosen(train, held, x, names, balanced, o)) for x, names in classes.items() if kinds[x] == "lr"]
    out: dict = dict(zip([h.column for h in heads], joint.fitted(train, "features", heads, o.c, balanced, o.max_iter), strict=True)) if heads else {}
    for x, names in classes.items():
        if kinds[x] == "mlp" and names:
            rows = train.filter(~held) if x == "effects" else train
            out[x] = Perceptron.fitted(rows, "features", x, names, x != "effects", o.layers, o.learning_rate, max_rounds=o.max_rounds, early_stopping=o.early_stopping and x != "effects")
    return out, {h.column: h.c for h in heads}


def run(
    spark: SparkSession, source: str, out: str, hardware: bool = False, kind: str | dict[str, str] = "lr", pca_dims: int | None = None, embedder: str = "hashed", skip_labeling: bool = False,
    skip_embedding: bool = False, ast: bool = True, tune: bool = True, strategy: str = "binary", balanced: bool = True, clusters: int = 4, threshold: float = 0.8, connect=None, glob: str = "*.c", clean: bool = False,
    options: Options | None = None, test_percent: int = 30, conflicts_of: int | None = None,
) -> DataFrame:
    """Extracts, labels, embeds, trains, clusters, stores and evaluates; stage tables in `out` can be entered again. The report row.

    kind: of the classifiers (lr, svm, rf, mlp), or one for each of effects, complexity and errors; options: of these models; tune:
    thresholds of the effects' probabilities, on rows that they aren't fitted to (not of svm and mlp); strategy: of effects, see
    train_multilabel(); clusters: at most; threshold: from which similar functions with other effects are conflicts; conflicts_of: only of
    the first so many functions by key; test_percent: of the rows, by a digest of their key; connect: see labeled_by(); clean: rare
    effects go, high complexity is merged.
    """
    o = options or Options()
    kinds = {label: kind if isinstance(kind, str) else kind.get(label, "lr") for label in LABELS}
    if not (skip_labeling or skip_embedding):
        functions_df = extract_functions(trees.read_tree(spark, source, glob))
        keyed = functions_df.withColumn("fn_id", F.xxhash64("file_path", "start_line", "function_name"))
        labeled_by(keyed, connect=connect).write.mode("overwrite").parquet(f"{out}/labeled")
    if not skip_embedding:
        rows = spark.read.parquet(f"{out}/labeled")
        if rows.isEmpty():
            raise ValueError(f"no functions in {source}")
        rows = trees.clean_labels(rows, f"{out}/cleaned").drop("changed") if clean else rows
        featured(rows, hardware, ast, embedder).withColumn("split", M.hash_split(F.col("fn_id"), test_percent)).write.mode("overwrite").parquet(f"{out}/featured")
    df = spark.read.parquet(f"{out}/featured")
    assembly = Assembly.fitted(df.filter("split = 'train'"), pca_dims)
    df = assembly(df).withColumn("effects", F.col("labels.side_effects")).withColumn("complexity", F.col("labels.complexity")).withColumn("errors", F.col("labels.error_handling"))
    df.write.mode("overwrite").parquet(f"{out}/assembled")  # every fit reads vectors, and none computes them again
    df = spark.read.parquet(f"{out}/assembled")
    train = df.filter("split = 'train'")
    # thresholds are tuned on rows that the effects' models aren't fitted to
    held = F.pmod(F.xxhash64("fn_id", F.lit("validation")), F.lit(100)) < VALIDATION if tune and kinds["effects"] in ("lr", "rf") else F.lit(False)
    singles_of = {c: M.classes_of(train.select(F.array(c).alias(c)), c) for c in ("complexity", "errors")}
    constant = {c: names[0] for c, names in singles_of.items() if len(names) < 2}
    classes = {"effects": M.trainable(train.filter(~held), "effects", strategy)} | {x: names for x, names in singles_of.items() if x not in constant}
    fits, chosen = _fits(train, held, kinds, classes, balanced, o)
    n = train.count()
    models = {} if "effects" in fits else M.train_multilabel(train.filter(~held), "features", "effects", kinds["effects"], balanced=balanced, strategy=strategy, **o.of(kinds["effects"], n))
    thresholds = {}
    if tune and kinds["effects"] in ("lr", "rf"):
        checked = train.filter(held)
        thresholds = fits["effects"].tuned(checked, "features", "effects") if "effects" in fits else M.tuned_thresholds(models, checked, "features", "effects")
    singles = {x: M.train_single(train, "features", x, kinds[x], balanced, **o.of(kinds[x], n)) for x in singles_of if x not in fits and x not in constant}
    if "effects" in fits:
        predicted = _effects(fits["effects"], df, thresholds)
    else:
        predicted = M.predict_multilabel(models, df, "features", "none", "predicted_effects", thresholds)
    k = M.adaptive_k(df.count(), clusters)
    centres = Clusterings.fitted(df, "fn_id", "features", [k]) if k else None
    clustered = centres.assigned(predicted, "features", "_fn_c").withColumn("cluster", F.get("_fn_c", F.lit(0))).drop("_fn_c") if k else predicted.withColumn("cluster", F.lit(0))
    config = {
        "embedder": embedder, "hardware": hardware, "ast": ast, "kinds": kinds, "pca_dims": pca_dims, "effect_classes": sorted(fits["effects"].classes if "effects" in fits else models), "joint": {x: m.as_dict() for x, m in fits.items()}, "c": chosen,
        "singles": sorted(singles), "constant": constant,
        "thresholds": thresholds, "no_purpose": NO_PURPOSE, "parts": assembly.parts, "scaling": assembly.scaling,
    }
    version = trees.save_pipeline(clustered, config, f"{out}/pipeline", {f"effect_{c}": m for c, m in models.items()} | singles | ({"pca": assembly.pca} if assembly.pca else {}))
    saved = spark.read.parquet(f"{version}/functions")
    test = saved.filter("split = 'test'").select(F.col("effects").alias("y_true"), F.col("predicted_effects").alias("y_pred"))
    vectors = saved.select(F.col("fn_id").alias("id"), S.unit(F.col("embedding")).alias("v")).persist()  # the searches go through them several times
    tags = saved.select(F.col("fn_id").alias("id"), F.col("effects").alias("tags"))
    different = S.copies(vectors, 3).persist()
    near = S.top_k(vectors.orderBy("id").limit(conflicts_of), vectors, 3) if conflicts_of else S.top_k_of_all(vectors, different, 3)
    near = near.persist()  # the report takes conflicts twice
    conflicts = S.conflicting(near, tags, threshold).filter("q < c" if conflicts_of is None else "true").select("q", "c", "sim")
    overlap = S.overlap_at_k(S.top_k(E.hashed_sample(vectors, "id"), vectors, 5), tags)
    predicted = saved.withColumnsRenamed({"effects": "y_true", "predicted_effects": "y_pred"})
    wrong = E.misclassified(predicted, "function_code", "fn_id").select("function_name", "file_path", "y_true", "y_pred", "text_length", "split")
    result = E.report(test, overlap, E.label_purity(saved, "cluster", "effects"), wrong, conflicts=conflicts, sizes=E.failure_sizes(predicted, "function_code"))
    result.write.mode("overwrite").json(f"{out}/report")
    for kept in (near, different, vectors):
        kept.unpersist()
    return spark.read.schema(result.schema).json(f"{out}/report")


def _effects(model: joint.JointLogistic | Perceptron, df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """df with predicted_effects."""
    if isinstance(model, Perceptron):
        return model.predicted(df, "features", "predicted_effects", "none")
    return model.predicted(df, "features", "none", "predicted_effects", thresholds)


class Predictor:
    """A stored pipeline: labels functions that it hasn't seen, and finds the stored ones that are like them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        got = trees.load_pipeline(spark, folder)
        if got is None:
            raise FileNotFoundError(f"no pipeline in {folder}")
        self.rows, self.config, self.models = got
        self.assembly = Assembly(self.config["parts"], self.config["scaling"], self.models.get("pca"))

    def features(self, functions_df: DataFrame) -> DataFrame:
        """functions with the vectors that the models take, assembled as in training; a function's name gives its purpose."""
        purpose = F.struct(L.purpose(F.col("function_name")).alias("high_level_purpose")).alias("labels")
        keep = [c for c in functions_df.columns if c != "features"]  # labels and vectors that they have stay theirs
        d = functions_df.select("function_name", "function_code", purpose, F.struct(*keep).alias("_given"))
        d = self.assembly(featured(d, self.config["hardware"], self.config["ast"], self.config["embedder"]))
        return d.select(*[F.col(f"_given.`{c}`") for c in keep], "features")

    def predicted(self, functions_df: DataFrame) -> DataFrame:
        """functions (function_name, function_code) with predicted_effects, predicted_complexity and predicted_errors."""
        d, keep = self.features(functions_df), functions_df.columns
        fits = {x: (Perceptron if m.get("kind") == "mlp" else joint.JointLogistic).of_dict(m) for x, m in self.config.get("joint", {}).items()}
        if "effects" in fits:
            d = _effects(fits["effects"], d, self.config["thresholds"])
        else:
            models = {c: self.models[f"effect_{c}"] for c in self.config["effect_classes"]}
            d = M.predict_multilabel(models, d, "features", "none", "predicted_effects", self.config["thresholds"])
        for c in ("complexity", "errors"):
            if c in fits:
                d = fits[c].predicted(d, "features", f"predicted_{c}") if isinstance(fits[c], Perceptron) else fits[c].chosen(d, "features", f"predicted_{c}")
            elif c in self.config["singles"]:
                d = M.predict_single(self.models[c], d, "features", f"predicted_{c}")
            else:
                d = d.withColumn(f"predicted_{c}", F.lit(self.config["constant"][c]))
        return d.select(*keep, "predicted_effects", "predicted_complexity", "predicted_errors")

    def __call__(self, functions_df: DataFrame) -> DataFrame:
        """functions of files with `labels`, for analyzed(); the purpose is that of the most similar stored function."""
        keyed = functions_df.withColumn("fn_id", F.xxhash64("file_path", "start_line", "function_name"))
        corpus = self.rows.select("fn_id", "embedding", F.col("labels.high_level_purpose").alias("purpose"))
        d = with_neighbour_summary(self.predicted(keyed), corpus, self.config["embedder"])
        labels = F.struct(
            F.col("summary").alias("high_level_purpose"), L.control_flow(F.col("function_code")).alias("control_flow_elements"), F.col("predicted_effects").alias("side_effects"),
            F.col("predicted_complexity").alias("complexity"), F.col("predicted_errors").alias("error_handling"),
        )
        return d.select(*functions_df.columns, labels.alias("labels"))

    def scores(self, labeled_df: DataFrame) -> DataFrame:
        """f1_macro, f1_micro and accuracy of the effects of labelled functions from outside."""
        d = self.predicted(labeled_df).select(F.col("labels.side_effects").alias("y_true"), F.col("predicted_effects").alias("y_pred"))
        return E.summary_scores(d)

    def alike(self, key: int | None = None, k: int = 3) -> DataFrame:
        """The k stored functions most similar to one, the first by key if none is given."""
        key = self.rows.agg(F.min("fn_id")).first()[0] if key is None else key
        return S.similar_to_row(self.rows, key, k, "fn_id").select("fn_id", "function_name", "file_path", F.col("labels.high_level_purpose").alias("purpose"), "sim")


def predictor(spark: SparkSession, folder: str):
    """What labels functions: a stored pipeline, or the rules where there is none or it can't be loaded."""
    try:
        return Predictor(spark, folder)
    except FileNotFoundError:
        return labeled
    except Exception:  # noqa: BLE001  whatever is wrong with its files
        LOG.warning("the pipeline in %s can't be loaded; rules label", folder, exc_info=True)
        return labeled


#: Functions that the demonstration predicts.
SNIPPETS = (
    ("read_line", 'int read_line(FILE *f, char *buf, int n) {\n    if (!fgets(buf, n, f)) { perror("read"); return -1; }\n    return 0;\n}'),
    ("make_node", "struct node *make_node(int v) {\n    struct node *p = malloc(sizeof(*p));\n    if (p == NULL) { return NULL; }\n    p->v = v;\n    return p;\n}"),
    ("add", "int add(int a, int b) {\n    return a + b;\n}"),
)


def demo(spark: SparkSession, folder: str) -> DataFrame:
    """What a stored pipeline can do: the functions most like its first one, and the labels of a few functions."""
    p = Predictor(spark, folder)
    near = p.alike().select(F.lit("similar").alias("what"), F.col("function_name").alias("name"), F.format_string("%.4f %s", "sim", "purpose").alias("text"))
    some = p.predicted(spark.createDataFrame(list(SNIPPETS), "function_name string, function_code string"))
    text = F.concat_ws("; ", F.array_join("predicted_effects", ","), "predicted_complexity", "predicted_errors")
    return near.unionByName(some.select(F.lit("predicted").alias("what"), F.col("function_name").alias("name"), text.alias("text")))


def analyzed(files: DataFrame, predict=None) -> DataFrame:
    """file_path, functions, warning for each file: rules' labels, or what predict(functions) adds as `labels`."""
    fns = extract_functions(files)
    rows = (predict or labeled)(fns)
    one = F.struct(F.col("start_line"), F.col("function_name").alias("name"), F.col("end_line"), F.col("labels.high_level_purpose").alias("embedding_summary"), F.col("labels").alias("predicted_labels"))
    per = rows.groupBy("file_path").agg(F.array_sort(F.collect_list(one)).alias("functions"))
    j = files.select("file_path").join(per, "file_path", "left")
    return j.select("file_path", F.coalesce("functions", F.array().cast(per.schema["functions"].dataType)).alias("functions"), F.when(F.col("functions").isNull(), "No functions found").alias("warning"))


def with_neighbour_summary(functions_df: DataFrame, corpus: DataFrame, embedder: str = "hashed") -> DataFrame:
    """functions (fn_id, function_code) with the purpose of the corpus's most similar function. corpus: fn_id, embedding, purpose."""
    q = with_embeddings(functions_df, "function_code", None, embedder).select((-F.abs("fn_id") - 1).alias("id"), S.unit(F.col("embedding")).alias("v"))
    near = S.top_k(q, corpus.select(F.col("fn_id").alias("id"), S.unit(F.col("embedding")).alias("v")), 1)
    s = S.neighbour_summary(near, corpus.select(F.col("fn_id").alias("id"), F.col("purpose").alias("text")))
    return functions_df.join(s, (-F.abs(functions_df["fn_id"]) - 1) == s["q"], "left").drop("q")
