"""The command line: `run` the whole pipeline over a source tree, `infer` labels of files, show a `demo`.

    python -m fnatlas run path/to/tree out --kind effects=lr complexity=rf --pca-dims 32
    python -m fnatlas infer path/to/tree --pipeline out/pipeline --output analysis
"""

from __future__ import annotations

import argparse
import dataclasses
import logging
import sys

from pyspark.sql import SparkSession

from .plans import pipeline
from .sources import trees


def _kinds(given: list[str]) -> str | dict[str, str]:
    """One kind for all labels, or label=kind for some."""
    plain = [g for g in given if "=" not in g]
    return plain[0] if plain else dict(g.split("=", 1) for g in given)


#: Options of several values, and their type.
LISTS = {"layers": int, "grid": float}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fnatlas", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="extract, label, embed, train, cluster, store and evaluate")
    r.add_argument("source")
    r.add_argument("out")
    r.add_argument("--glob", default="*.c")
    r.add_argument("--kind", nargs="+", default=["lr"], metavar="KIND|LABEL=KIND", help="lr, svm, rf or mlp; labels are effects, complexity, errors")
    r.add_argument("--pca-dims", type=int)
    r.add_argument("--embedder", default="hashed")
    r.add_argument("--strategy", choices=("binary", "columns"), default="binary")
    r.add_argument("--clusters", type=int, default=4)
    r.add_argument("--threshold", type=float, default=0.8, help="from which similarity functions with other effects are conflicts")
    r.add_argument("--conflicts-of", type=int, help="conflicts of the first so many functions only")
    r.add_argument("--test-percent", type=int, default=30)
    for flag in ("hardware", "skip-labeling", "skip-embedding", "clean"):
        r.add_argument(f"--{flag}", action="store_true")
    for flag in ("ast", "tune", "balanced"):
        r.add_argument(f"--no-{flag}", dest=flag, action="store_false")
    r.add_argument("--demo", action="store_true", help="show what the stored pipeline can do")
    for f in dataclasses.fields(pipeline.Options):
        name = f"--{f.name.replace('_', '-')}"
        if f.name in LISTS:
            r.add_argument(name, nargs="+", type=LISTS[f.name], default=list(f.default))
        elif isinstance(f.default, bool):
            r.add_argument(f"--no-{f.name.replace('_', '-')}", dest=f.name, action="store_false")
        elif f.name == "gamma":
            r.add_argument(name, default=f.default, type=lambda x: x if x == "scale" else float(x))
        else:
            r.add_argument(name, default=f.default, type=type(f.default))
    i = sub.add_parser("infer", help="label the functions of files, by a stored pipeline or by rules")
    i.add_argument("source")
    i.add_argument("--glob", default="*.c")
    i.add_argument("--pipeline", help="folder of a stored pipeline; without one, or if it can't be loaded, rules label")
    i.add_argument("--output", help="a folder of JSON lines; else each file's JSON is printed")
    i.add_argument("--compact", action="store_true", help="one line for each file")
    d = sub.add_parser("demo", help="what a stored pipeline can do")
    d.add_argument("pipeline")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; a session that is given stays."""
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, stream=sys.stderr)
    own = spark is None
    spark = spark or SparkSession.builder.appName("fnatlas").getOrCreate()
    try:
        if a.command == "run":
            o = pipeline.Options(**{f.name: tuple(getattr(a, f.name)) if f.name in LISTS else getattr(a, f.name) for f in dataclasses.fields(pipeline.Options)})
            report = pipeline.run(
                spark, a.source, a.out, a.hardware, _kinds(a.kind), a.pca_dims, a.embedder, a.skip_labeling, a.skip_embedding, a.ast, a.tune, a.strategy, a.balanced, a.clusters, a.threshold, glob=a.glob, clean=a.clean,
                options=o, test_percent=a.test_percent, conflicts_of=a.conflicts_of,
            )
            print(report.toJSON().first())
            if a.demo:
                pipeline.demo(spark, f"{a.out}/pipeline").show(20, False)
        elif a.command == "infer":
            predict = pipeline.predictor(spark, a.pipeline) if a.pipeline else None
            found = pipeline.analyzed(trees.read_tree(spark, a.source, a.glob), predict)
            if a.output:
                found.write.mode("overwrite").json(a.output)
                print(f"written to {a.output}", file=sys.stderr)
            else:
                for r in trees.inference_json(found, not a.compact).orderBy("file_path").toLocalIterator():
                    print(r["json"])
        else:
            pipeline.demo(spark, a.pipeline).show(20, False)
    finally:
        if own:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
