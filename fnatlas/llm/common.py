"""What the operators of this subpackage share: stored tables, shipping, row keys, word rules."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the runs between these characters (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bytes and rows that Python workers get at once; long texts then come in small batches.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000
#: Rows up to which a small side may be broadcast; its count is always taken first.
BROADCAST_ROWS = 500_000

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="fnatlas-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of this application's own, which goes when the driver ends."""
    app = spark.sparkContext.applicationId
    top = f"{shared_dir(spark)}/fnatlas-{app}"
    if f"top-{app}" not in _OWN:
        _OWN[f"top-{app}"] = top
        atexit.register(_swept, spark, top)
    return f"{top}/{uuid.uuid4().hex}-{name}"


def _swept(spark: SparkSession, top: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        delete(spark, top)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fnatlas_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Removes tables of stored() that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._fnatlas_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Sends this package to the executors' Python workers, once for each application, and bounds their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = f"ship-{spark.sparkContext.applicationId}"
    if app in _OWN:
        return
    top = Path(__file__).resolve().parents[1]
    _OWN[app] = tempfile.mkdtemp(prefix="fnatlas-zip-")
    atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    target = f"{_OWN[app]}/fnatlas_{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent).as_posix())
    before = list(sys.path)
    spark.sparkContext.addPyFile(target)
    sys.path[:] = before


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; else Catalyst joins by shuffle."""
    return F.broadcast(df) if rows <= most else df


#: Parts into which the rows of one key are dealt where a key may hold a large share of them.
SALTS = 32


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has few rows of each value of key, where left may have many of one value.

    left's rows are dealt to SALTS parts of each value by a hash of the column `by`; right goes to the parts that occur.
    """
    l = left.withColumn("_fn_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    parts = l.select(key, "_fn_salt").filter(F.col(key).isNotNull()).distinct()  # at most SALTS rows of a value
    return l.join(parts.join(right, key), [key, "_fn_salt"], how).drop("_fn_salt")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the key columns."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out
