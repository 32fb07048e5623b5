"""Sessions with the settings that the library is tested under, and shipping of the package to executors."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that are worth a task where each is matched, tokenized or parsed; rows of a task at most.
TASK_ROWS, MOST_TASK_ROWS = 512, 8192

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session; on a cluster, use the session that it gives."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("fnatlas")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of our own, in local mode only."""
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


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="fnatlas-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = f"{folder}/fnatlas_{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent).as_posix())
    before = list(sys.path)
    spark.sparkContext.addPyFile(target)
    sys.path[:] = before


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df by a hash of its key over as many tasks as its rows are worth, whatever files they come in.

    Scans and adaptive plans cut tables by bytes; rows of a few bytes that much is made of would all be in one task.
    """
    n = df.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // MOST_TASK_ROWS))
    return df.repartition(max(1, min(tasks, -(-n // TASK_ROWS))), key)


@functools.cache
def _blas() -> list:
    """The functions of numpy's own OpenBLAS that set and get its number of threads; none if numpy has another library."""
    import numpy as np

    for path in sorted(Path(np.__file__).resolve().parents[1].glob("numpy.libs/*openblas*")):
        lib = ctypes.CDLL(str(path))
        for form in ("scipy_openblas_{}_num_threads64_", "scipy_openblas_{}_num_threads", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
            if hasattr(lib, form.format("set")) and hasattr(lib, form.format("get")):
                return [getattr(lib, form.format("set")), getattr(lib, form.format("get"))]
    return []


def blas_threads(n: int) -> int:
    """Sets how many threads a matrix product takes in this process; the number before. Small products only wait for each other."""
    if not _blas():
        return n
    set_threads, get_threads = _blas()
    before = get_threads()
    set_threads(n)
    return before
