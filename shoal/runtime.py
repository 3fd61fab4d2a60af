"""What every operator needs from the session: input tables, shared durable storage, shipped code."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: list[str] = []
#: Tables that ``durable`` wrote and nothing has released: path to the file system's configuration.
_WRITTEN: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark opens the path, so any Hadoop URI works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="shoal-"))
        atexit.register(shutil.rmtree, _LOCAL_DIRS[0], ignore_errors=True)
    return f"file://{_LOCAL_DIRS[0]}"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    The table goes when it is released, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shoal/{tag}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.unregister(_delete_written)
        atexit.register(_delete_written)
    _WRITTEN[path] = spark.sparkContext
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shoal_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote and that nothing reads any more."""
    for t in tables:
        _delete(t.shoal_path)


def _delete(path: str) -> None:
    sc = _WRITTEN.pop(path)
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration() if sc._jsc is None else sc._jsc.hadoopConfiguration()).delete(where, True)


def _delete_written() -> None:
    """At the end of the driver's program: what was not released."""
    for path in list(_WRITTEN):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  # the JVM may be gone; the folder is a scratch folder
            return


#: Rows in an Arrow batch: whole texts can be long, and a worker holds a batch at a time.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per application; they may run where it is not installed.

    Arrow batches are made smaller for the session too, unless it sets their size itself: a batch is planned
    when a result is asked for, which is after any call of this library, and batches of 10,000 whole texts
    cost an executor with its workers some 700 MB more.
    """
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_shoal_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="shoal-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "shoal_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(archive)
    sc._shoal_shipped = True


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at the end of a task its worker, which waits for the next, gives back what it freed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library only
                trim(0)

    return task


def shrink(spark: SparkSession) -> None:
    """Have the executors collect their garbage, whereupon their heaps shrink to what is in use.

    A heap that grew in one stage of a long job stays as large beside the workers of the next, which need memory
    outside it. One task for every core, so that none is free to take a second and every executor has some.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()
