"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Tables stored since the innermost ``settled`` began.
_on_the_way: ContextVar[list[DataFrame] | None] = ContextVar("on_the_way", default=None)

#: Fixed value: Spark's setting that removes a query's shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Most bytes of an Arrow batch, unless the session asks for less: bounds what a task holds, in the JVM and in Python.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's largest Arrow batch to BATCH_BYTES."""
    now = spark.conf.get(_BATCH_SETTING, "64m").lower().rstrip("b")
    size = int(now.rstrip("kmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1], 1)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only in local mode, where driver and tasks are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="voxlake-")
    return _own[key]


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """In whatever file system Spark knows."""
    target, files = _path(spark, path)
    return files.exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in whatever file system Spark knows."""
    target, files = _path(spark, path)
    out = files.create(target, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/voxlake/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target, files = _path(spark, path)
        files.delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have ended already
        return


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of queries run inside go when the query ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, short lineage."""
    path = scratch_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return _noted(out)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``written``, dealt into buckets by ``column``: joins on it need not shuffle these rows again."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table, n = f"spark_catalog.default.voxlake_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_removed(spark):
        rows = df.repartition(n, column).write.format("parquet").option("compression", "zstd").option("parquet.block.size", 32 << 20)
        rows.bucketBy(n, column).option("path", path).saveAsTable(table)
    atexit.register(_forget, spark, table)
    out = spark.table(table)
    out._scratch, out._table = path, table
    return _noted(out)


def _noted(df: DataFrame) -> DataFrame:
    if (tables := _on_the_way.get()) is not None:
        tables.append(df)
    return df


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows that ``make`` returns, stored; all tables that it stored on the way are removed."""
    tables: list[DataFrame] = []
    before = _on_the_way.set(tables)
    try:
        out = written(make(), name)
    finally:
        _on_the_way.reset(before)
    discard(*(df for df in tables if df is not out))
    return _noted(out)


def _forget(spark: SparkSession, table: str) -> None:
    with suppress(Exception):  # the session may have ended already
        spark.sql(f"drop table if exists {table}")


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` and ``bucketed`` that nothing lazy refers to any more."""
    for df in tables:
        if hasattr(df, "_table"):
            _forget(df.sparkSession, df._table)
        _remove(df.sparkSession, df._scratch)
