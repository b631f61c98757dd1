"""Shared helpers of the training-data operators: intermediate tables, expression binding, table reading."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spooltrace.session import ensure_checkpoint_dir

BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []
_named: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, read by Spark from ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_ROWS`` rows for what is executed inside; the session's own setting afterwards."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if before and int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go as soon as it has ended, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet under the session's checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint, but in columns, and later
    reads see the very rows (and row keys) that were written. The folder is the
    shared one named by ``spark.checkpoint.dir``; the tables are removed when
    the driver program ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    if not _written:
        atexit.register(_cleanup)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def keep_table(df: DataFrame, tag: str, keys: list[str]) -> DataFrame:
    """``materialize`` as a table bucketed by ``keys``, so that later joins on them move only the other side."""
    spark = df.sparkSession
    name = f"llm_{tag}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    with small_batches(spark):
        df.write.format("parquet").bucketBy(shuffle_partitions(spark), *keys).option("path", path).saveAsTable(name)
    if not _written:
        atexit.register(_cleanup)
    _written.append((spark, path))
    _named.append((spark, name))
    return spark.table(name)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``materialize`` that nothing reads any more."""
    names = {f.split("/")[-2] for f in df.inputFiles()}
    for spark, path in _written:
        if path.rpartition("/")[2] in names:
            _delete(spark, path)


def _cleanup() -> None:
    for spark, name in _named:
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:  # else the session has ended
            _delete(spark, path)


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: names that no working column of an operator has."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def at(df: DataFrame, name: str) -> str:
    """The name that ``positional`` gives the column ``name`` of ``df``."""
    return f"c{df.columns.index(name)}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    A one-element array binds the value to a lambda variable, so the optimizer
    cannot copy a costly expression into an inner loop.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: Spark distributes its source once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="spooltrace-src-"), "spooltrace_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def return_large_blocks() -> None:
    """Have malloc take blocks over 1 MB straight from the system, so that they go back when freed."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def release_memory() -> None:
    """Give freed memory back to the system: idle Python workers stay alive beside the JVM."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, func, schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers, whose memory is released after each task.

    Texts are long, so ``func`` gets parts of at most ``BATCH_ROWS`` rows, whatever size of Arrow batches the session sets
    (tables that an operator writes itself are made with such batches from the start).
    """
    def run(batches):
        return_large_blocks()
        try:
            yield from func(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, len(b), BATCH_ROWS))
        finally:
            release_memory()

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
