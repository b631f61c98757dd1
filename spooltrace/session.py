"""Spark session defaults shared by tests, bench and the driver entry.

Only sets what a cluster deployment would also want: AQE with skew-join
splitting, UTC session time, no UI. The checkpoint directory is read from
the session; a scratch one is set only when the session has none (tests).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "spooltrace") -> SparkSession:
    """A session with the library's defaults; the number of shuffle partitions is left alone unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("SPOOLTRACE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir, setting a scratch one only for a local session that has none.

    On a cluster ``spark.checkpoint.dir`` must name a folder that all executors
    share; without it this raises instead of writing to each machine's own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spooltrace-ckpt-", dir=os.environ.get("SPOOLTRACE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


BROADCAST_ROWS = 20_000


def broadcast_if_small(df, rows: int = BROADCAST_ROWS):
    """``df`` with a broadcast hint if it holds at most ``rows`` rows (counted), else without: the planner decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_written: list = []


def materialize(df):
    """``df`` written once as Parquet in the session's checkpoint folder and read back.

    Cuts the lineage as a reliable checkpoint does, but in columns, so later
    reads are pruned. The tables are removed when the driver program ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written_once(db, name: str, prepare=None):
    """Table ``name`` of ``db``, after ``prepare`` (a function of the table) if given, written by its first reader.

    Later readers filter on parsed cells. Over a table still to be derived, the optimizer would put a cell's derivation
    into every place that names the cell.
    """
    df = getattr(db, name)  # read also where the result is at hand: it depends on it
    kept = db.__dict__.setdefault("_written_once", {})
    key = name if prepare is None else (name, prepare.__name__)
    if key not in kept or kept[key][0] is not df:
        kept[key] = (df, materialize(df if prepare is None else prepare(df)))
    return kept[key][1]


def _remove_written() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is None:  # the session has ended
            continue
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
