"""Distributed row numbering without a single-partition window.

``row_number() OVER (ORDER BY k)`` and ``OVER (PARTITION BY g ORDER BY k)``
put every row of the window partition into one task. Here the rows are
range-partitioned on the ordering instead, numbered inside each range
partition, and shifted by the number of rows that precede the partition.
The shift table has at most one row per range partition, so broadcasting
it is bounded by the partition count, not by the data. A hot group that
holds a third of all rows is spread over many range partitions.

The range-partitioned rows are written once (in the session's
``spark.checkpoint.dir``): the offsets and the rows must see the same partition
boundaries, and two evaluations of a range exchange over shuffled input can
sample different boundaries. The written table also keeps assigned numbers
stable when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spooltrace.session import materialize

_PID, _MID, _LOC = "_rk_pid", "_rk_mid", "_rk_loc"


def _cols(cs: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def _by_range(df: DataFrame, n: int | None, order: list[Column]) -> DataFrame:
    """Range partitions on ``order``; without a count the session's setting holds and AQE joins small ones."""
    return df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)


def row_number_global(df: DataFrame, order_by: Sequence[str | Column], col: str = "rn",
                      start: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Add ``col`` = start, start+1, ... in ``order_by`` order (ties: keep keys unique).

    One range shuffle. Within each sorted range partition the position comes
    from ``monotonically_increasing_id`` (partition id in the high bits, row
    index in the low bits); the per-partition row counts are prefix-summed
    into offsets (one row per partition) and broadcast back.
    """
    order = _cols(order_by)
    parted = (_by_range(df, num_partitions, order).sortWithinPartitions(*order)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id()))
    parted = parted.withColumn(_LOC, F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33))
    parted = materialize(parted)
    counts = parted.groupBy(_PID).agg(F.count(F.lit(1)).alias("_rk_cnt"))
    offsets = counts.select(
        _PID,
        F.coalesce(F.sum("_rk_cnt").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_rk_off"))
    out = parted.join(F.broadcast(offsets), _PID, "left")  # <= num_partitions rows
    return out.withColumn(col, (F.col("_rk_off") + F.col(_LOC) + F.lit(start)).cast("long")).drop(
        _PID, _MID, _LOC, "_rk_off")


def row_number_within(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str | Column],
                      col: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY group_by ORDER BY order_by)``, skew-safe.

    Rows are range-partitioned on (group, order) so a hot group spans many
    partitions; each (group, partition) piece is numbered by a window keyed on
    both, and pieces are shifted by the rows of the same group in earlier
    partitions. Only the first group of a partition can continue from an
    earlier partition, so the shift table has at most one row per partition.
    """
    groups = list(group_by)
    order = _cols(order_by)
    parted = materialize(_by_range(df, num_partitions, [*_cols(groups), *order]).withColumn(_PID, F.spark_partition_id()))
    local = parted.withColumn(
        _LOC, F.row_number().over(Window.partitionBy(*groups, _PID).orderBy(*order)))
    counts = parted.groupBy(*groups, _PID).agg(F.count(F.lit(1)).alias("_rk_cnt"))
    shifts = (counts
              .withColumn("_rk_off", F.sum("_rk_cnt").over(
                  Window.partitionBy(*groups).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)))
              .where(F.col("_rk_off") > 0)
              .select(*groups, _PID, "_rk_off"))
    out = local.join(F.broadcast(shifts), [*groups, _PID], "left")  # <= num_partitions rows
    return out.withColumn(col, (F.coalesce(F.col("_rk_off"), F.lit(0)) + F.col(_LOC)).cast("long")).drop(
        _PID, _LOC, "_rk_off")


def _running(df: DataFrame, groups: list[str], order: list[Column], value: str | Column,
             fold: Callable[[str], Column], num_partitions: int | None) -> DataFrame:
    """Rows with ``_LOC``, the fold inside their (group, range partition) piece, and ``_rk_off``, that of earlier pieces."""
    val = F.col(value) if isinstance(value, str) else value
    parted = materialize(_by_range(df.withColumn("_rk_val", val), num_partitions, [*_cols(groups), *order])
                         .withColumn(_PID, F.spark_partition_id()))
    local = parted.withColumn(_LOC, fold("_rk_val").over(
        Window.partitionBy(*groups, _PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = parted.groupBy(*groups, _PID).agg(fold("_rk_val").alias("_rk_tot"))
    earlier = Window.partitionBy(*groups) if groups else Window  # without groups: one row per range partition
    shifts = (totals
              .withColumn("_rk_off", fold("_rk_tot").over(
                  earlier.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)))
              .where(F.col("_rk_off").isNotNull())
              .select(*groups, _PID, "_rk_off"))
    # a group continues from an earlier partition only at the start of a partition: <= num_partitions rows
    return local.join(F.broadcast(shifts), [*groups, _PID], "left")


def running_sum_within(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str | Column],
                       value: str | Column, col: str = "running", num_partitions: int | None = None) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY group_by ORDER BY order_by ROWS UNBOUNDED PRECEDING)``, skew-safe.

    Same scheme as ``row_number_within``: running sums inside each
    (group, range partition) piece plus the group's total of earlier pieces;
    the shift table has at most one row per range partition.
    """
    out = _running(df, list(group_by), _cols(order_by), value, F.sum, num_partitions)
    return out.withColumn(col, F.coalesce(F.col("_rk_off"), F.lit(0)) + F.col(_LOC)).drop(
        _PID, _LOC, "_rk_off", "_rk_val")


def running_min_within(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str | Column],
                       value: str | Column, col: str = "running", num_partitions: int | None = None) -> DataFrame:
    """``MIN(value) OVER (PARTITION BY group_by ORDER BY order_by ROWS UNBOUNDED PRECEDING)``, skew-safe.

    Null values are passed over; the value may be a struct. With no groups the
    minimum runs over the whole table, still without a single-partition window
    over rows. Rows that ask (value null) and rows that offer can stand in one
    ordering, which answers "least value among all rows up to here" without an
    inequality join.
    """
    out = _running(df, list(group_by), _cols(order_by), value, F.min, num_partitions)
    return out.withColumn(col, F.when(F.col("_rk_off").isNull(), F.col(_LOC)).when(
        F.col(_LOC).isNull(), F.col("_rk_off")).otherwise(F.least("_rk_off", _LOC))).drop(
        _PID, _LOC, "_rk_off", "_rk_val")
