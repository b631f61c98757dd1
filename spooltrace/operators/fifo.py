"""FIFO allocation of ranked units to ranked demand (H12), without a range join.

Units of a sku are numbered 1..N in FIFO order; demand lines of the sku get
the half-open interval (start, end] of a running demand sum. A unit with
number r belongs to the line whose interval contains r. Instead of a range
join, each line's interval - clipped to the N available units - is expanded
into its slot numbers and equi-joined to the units on (sku, number). The
expansion is bounded by the number of units, and long intervals are cut
into fixed-size chunks that are spread over tasks before expansion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.operators.ranking import row_number_within, running_sum_within

c = F.col
CHUNK = 4096


def fifo_allocate(units: DataFrame, unit_order: list[str], demand: DataFrame, demand_order: list[str],
                  sku_col: str = "sku_id", need_col: str = "required_units") -> tuple[DataFrame, DataFrame]:
    """Return (allocations, lines).

    ``units``: one row per available unit, with ``sku_col`` and ``unit_order`` columns.
    ``demand``: one row per demand line, with ``sku_col``, ``need_col`` and ``demand_order`` columns.
    allocations: the unit rows plus the demand columns of the line they go to (``fifo_rank``).
    lines: the demand rows plus ``allocated_units`` and ``is_short``.
    """
    ranked = row_number_within(units, [sku_col], unit_order, col="fifo_rank")
    avail = units.groupBy(c(sku_col).alias("_sku")).agg(F.count(F.lit(1)).alias("_n"))
    run = running_sum_within(demand, [sku_col], demand_order, need_col, col="_end")
    lines = (run.withColumn("_start", c("_end") - c(need_col))
             .join(avail, c(sku_col) == c("_sku"), "left").drop("_sku")
             .withColumn("_n", F.coalesce(c("_n"), F.lit(0)))
             .withColumn("_hi", F.least(c("_end"), c("_n")))
             .withColumn("allocated_units", F.greatest(c("_hi") - c("_start"), F.lit(0)).cast("long"))
             .withColumn("is_short", c("allocated_units") < c(need_col)))
    chunks = (lines.where(c("allocated_units") > 0)
              .withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((c("allocated_units") - 1) / CHUNK)
                                                    .cast("long"))))
              .withColumn("_lo", c("_start") + 1 + c("_k") * CHUNK)
              .withColumn("_hi2", F.least(c("_hi"), c("_start") + (c("_k") + 1) * CHUNK))
              .repartition("_lo", sku_col))
    slots = chunks.withColumn("fifo_rank", F.explode(F.sequence(c("_lo"), c("_hi2")))).drop(
        "_k", "_lo", "_hi2", "_start", "_end", "_n", "_hi", "allocated_units", "is_short")
    alloc = ranked.join(slots.withColumnRenamed(sku_col, "_s2"),
                        (c(sku_col) == c("_s2")) & (ranked.fifo_rank == slots.fifo_rank)).drop("_s2", slots.fifo_rank)
    return alloc, lines.drop("_start", "_end", "_n", "_hi")
