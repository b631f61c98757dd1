"""Smallest rows per group, where the number wanted grows with the group.

Moving every row of a group to one place to keep a few of them does not scale.
Keys are hashes, so a fixed share of the hash range holds about that share of
any group: for large groups only the rows below a bound move. For small groups
the first ``FEW`` rows move; Spark keeps that many per partition before the
shuffle (a window with a literal limit). Both are exact: a large group whose
rows below the bound are too few is ranked whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spooltrace.operators.ranking import row_number_within
from spooltrace.session import materialize

c = F.col
FEW = 20  # groups that want at most so many rows are small
MARGIN = 1.6  # how much more than the share of the hash range is looked at


def hash_bound(share: float) -> str:
    """Eight hex digits: keys (hex digests) below them are about ``share`` of all, with a margin."""
    return f"{min(int(share * MARGIN * 2**32), 2**32 - 1):08x}"


def smallest_share(rows: DataFrame, group: str, key: str, tie: str, wanted: Column, share: float) -> DataFrame:
    """Rows of each group that are among its ``wanted`` smallest by (``key``, ``tie``), with ``n`` and ``wanted``.

    ``key`` is a hex digest; ``wanted`` is an expression of the group's row count ``n`` that is about ``share`` of it
    in large groups.
    """
    low = c(key) < hash_bound(share)
    sizes = materialize(rows.groupBy(c(group).alias("_g")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(low).alias("n_low")).withColumn("wanted", wanted.cast("long")))
    names = [*rows.columns, "n", "wanted"]

    small = sizes.where(c("wanted") <= FEW)
    first = Window.partitionBy(group).orderBy(key, tie)
    few = rows.withColumn("_rk", F.row_number().over(first)).where(c("_rk") <= FEW)
    out = few.join(small, c(group) == c("_g")).where(c("_rk") <= c("wanted")).select(*names)

    def ranked(part: DataFrame, groups: DataFrame) -> DataFrame:
        held = part.join(groups, c(group) == c("_g"))
        return row_number_within(held, [group], [key, tie], col="_rk").where(c("_rk") <= c("wanted")).select(*names)

    large = sizes.where((c("wanted") > FEW) & (c("n_low") >= c("wanted")))
    if not large.isEmpty():
        out = out.unionByName(ranked(rows.where(low), large))
    unlucky = sizes.where((c("wanted") > FEW) & (c("n_low") < c("wanted")))
    if not unlucky.isEmpty():
        out = out.unionByName(ranked(rows, unlucky))
    return out
