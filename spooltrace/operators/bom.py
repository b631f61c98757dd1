"""Recursive parts explosion (H9) by path doubling.

The bill of materials is a catalogue-sized table (skus x components), not a
data-sized one. Its relation, with every leaf mapped to itself, is joined with
itself: after k rounds it holds the quantities over paths of 2^k steps, so a
catalogue of depth d is expanded in about log2(d) rounds. Data-sized inputs
(order lines) then meet the closure in a single equi-join on the sku.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.session import materialize

c = F.col


class BomCycleError(ValueError):
    pass


def bom_closure(bom: DataFrame, skus: DataFrame) -> DataFrame:
    """(root_sku_id, component_sku_id, qty): leaf components per one unit of every sku in ``skus``.

    Quantities multiply along a path and sum over paths; a sku without BOM
    rows maps to itself with quantity 1. Rows that have reached a leaf stay as
    they are, the others are joined with the paths of the same length that start
    where they end. Depth is not limited: a path of more steps than there are
    parents must repeat one, and so must one that comes back to its root; both
    raise ``BomCycleError``. A quantity beyond 63 bits raises too. Each round is
    written once, so the plan does not grow with the depth.
    """
    edges = materialize(bom.groupBy(c("parent_sku_id").alias("root"), c("component_sku_id").alias("node")).agg(
        F.sum(c("component_qty").cast("long")).alias("qty")))
    parents = materialize(edges.select(c("root").alias("parent")).distinct())
    n_parents = parents.count()
    nodes = skus.select(c("id").alias("root")).unionByName(edges.select(c("node").alias("root"))).distinct()
    leaves = nodes.join(parents, c("root") == c("parent"), "left_anti").select(
        "root", c("root").alias("node"), F.lit(1).cast("long").alias("qty"))
    marked = edges.join(parents, c("node") == c("parent"), "left").select(
        "root", "node", "qty", c("parent").isNotNull().alias("open"))
    paths = materialize(marked.unionByName(leaves.withColumn("open", F.lit(False))))
    steps = 1
    while True:
        state = paths.agg(F.count_if("open").alias("open"), F.count_if(c("open") & (c("root") == c("node"))).alias("back"),
                          F.count_if(c("qty").isNull()).alias("lost")).first()
        if state["back"] or (state["open"] and steps > n_parents):
            raise BomCycleError("bill of materials holds a cycle")
        if not state["open"]:
            break
        # a leaf of many products is not joined again: only rows that still stand at a parent go on
        on = paths.where("open").select(c("root").alias("_r"), c("node").alias("_n"), c("qty").alias("_q"))
        further = on.join(paths, c("_n") == c("root")).select(
            c("_r").alias("root"), "node", F.try_multiply(c("_q"), c("qty")).alias("qty"), "open")
        grown = further.unionByName(paths.where("NOT open")).groupBy("root", "node", "open").agg(
            F.try_sum("qty").alias("qty"), F.count_if(c("qty").isNull()).alias("_lost"))
        paths = materialize(grown.select("root", "node", F.when(c("_lost") == 0, c("qty")).alias("qty"), "open"))
        steps *= 2
    if state["lost"]:
        raise OverflowError("a component quantity exceeds 63 bits")
    wanted = skus.select(c("id").alias("root_sku_id")).distinct()
    return paths.join(wanted, c("root") == c("root_sku_id"), "left_semi").select(
        c("root").alias("root_sku_id"), c("node").alias("component_sku_id"), "qty")


def expand_lines(lines: DataFrame, closure: DataFrame, sku_col: str = "product_sku_id",
                 qty_col: str = "quantity") -> DataFrame:
    """Order lines -> component requirements: quantity x closure qty, one row per (line, component)."""
    cl = closure.select(c("root_sku_id").alias("_root"), "component_sku_id", c("qty").alias("_cq"))
    return (lines.join(cl, lines[sku_col] == cl._root)
            .withColumn("required_qty", (c(qty_col) * c("_cq")).cast("long")).drop("_root", "_cq"))
