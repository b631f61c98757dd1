"""Seed merges (A9-A13): literal reference rows merged into dimension tables.

All are insert-if-missing / update-if-matched merges over small tables, so
they reuse the merge kernel; the pair seeds (A12, A13) expand a list column
with ``explode`` instead of a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spooltrace.operators import merge as C

c = F.col


def seed_dims(target: DataFrame, rows: DataFrame, key: str, update_cols: list[str] | None = None) -> DataFrame:
    """Insert rows whose key is missing; with ``update_cols`` also refresh those columns where matched."""
    if update_cols:
        new, _ = C.merge_upsert(target, rows, [key], set_cols=update_cols, id_col="id", id_order=[key])
        return new
    new, _ = C.insert_missing(target, rows, [key], id_col="id", id_order=[key])
    return new


def seed_skus(skus: DataFrame, types: DataFrame, rows: DataFrame) -> DataFrame:
    """A10: rows (product_type_name, sku, name, is_serialized, is_bundle, pack_qty, is_active) joined to their
    type by name; skus already present are left alone."""
    src = rows.join(types.select(c("id").alias("product_type_id"), c("name").alias("product_type_name")),
                    "product_type_name").drop("product_type_name")
    new, _ = C.insert_missing(skus, src, ["sku"], id_col="id", id_order=["sku"])
    return new


def seed_print_specs(specs: DataFrame, skus: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (sku, height_mm, diameter_mm, average_weight_g, weight_buffer_g) joined to their sku; skus with
    a spec keep it."""
    src = rows.join(skus.select(c("id").alias("sku_id"), "sku"), "sku").drop("sku")
    new, _ = C.insert_missing(specs, src, ["sku_id"], id_col=None)
    return new


def seed_reason_contexts(reasons: DataFrame, links: DataFrame, contexts: DataFrame, rows: DataFrame,
                         context_codes: list[str]) -> dict[str, DataFrame]:
    """Upsert reasons by code, then link every seeded reason to each listed context unless linked."""
    new_reasons, _ = C.merge_upsert(reasons, rows, ["reason_code"],
                                    set_cols=["reason_label", "category", "default_outcome", "is_active"],
                                    id_col="id", id_order=["reason_code"])
    seeded = new_reasons.join(rows.select("reason_code"), "reason_code", "left_semi")
    wanted = (seeded.select(c("id").alias("reason_id"),
                            F.explode(F.array(*[F.lit(x) for x in context_codes])).alias("context_code"))
              .join(contexts.select(c("id").alias("context_id"), "context_code"), "context_code")
              .select("reason_id", "context_id"))
    new_links, _ = C.insert_missing(links, wanted, ["reason_id", "context_id"], id_col="id",
                                    id_order=["reason_id", "context_id"])
    return {"issue_reasons": new_reasons, "issue_reason_contexts": new_links}


def seed_group_rights(rights: DataFrame, areas: DataFrame, rows: DataFrame,
                      admin_group: str | None = None) -> DataFrame:
    """Rows (group_oid, area_name, access_level) with a group and a known area are merged by
    (group, area), updating only a different level; an admin group gets Admin on every area."""
    src = (rows.where(c("group_oid").isNotNull())
           .join(areas.select(c("id").alias("area_id"), c("area_name")), "area_name")
           .select("group_oid", "area_id", "access_level"))
    if admin_group is not None:
        src = src.unionByName(areas.select(F.lit(admin_group).alias("group_oid"), c("id").alias("area_id"),
                                           F.lit("Admin").alias("access_level")))
    C.check_unique(src, ["group_oid", "area_id"])
    new, _ = C.merge_upsert(rights, src, ["group_oid", "area_id"], set_cols=["access_level"],
                            update_when=c("t_access_level") != c("s_access_level"), id_col="id",
                            id_order=["group_oid", "area_id"])
    return new


def region_group_rows(region: DataFrame) -> DataFrame:
    """Seed input for A13 from the region table: each region's group reads Production and writes Logistics."""
    return region.select(F.concat(F.lit("REGION_"), c("r_name")).alias("group_oid"),
                         F.explode(F.array(F.struct(F.lit("Production").alias("area_name"), F.lit("Read").alias("lvl")),
                                           F.struct(F.lit("Logistics").alias("area_name"), F.lit("Write").alias("lvl"))))
                         .alias("x")).select("group_oid", "x.area_name", c("x.lvl").alias("access_level"))
