"""Constraint report (X1): violations per CHECK / NOT NULL / UNIQUE / FK as (table, constraint, n).

The columns that rules name are written once per table. A table's NOT NULL and CHECK counts are one aggregate. Its foreign keys are one
scan: the values of all key columns are counted together (a hot value collapses
before the shuffle) and the distinct ones that meet no parent id are summed up.
Its unique keys are one scan in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.session import broadcast_if_small, materialize
from spooltrace.sources.dims import DIM_NAMES

c = F.col


@dataclass(frozen=True)
class Rules:
    """Rules of one table; checks are SQL conditions that a row may not fail (NULL passes)."""
    required: str = ""
    foreign: dict[str, str] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    unique: tuple[str, ...] = ()


_USER, _UNIT, _SPOOL, _PLACE, _STAGE, _SKU = ("users", "product_tracking", "filaments", "storage_locations",
                                              "lifecycle_stages", "product_skus")
_RESULT = "IN ('Passed', 'B-Ware', 'Waste', 'Quarantine')"

# fixed values: the constraints of the modelled schema
RULES = {
    "product_tracking": Rules(
        "harvest_id product_id product_type_id sku_id current_stage_id",
        {"harvest_id": "product_harvest", "location_id": _PLACE, "current_stage_id": _STAGE, "previous_stage_id": _STAGE,
         "current_status_id": "product_statuses", "sku_id": _SKU, "product_type_id": "product_types"},
        unique=("harvest_id", "product_id", "product_code")),
    "product_harvest": Rules(
        "request_id lid_id seal_id filament_mounting_id printed_by",
        {"request_id": "product_requests", "lid_id": "lids", "seal_id": "seals", "filament_mounting_id": "filament_mounting",
         "printed_by": _USER}),
    "product_requests": Rules("requested_by sku_id lot_number", {"requested_by": _USER, "sku_id": _SKU},
                              {"status": "IN ('Pending', 'Fulfilled', 'Cancelled')"}),
    "product_quality_control": Rules(
        "product_tracking_id inspected_by inspected_at weight_grams pressure_drop visual_pass inspection_result",
        {"product_tracking_id": _UNIT, "inspected_by": _USER}, {"inspection_result": _RESULT}),
    "post_treatment_inspections": Rules("product_tracking_id inspected_by visual_pass surface_treated sterilized qc_result",
                                        {"product_tracking_id": _UNIT, "inspected_by": _USER}, {"qc_result": _RESULT}),
    "filaments": Rules("filament_id serial_number lot_number location_id weight_grams received_at received_by qc_result",
                       {"location_id": _PLACE, "received_by": _USER}, {"qc_result": "IN ('PASS', 'FAIL')"}, ("filament_id",)),
    "filament_mounting": Rules("filament_tracking_id printer_id mounted_by remaining_weight status",
                               {"filament_tracking_id": _SPOOL, "printer_id": "printers", "mounted_by": _USER, "unmounted_by": _USER},
                               {"status": "IN ('In Use', 'Unmounted')"}),
    "filament_acclimatization": Rules("filament_tracking_id moved_by moved_at status",
                                      {"filament_tracking_id": _SPOOL, "moved_by": _USER},
                                      {"status": "IN ('Acclimatizing', 'Complete')"}, ("filament_tracking_id",)),
    "lids": Rules("serial_number quantity location_id received_at received_by qc_result",
                  {"location_id": _PLACE, "received_by": _USER}, {"qc_result": "IN ('PASS', 'FAIL')"}, ("serial_number",)),
    "seals": Rules("serial_number quantity location_id received_at received_by qc_result",
                   {"location_id": _PLACE, "received_by": _USER}, {"qc_result": "IN ('PASS', 'FAIL')"}, ("serial_number",)),
    "treatment_batches": Rules("sent_by sent_at status", {"sent_by": _USER}, {"status": "IN ('Shipped', 'Inspected')"}),
    "treatment_batch_products": Rules("batch_id product_tracking_id surface_treat sterilize",
                                      {"batch_id": "treatment_batches", "product_tracking_id": _UNIT}, unique=("product_tracking_id",)),
    "customers": Rules("customer_name", unique=("customer_name",)),
    "orders": Rules("customer_id order_date order_creator_id status updated_by",
                    {"parent_order_id": "orders", "customer_id": "customers", "order_creator_id": _USER, "updated_by": _USER},
                    {"status": "IN ('Processing', 'Shipped', 'Completed', 'Canceled')"}),
    "order_items": Rules("order_id product_sku_id quantity", {"order_id": "orders", "product_sku_id": _SKU}, {"quantity": "> 0"}),
    "shipments": Rules("customer_id creator_id created_date status updated_by",
                       {"customer_id": "customers", "order_id": "orders", "creator_id": _USER, "updated_by": _USER},
                       {"status": "IN ('Pending', 'Shipped', 'In Transit', 'Delivered', 'Returned', 'Canceled')"}),
    "shipment_unit_items": Rules("shipment_id product_tracking_id", {"shipment_id": "shipments", "product_tracking_id": _UNIT},
                                 unique=("product_tracking_id",)),
    "quarantined_products": Rules(
        "product_tracking_id from_stage_id source quarantine_date quarantined_by quarantine_status",
        {"product_tracking_id": _UNIT, "from_stage_id": _STAGE, "location_id": _PLACE, "quarantined_by": _USER, "resolved_by": _USER},
        {"source": "IN ('Harvest QC', 'Post-Treatment QC', 'Ad-Hoc')", "quarantine_status": "IN ('Active', 'Released', 'Disposed')",
         "result": "IN ('Passed', 'B-Ware', 'Waste')"}),
    "product_investigations": Rules(
        "product_tracking_id status created_by created_at",
        {"product_tracking_id": _UNIT, "created_by": _USER, "resolved_by": _USER},
        {"status": "IN ('Under Investigation', 'Cleared A-Ware', 'Cleared B-Ware', 'Disposed')"}),
    "material_usage": Rules("product_tracking_id material_type lot_number used_quantity used_at used_by",
                            {"product_tracking_id": _UNIT, "harvest_id": "product_harvest", "used_by": _USER},
                            {"material_type": "IN ('Filament', 'Lid', 'Seal')"}),
    "audit_log": Rules("table_name record_id field_name reason changed_by changed_at", {"changed_by": _USER}),
    "product_skus": Rules("product_type_id sku name is_serialized is_bundle pack_qty is_active",
                          {"product_type_id": "product_types"}, {"pack_qty": "> 0"}, ("sku",)),
    "product_print_specs": Rules("height_mm diameter_mm average_weight_g weight_buffer_g", {"sku_id": _SKU},
                                 {"height_mm": "> 0", "diameter_mm": "> 0", "average_weight_g": "> 0", "weight_buffer_g": ">= 0"}),
    "issue_reason_contexts": Rules("reason_id context_id", {"reason_id": "issue_reasons", "context_id": "issue_contexts"},
                                   unique=("reason_id, context_id",)),
    "group_area_rights": Rules("group_oid area_id access_level", {"area_id": "application_areas"},
                               {"access_level": "IN ('Read', 'Write', 'Admin')"}, ("group_oid, area_id",)),
}


def _value_counts(df: DataFrame, table: str, rules: Rules) -> DataFrame:
    counts = {f"NN {x}": c(x).isNull() for x in rules.required.split()}
    counts |= {f"CK {x}": ~F.expr(f"{x} {cond}") for x, cond in rules.checks.items()}
    agg = df.agg(*[F.count_if(cond).alias(name) for name, cond in counts.items()])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(n).alias("constraint_name"), c(f"`{n}`").alias("n"))
        for n in counts])).alias("r")).select("r.*")


def _ruled(db) -> dict[str, DataFrame]:
    """Per table the columns that its rules name, and its id: written once, since several rules and tables read them."""
    out = {}
    for table, rules in RULES.items():
        df = getattr(db, table)
        names = {"id", *rules.required.split(), *rules.foreign, *rules.checks, *", ".join(rules.unique).split(", ")}
        df = df.select(*[x for x in df.columns if x in names])
        out[table] = df if table in DIM_NAMES else materialize(df)
    return out


def _orphans(parents: dict[str, DataFrame], df: DataFrame, table: str, foreign: dict[str, str]) -> DataFrame:
    places = {p: i for i, p in enumerate(sorted(set(foreign.values())))}  # numbers: names would be shuffled with each value
    keys = list(foreign)
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("key"), F.lit(places[foreign[x]]).alias("parent"), c(x).cast("long").alias("v"))
        for i, x in enumerate(keys)])).alias("k")).select("k.*")
    counted = values.groupBy("key", "parent", "v").agg(F.count(F.lit(1)).alias("n"))
    ids = None
    for p, i in places.items():
        one = parents[p].select(F.lit(i).alias("parent"), c("id").cast("long").alias("v"), F.lit(True).alias("known"))
        ids = one if ids is None else ids.unionByName(one)
    lost = c("v").isNotNull() & c("known").isNull()
    name = F.element_at(F.array(*[F.lit(f"FK {x}") for x in keys]), c("key") + 1)
    return (counted.join(ids, ["parent", "v"], "left").groupBy("key")
            .agg(F.coalesce(F.sum(F.when(lost, c("n"))), F.lit(0)).cast("long").alias("n"))
            .select(F.lit(table).alias("table_name"), name.alias("constraint_name"), "n"))


def _duplicates(df: DataFrame, table: str, unique: tuple[str, ...]) -> DataFrame:
    keys = df.select(F.explode(F.array(*[
        F.struct(F.lit(f"UQ {u}").alias("name"), F.array(*[c(x).cast("string") for x in u.split(", ")]).alias("v"))
        for u in unique])).alias("k")).select("k.*")
    counted = keys.groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    some = F.exists("v", lambda x: x.isNotNull())
    return counted.groupBy("name").agg(F.count_if((c("n") > 1) & some).alias("n")).select(
        F.lit(table).alias("table_name"), c("name").alias("constraint_name"), "n")


def constraint_report(db) -> DataFrame:
    out, tables = None, _ruled(db)
    parents = {p: tables[p] if p in tables else getattr(db, p) for r in RULES.values() for p in r.foreign.values()}
    for table, rules in RULES.items():
        df = tables[table]
        parts = [_value_counts(df, table, rules)]
        if rules.foreign:
            parts.append(_orphans(parents, df, table, rules.foreign))
        if rules.unique:
            parts.append(_duplicates(df, table, rules.unique))
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


def _problems(df: DataFrame, kind: str, key, checks: list[tuple]) -> DataFrame:
    """One row per (command, problem): each check is (condition, message); messages are gathered in an
    array with ``when`` (NULL when the check passes), compacted and exploded."""
    msgs = F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in checks]))
    return df.select(F.lit(kind).alias("command"), key.cast("string").alias("command_key"),
                     F.explode(msgs).alias("problem"))


def _blank(col) -> F.Column:
    return col.isNull() | (F.trim(col) == "")


def command_report(qc: DataFrame, post_qc: DataFrame, quarantine: DataFrame, reasons: DataFrame,
                   investigations: DataFrame, customers: DataFrame) -> DataFrame:
    """Invalid command rows and why, for harvest QC, post-treatment QC, ad-hoc quarantine,
    investigation and customer commands."""
    q = _problems(qc, "harvest_qc", c("product_tracking_id"), [
        ((F.coalesce(c("weight_grams"), F.lit(0)) == 0) | (F.coalesce(c("pressure_drop"), F.lit(0)) == 0),
         "weight and pressure are required"),
        (~c("visual_pass") & (c("inspection_result") == "B-Ware") & _blank(c("notes")),
         "notes are required for B-Ware on a visual fail"),
    ])
    p = _problems(post_qc, "post_treatment_qc", c("product_tracking_id"), [
        ((c("visual_pass") == F.lit(False)) & (c("qc_result") == "B-Ware") & _blank(c("notes")),
         "notes are required for B-Ware on a visual fail"),
        ((c("qc_result") == "Quarantine") & (F.coalesce(F.size(c("reason_ids")), F.lit(0)) <= 0),
         "a standard reason is suggested for Quarantine"),
    ])
    other = reasons.where(c("reason_code").startswith("OTHER_")).select(c("id").alias("_oid"))
    qx = (quarantine.select("product_tracking_id", "reason", "reason_ids",
                            F.explode_outer(F.array_distinct(c("reason_ids"))).alias("_rid"))
          .join(broadcast_if_small(other), c("_rid") == c("_oid"), "left")
          .groupBy("product_tracking_id", "reason", "reason_ids")
          .agg(F.max(c("_oid").isNotNull()).alias("_other")))
    qq = _problems(qx, "adhoc_quarantine", c("product_tracking_id"), [
        (F.coalesce(F.size(c("reason_ids")), F.lit(0)) <= 0, "at least one reason is required"),
        (c("_other") & _blank(c("reason")), "details are required for 'Other'"),
    ])
    i = _problems(investigations, "investigation", c("product_tracking_id"), [
        (F.length(c("comment")) > 255, "comment longer than 255"),
        (F.length(c("deviation_number")) > 100, "deviation number longer than 100"),
    ])
    names = customers.select(F.trim(c("customer_name")).alias("name"))
    dup = names.groupBy("name").count()
    cu = _problems(names.join(dup, "name"), "customer", c("name"), [
        (_blank(c("name")), "customer name cannot be empty"),
        (c("count") > 1, "customer name repeated"),
    ])
    return q.unionByName(p).unionByName(qq).unionByName(i).unionByName(cu)
