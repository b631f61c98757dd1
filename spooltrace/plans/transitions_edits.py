"""More bulk transitions: order creation (K16), request cancel (K5), audited storage edits (K14), and new
spools, seals and audited seal edits (K23). Command tables in, new table versions, history and audit out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.operators import merge as C
from spooltrace.operators.outputs import Outputs, once
from spooltrace.plans.transitions import (HISTORY_COLUMNS, ITEM_COLUMNS, ORDER_COLUMNS, RESULT_CYCLE, _next_audit,
                                          apply_field_changes, apply_qc_edit)

c = F.col


def apply_order_create(db, headers: DataFrame, lines: DataFrame, as_of: str) -> Outputs:
    """K16 (create): header rows (order_key, customer_id, parent_order_id, created_by, notes) and line rows
    (order_key, product_sku_id, quantity) -> new Processing orders with their positive lines."""
    C.check_unique(headers, ["order_key"])
    heads = once(lambda: C.assign_ids(headers, ["order_key"], C.next_id(db.orders), "id"))

    def orders() -> DataFrame:
        return heads().select(
            "id", c("parent_order_id").cast("long"), "customer_id", F.lit(as_of).cast("timestamp_ntz").alias("order_date"),
            c("created_by").cast("long").alias("order_creator_id"), F.lit("Processing").alias("status"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"), c("created_by").cast("long").alias("updated_by"),
            c("notes").cast("string").alias("notes")).select(*ORDER_COLUMNS)

    def items() -> DataFrame:
        rows = (lines.where(c("quantity") > 0).join(heads().select("order_key", c("id").alias("order_id")), "order_key")
                .select("order_id", "product_sku_id", "quantity"))
        return C.assign_ids(rows, ["order_id", "product_sku_id"], C.next_id(db.order_items), "id").select(*ITEM_COLUMNS)

    return Outputs(orders=orders, order_items=items)


def order_create_commands(db) -> tuple[DataFrame, DataFrame]:
    """Command tables for K16 create: each customer with canceled orders orders again, per sku what was canceled less 20."""
    lost = db.orders.where(c("status") == "Canceled").select(c("id").alias("_o"), "customer_id")
    lines = (db.order_items.join(lost, c("order_id") == c("_o")).groupBy(c("customer_id").alias("order_key"), "product_sku_id")
             .agg((F.sum("quantity") - 20).cast("long").alias("quantity")))
    heads = lost.select(c("customer_id").alias("order_key"), "customer_id").distinct().select(
        "order_key", "customer_id", F.lit(None).cast("long").alias("parent_order_id"), F.lit(1).alias("created_by"),
        F.lit("ordered again").alias("notes"))
    return heads, lines


def apply_request_cancel(requests: DataFrame, commands: DataFrame) -> DataFrame:
    """K5 (cancel): request ids -> those requests read 'Cancelled'."""
    hit = commands.select(c("request_id").alias("_hit")).distinct()
    return (requests.join(hit, c("id") == c("_hit"), "left")
            .withColumn("status", F.when(c("_hit").isNotNull(), F.lit("Cancelled")).otherwise(c("status"))).drop("_hit"))


def request_cancel_commands(db) -> DataFrame:
    """Command table for K5 cancel: every pending tech-transfer request."""
    return db.product_requests.where((c("status") == "Pending") & c("is_tech_transfer")).select(c("id").alias("request_id"))


def apply_storage_edit(db, edits: DataFrame, as_of: str) -> Outputs:
    """K14 (edit): rows (product_tracking_id, field_name, old_value, new_value, reason, user_id) -> audited field
    changes of the units; the field ``current_status`` names a stage, which the unit takes with a history row."""
    changes = edits.select(c("product_tracking_id").alias("record_id"), "field_name", "old_value", "new_value", "reason",
                           c("user_id").alias("changed_by"))
    res = apply_field_changes(db.product_tracking, "product_tracking", changes, as_of, _next_audit(db))
    stages = db.lifecycle_stages.groupBy(c("stage_name").alias("_name")).agg(F.min("id").alias("_new"))
    moves = (edits.where(c("field_name") == "current_status").join(stages, c("new_value") == c("_name"))
             .select(c("product_tracking_id").alias("_unit"), "_new", c("user_id").alias("_by")))
    C.check_unique(moves, ["_unit"])
    now = F.lit(as_of).cast("timestamp_ntz")
    hit = c("_unit").isNotNull()

    def tracking() -> DataFrame:
        return res["product_tracking"].join(moves, c("id") == c("_unit"), "left").select(*[
            F.when(hit, c("_new")).otherwise(c(x)).alias(x) if x == "current_stage_id" else
            F.when(hit, now).otherwise(c(x)).alias(x) if x == "last_updated_at" else c(x)
            for x in db.product_tracking.columns])

    def history() -> DataFrame:
        rows = db.product_tracking.join(moves, c("id") == c("_unit")).select(
            c("id").alias("product_tracking_id"), c("current_stage_id").alias("from_stage_id"),
            c("_new").alias("to_stage_id"), F.lit("Update from storage location edit.").alias("reason"),
            c("_by").cast("long").alias("changed_by"), now.alias("changed_at"))
        return C.assign_ids(rows, ["product_tracking_id"], 1, "id").select(*HISTORY_COLUMNS)

    return res.only("audit_log") | Outputs(product_tracking=tracking, product_status_history=history)


def storage_edit_commands(db) -> DataFrame:
    """Command table for K14 edits: every unit in interim storage moves to location 3 and stage 'Stored; Pending QM Approval'."""
    here = db.lifecycle_stages.where(c("stage_code") == "InInterimStorage").select(c("id").alias("_s"), "stage_name")
    u = db.product_tracking.join(F.broadcast(here), c("current_stage_id") == c("_s"))
    return u.select(c("id").alias("product_tracking_id"), F.explode(F.array(
        F.struct(F.lit("location_id").alias("f"), c("location_id").cast("string").alias("o"), F.lit("3").alias("n")),
        F.struct(F.lit("current_status").alias("f"), c("stage_name").alias("o"),
                 F.lit("Stored; Pending QM Approval").alias("n")))).alias("e")).select(
        "product_tracking_id", c("e.f").alias("field_name"), c("e.o").alias("old_value"), c("e.n").alias("new_value"),
        F.lit("shelf check").alias("reason"), F.lit(2).alias("user_id"))


def _new_rows(name: str, table: DataFrame, key: str, commands: DataFrame, as_of: str) -> Outputs:
    """Rows whose key is neither present nor repeated become new rows; the others are reported."""
    repeated = commands.groupBy(key).count().where(c("count") > 1).select(key)
    present = table.select(key).join(commands.select(key), key, "left_semi").distinct()
    fine = commands.join(present, key, "left_anti").join(repeated, key, "left_anti").withColumn(
        "received_at", F.lit(as_of).cast("timestamp_ntz"))
    fine = fine.select(*[c(x).cast(table.schema[x].dataType).alias(x) for x in table.columns if x != "id"])
    rejected = (commands.join(present, key, "left_semi").select(key, F.lit("exists").alias("why"))
                .unionByName(repeated.select(key, F.lit("repeated").alias("why"))))
    return Outputs(**{name: lambda: C.assign_ids(fine, [key], C.next_id(table), "id").select(*table.columns)},
                   rejected=lambda: rejected)


def apply_new_spools(db, commands: DataFrame, as_of: str) -> Outputs:
    """K23 (spools): rows (filament_id, serial_number, lot_number, location_id, weight_grams, received_by, qc_result)
    -> new spools; spool numbers already present or repeated are rejected into a report."""
    return _new_rows("filaments", db.filaments, "filament_id", commands, as_of)


def spool_commands(db) -> DataFrame:
    """Command table for K23 spools: a spool per supplier; numbers below the stock's largest clash."""
    s = db.src("supplier")
    no = (c("s_suppkey") * 7 + F.when(c("s_suppkey") % 2 == 0, F.lit(5000)).otherwise(F.lit(9_000_000))).cast("long")
    return s.select(no.alias("filament_id"), F.concat(F.lit("N"), no.cast("string")).alias("serial_number"),
                    F.concat(F.lit("N"), (c("s_suppkey") % 9).cast("string")).alias("lot_number"),
                    (F.lit(1) + c("s_nationkey")).alias("location_id"), F.lit(1000).alias("weight_grams"),
                    F.lit(1).alias("received_by"), F.lit("PASS").alias("qc_result"))


def apply_new_seals(db, commands: DataFrame, as_of: str) -> Outputs:
    """K23 (seals): as for lids: trimmed serials; present or repeated ones are rejected into a report."""
    trimmed = commands.withColumn("serial_number", F.trim(c("serial_number")))
    return _new_rows("seals", db.seals, "serial_number", trimmed, as_of)


def seal_commands(db) -> DataFrame:
    """Command table for K23 seals: a delivery per part brand; some serials clash with existing seals."""
    p = db.src("part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"), F.count(F.lit(1)).alias("n"))
    return p.select(F.concat(F.lit(" SEAL"), (c("k") % 150).cast("string"), F.lit(" ")).alias("serial_number"),
                    (F.lit(50) + c("n")).alias("quantity"), (F.lit(1) + c("k") % 25).alias("location_id"),
                    F.lit(1).alias("received_by"), F.lit("PASS").alias("qc_result"))


def apply_seal_edit(db, edits: DataFrame, as_of: str) -> Outputs:
    """K23 (edits): audited changes of seal batches (K3); lids, mounts, harvests and batches go the same way."""
    return apply_field_changes(db.seals, "seals", edits, as_of, _next_audit(db))


def seal_edit_commands(db) -> DataFrame:
    """Command table for K23 edits: every seal batch is recounted to what usage left of it."""
    from spooltrace.plans.materials import seal_remaining
    left = seal_remaining(db).select(c("serial_number").alias("_sn"), "remaining_units")
    return (db.seals.join(left, c("serial_number") == c("_sn"))
            .select(c("id").alias("record_id"), F.lit("quantity").alias("field_name"),
                    c("quantity").cast("string").alias("old_value"), c("remaining_units").cast("string").alias("new_value"),
                    F.lit("recount").alias("reason"), F.lit(1).alias("changed_by")))


def apply_post_treatment_edit(db, edits: DataFrame, as_of: str) -> Outputs:
    """K7 (post-treatment form): audited inspection edits; the result re-maps the status, Quarantine moves the unit."""
    return apply_qc_edit(db, edits, as_of, table="post_treatment_inspections", result_field="qc_result",
                         source="Post-Treatment QC", other_status="Pending", move_reason="Moved to quarantine")


def post_treatment_edit_commands(db) -> DataFrame:
    """Command table for K7 post-treatment: every inspection gets the next result in the fixed cycle."""
    nxt = None
    for a, b in RESULT_CYCLE:
        nxt = F.when(c("qc_result") == a, b) if nxt is None else nxt.when(c("qc_result") == a, b)
    return db.post_treatment_inspections.select(
        c("id").alias("qc_id"), "product_tracking_id", F.lit("qc_result").alias("field_name"), c("qc_result").alias("old_value"),
        nxt.alias("new_value"), F.lit("second look").alias("reason"), F.lit(3).cast("long").alias("user_id"))
