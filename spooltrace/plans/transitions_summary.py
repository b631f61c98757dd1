"""What a whole family of transitions applied, one row per record: orders (K16), mounts (K19), skus (K20), materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spooltrace.plans import transitions as K
from spooltrace.plans import transitions_edits as KE

c = F.col


def _applied(operation: str, rows: DataFrame, record: str, result: Column) -> DataFrame:
    return rows.select(F.lit(operation).alias("operation"), c(record).cast("long").alias("record_id"),
                       result.cast("string").alias("result"))


def _rejected(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.lit("rejected").alias("operation"), F.lit(None).cast("long").alias("record_id"),
                       F.concat(c(key), F.lit(": "), c("why")).alias("result"))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edit() -> Column:
    return F.concat(c("field_name"), F.lit("="), c("new_value"))


def applied_orders(db, as_of: str) -> DataFrame:
    """Created, re-created and canceled orders, and every audited change of a line."""
    now = F.lit(as_of).cast("timestamp_ntz")
    canceled = K.apply_order_cancel(db, K.cancel_commands(db), as_of)["orders"]
    return _together([
        _applied("create", KE.apply_order_create(db, *KE.order_create_commands(db), as_of)["orders"], "id", c("status")),
        _applied("re-create", K.apply_recreate_orders(db, K.recreate_commands(db), 1, as_of)["orders"], "id", c("notes")),
        _applied("cancel", canceled.where((c("status") == "Canceled") & (c("updated_at") == now)), "id", c("notes")),
        _applied("line", K.apply_order_line_diff(db, K.line_diff_commands(db), 1, as_of)["audit_log"], "record_id", _edit())])


def applied_mounts(db, as_of: str) -> DataFrame:
    """New and closed mounts, new acclimatizations, and the audited changes of the others."""
    now = F.lit(as_of).cast("timestamp_ntz")
    closed = K.apply_unmount(db.filament_mounting, K.unmount_commands(db), as_of)
    return _together([
        _applied("mount", K.apply_mount(db, K.mount_commands(db), as_of), "id", c("remaining_weight")),
        _applied("unmount", closed.where(c("unmounted_at") == now), "id", c("status")),
        _applied("acclimatize", K.apply_acclimatize(db, K.acclimatize_commands(db), as_of), "id", c("status")),
        _applied("restore", K.apply_restore_mount(db, K.restore_mount_commands(db), as_of)["audit_log"], "record_id", _edit()),
        _applied("weight", K.apply_weight_update(db, K.weight_commands(db), as_of)["audit_log"], "record_id", _edit()),
        _applied("delete", K.apply_delete_acclimatization(db, K.delete_acclimatization_commands(db), as_of)["audit_log"],
                 "record_id", _edit())])


def applied_skus(db, as_of: str) -> DataFrame:
    """New skus, rejected ones, and the audited changes of skus and print specs."""
    made = K.apply_sku_create(db, K.sku_create_commands(db))
    return _together([
        _applied("create", made["new_skus"], "id", c("sku")), _rejected(made["rejected"], "sku"),
        _applied("update", K.apply_sku_update(db, K.sku_activity_changes(db), as_of)["audit_log"], "record_id", _edit()),
        _applied("specs", K.apply_print_specs(db, K.spec_commands(db), as_of)["audit_log"], "record_id", _edit())])


def applied_materials(db, as_of: str) -> DataFrame:
    """New lids, seals, spools and customers, and what was rejected."""
    lids = K.apply_new_lids(db, K.lid_commands(db), as_of)
    seals = KE.apply_new_seals(db, KE.seal_commands(db), as_of)
    spools = KE.apply_new_spools(db, KE.spool_commands(db), as_of)
    customers = K.apply_new_customers(db, K.customer_commands(db))
    return _together([
        _applied("lid", lids["lids"], "id", c("serial_number")), _applied("seal", seals["seals"], "id", c("serial_number")),
        _applied("spool", spools["filaments"], "id", c("serial_number")),
        _applied("customer", customers["customers"], "id", c("customer_name")),
        _rejected(lids["rejected"], "serial_number"), _rejected(seals["rejected"], "serial_number"),
        _rejected(customers["rejected"], "customer_name")])
