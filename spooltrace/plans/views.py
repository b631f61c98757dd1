"""Reporting views (D1-D7) and the canned queries re-expressed on current columns.

Join order follows the partitioning: satellite tables keyed by the unit id
(QC, batch link, inspection, shipment link) are joined to the unit table one
after another on ``product_tracking.id`` so one hash partitioning serves all
of them; satellites are pre-joined to their own parents first. Literal dims
carry a broadcast hint from ``Tables``; data-sized dims (users, customers)
are left to AQE's runtime size check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.functions import exprs as X
from spooltrace.operators.ranking import row_number_global
from spooltrace.session import written_once

c = F.col


def _shipment_links(db) -> DataFrame:
    """shipment_unit_items LEFT JOIN shipments, keyed by unit."""
    si = db.shipment_unit_items.alias("si")
    s = db.shipments.alias("s")
    return si.join(s, c("si.shipment_id") == c("s.id"), "left")


def used_rows(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """Rows of ``dim`` whose id occurs in the fact's ``key``.

    A few users, lids or mounts can serve most rows of a fact. Reduced to the
    ids in use (a distinct that collapses before the shuffle), such a dimension
    is small enough for AQE to broadcast after measuring it, however large the
    whole table is, and the fact is not gathered on a few hot keys.
    """
    return dim.join(fact.select(c(key).alias("_used")).distinct(), c("id") == c("_used"), "left_semi")


def v_product_lifecycle(db) -> DataFrame:
    """One row per unit x QC x batch link x inspection x shipment link (1:N joins fan out)."""
    tbp = db.treatment_batch_products.alias("tbp").join(
        db.treatment_batches.alias("tb"), c("tbp.batch_id") == c("tb.id"), "left")
    harvest = (db.product_harvest.alias("ph")
               .join(used_rows(db.users, db.product_harvest, "printed_by").alias("u"), c("ph.printed_by") == c("u.id"), "left")
               .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"), "left")
               .join(db.product_skus.alias("ps"), c("pr.sku_id") == c("ps.id"), "left")
               .join(db.product_types.alias("ptype"), c("ps.product_type_id") == c("ptype.id"), "left"))
    out = (db.product_tracking.alias("pt")
           .join(db.product_quality_control.alias("pqc"), c("pqc.product_tracking_id") == c("pt.id"), "left")
           .join(tbp, c("tbp.product_tracking_id") == c("pt.id"), "left")
           .join(db.post_treatment_inspections.alias("pti"), c("pti.product_tracking_id") == c("pt.id"), "left")
           .join(_shipment_links(db), c("si.product_tracking_id") == c("pt.id"), "left")
           .join(harvest, c("pt.harvest_id") == c("ph.id"), "left")
           .join(db.lifecycle_stages.alias("lc"), c("pt.current_stage_id") == c("lc.id"), "left")
           .join(db.storage_locations.alias("loc"), c("pt.location_id") == c("loc.id"), "left"))
    return out.select(
        c("pt.id").alias("id"), c("pt.product_id").alias("product_id"), c("lc.stage_name").alias("current_status"),
        c("pt.last_updated_at").alias("last_updated_at"), c("loc.location_name").alias("location_name"),
        c("pr.id").alias("request_id"), c("ptype.name").alias("product_type_name"), c("ps.sku").alias("sku"),
        c("pr.status").alias("request_status"), c("pr.requested_at").alias("requested_at"),
        c("ph.id").alias("harvest_id"), c("ph.print_date").alias("print_date"), c("u.display_name").alias("printed_by"),
        c("pqc.inspection_result").alias("initial_qc_result"), c("pqc.weight_grams").alias("weight_grams"),
        c("pqc.pressure_drop").alias("pressure_drop"), c("pqc.visual_pass").alias("visual_pass"),
        c("tb.id").alias("treatment_batch_id"), c("tb.status").alias("treatment_status"),
        c("tb.sent_at").alias("treatment_sent_at"), c("pti.qc_result").alias("final_qc_result"),
        c("pti.sterilized").alias("treatment_sterilized"),
        c("s.id").alias("shipment_id"), c("s.status").alias("shipment_status"), c("s.ship_date").alias("ship_date"),
        c("s.delivery_date").alias("delivery_date"), c("s.tracking_number").alias("tracking_number"),
        c("s.carrier").alias("carrier"),
    )


def v_filament_status(db) -> DataFrame:
    """Spool status with precedence In Use > Unmounted > Acclimatizing > Unmounted(date) > In Storage."""
    out = (db.filaments.alias("f")
           .join(db.filament_mounting.alias("fm"), c("fm.filament_tracking_id") == c("f.id"), "left")
           .join(db.printers.alias("p"), c("p.id") == c("fm.printer_id"), "left")
           .join(db.filament_acclimatization.alias("fa"), c("fa.filament_tracking_id") == c("f.id"), "left")
           .join(db.users.alias("u"), c("f.received_by") == c("u.id"), "left")
           .join(db.storage_locations.alias("sl"), c("f.location_id") == c("sl.id"), "left"))
    status = (F.when(c("fm.status") == "In Use", "In Use")
              .when(c("fm.status") == "Unmounted", "Unmounted")
              .when(c("fa.status") == "Acclimatizing", "Acclimatizing")
              .when(c("fm.unmounted_at").isNotNull(), "Unmounted")
              .otherwise("In Storage"))
    return out.select(
        c("f.id").alias("id"), c("f.filament_id").alias("filament_id"), c("f.lot_number").alias("lot_number"),
        c("f.serial_number").alias("serial_number"), c("sl.location_name").alias("location_name"),
        status.alias("current_status"), c("f.weight_grams").alias("initial_weight"),
        c("fm.remaining_weight").alias("remaining_weight"), c("f.qc_result").alias("qc_result"),
        c("f.received_at").alias("received_at"), c("u.display_name").alias("received_by_name"),
        c("fm.id").alias("filament_mounting_id"), c("fm.printer_id").alias("printer_id"),
        c("p.name").alias("printer_name"), c("fm.mounted_at").alias("mounted_at"),
        c("fm.unmounted_at").alias("unmounted_at"), c("fa.moved_at").alias("acclimatized_at"),
        c("fa.ready_at").alias("ready_at"),
    )


def _material_inventory(db, table: DataFrame, id_name: str, legacy_serial: str) -> DataFrame:
    out = (table.alias("m")
           .join(db.users.alias("u"), c("m.received_by") == c("u.id"), "left")
           .join(db.storage_locations.alias("s"), c("m.location_id") == c("s.id"), "left")
           .where(c("m.serial_number") != legacy_serial))
    return out.select(
        c("m.id").alias(id_name), c("m.serial_number").alias("serial_number"), c("m.quantity").alias("quantity"),
        c("m.qc_result").alias("qc_result"), c("m.received_at").alias("received_at"),
        c("u.display_name").alias("received_by"), c("s.location_name").alias("location_name"))


def v_lid_inventory(db) -> DataFrame:
    """D3: lids with receiver and location, legacy placeholder hidden."""
    return _material_inventory(db, db.lids, "lid_id", "LEGACY_LID")


def v_seal_inventory(db) -> DataFrame:
    """Seals with receiver and location, legacy placeholder hidden."""
    return _material_inventory(db, db.seals, "seal_id", "LEGACY_SEAL")


def v_product_status(db) -> DataFrame:
    """Unit status with sku/type taken from the unit, falling back to its request."""
    mount = (used_rows(db.filament_mounting, db.product_harvest, "filament_mounting_id").alias("fm")
             .join(db.filaments.alias("f"), c("fm.filament_tracking_id") == c("f.id"), "left")
             .join(db.printers.alias("p"), c("fm.printer_id") == c("p.id"), "left"))
    harvest = (db.product_harvest.alias("ph")
               .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
               .join(used_rows(db.users, db.product_harvest, "printed_by").alias("printed_user"),
                     c("ph.printed_by") == c("printed_user.id"))
               .join(db.product_skus.alias("sku_req"), c("pr.sku_id") == c("sku_req.id"), "left")
               .join(db.product_types.alias("ptype_req"), c("sku_req.product_type_id") == c("ptype_req.id"), "left")
               .join(used_rows(db.lids, db.product_harvest, "lid_id").alias("l"), c("ph.lid_id") == c("l.id"), "left")
               .join(mount, c("ph.filament_mounting_id") == c("fm.id"), "left"))
    qc = (db.product_quality_control.alias("qc")
          .join(used_rows(db.users, db.product_quality_control, "inspected_by").alias("qc_user"),
                c("qc.inspected_by") == c("qc_user.id"), "left"))
    out = (db.product_tracking.alias("pt")
           .join(qc, c("qc.product_tracking_id") == c("pt.id"), "left")
           .join(db.treatment_batch_products.alias("tbi"), c("tbi.product_tracking_id") == c("pt.id"), "left")
           .join(db.post_treatment_inspections.alias("pti"), c("pti.product_tracking_id") == c("pt.id"), "left")
           .join(_shipment_links(db), c("si.product_tracking_id") == c("pt.id"), "left")
           .join(harvest, c("pt.harvest_id") == c("ph.id"))
           .join(db.product_skus.alias("sku_pt"), c("pt.sku_id") == c("sku_pt.id"), "left")
           .join(db.product_types.alias("ptype_pt"), c("sku_pt.product_type_id") == c("ptype_pt.id"), "left")
           .join(db.lifecycle_stages.alias("lc"), c("pt.current_stage_id") == c("lc.id"), "left")
           .join(db.product_statuses.alias("ps"), c("pt.current_status_id") == c("ps.id"), "left")
           .join(db.storage_locations.alias("loc"), c("pt.location_id") == c("loc.id"), "left"))
    return out.select(
        c("pt.id").alias("id"), c("pt.product_id").alias("product_id"), c("lc.stage_name").alias("current_stage"),
        c("ps.status_name").alias("current_status"), c("loc.location_name").alias("location_name"),
        c("pt.last_updated_at").alias("last_updated_at"),
        F.coalesce(c("ptype_pt.name"), c("ptype_req.name")).alias("product_type"),
        F.coalesce(c("sku_pt.sku"), c("sku_req.sku")).alias("sku"),
        c("pt.was_tech_transfer").alias("was_tech_transfer"),
        c("ph.id").alias("harvest_id"), c("pr.lot_number").alias("lot_number"), c("ph.print_date").alias("print_date"),
        c("printed_user.display_name").alias("printed_by"), c("l.serial_number").alias("lid_serial_number"),
        c("qc.inspection_result").alias("qc_result"), c("qc.weight_grams").alias("weight_grams"),
        c("qc.pressure_drop").alias("pressure_drop"), c("qc.visual_pass").alias("visual_pass"),
        c("qc.notes").alias("qc_notes"), c("qc_user.display_name").alias("qc_inspected_by"),
        c("f.serial_number").alias("filament"), c("p.name").alias("printer"),
        c("tbi.batch_id").alias("treatment_batch_id"), c("pti.qc_result").alias("post_treatment_result"),
        c("s.id").alias("shipment_id"), c("s.status").alias("shipment_status"), c("s.delivery_date").alias("delivery_date"),
    )


def product_status_tracker(db) -> DataFrame:
    """The product status view, newest update first."""
    return v_product_status(db).orderBy(c("last_updated_at").desc())


def v_material_usage_summary(db) -> DataFrame:
    """Usage rows with harvest, unit, product type (via request sku) and user."""
    harvest = (db.product_harvest.alias("ph")
               .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"), "left")
               .join(db.product_skus.alias("sku"), c("pr.sku_id") == c("sku.id"), "left")
               .join(db.product_types.alias("ptype"), c("sku.product_type_id") == c("ptype.id"), "left"))
    out = (db.material_usage.alias("mu")
           .join(harvest, c("mu.harvest_id") == c("ph.id"), "left")
           .join(db.product_tracking.alias("pt"), c("mu.product_tracking_id") == c("pt.id"), "left")
           .join(used_rows(db.users, db.material_usage, "used_by").alias("u"), c("mu.used_by") == c("u.id"), "left"))
    return out.select(
        c("mu.id").alias("usage_id"), c("mu.material_type").alias("material_type"),
        c("mu.lot_number").alias("lot_number"), c("mu.used_quantity").alias("used_quantity"),
        c("mu.harvest_id").alias("harvest_id"), c("ph.print_date").alias("print_date"),
        c("mu.product_tracking_id").alias("product_tracking_id"), c("pt.product_id").alias("product_id"),
        c("ptype.name").alias("product_type"), c("u.display_name").alias("used_by"))


# Process step text -> lifecycle stage id (positions in the seeded stage list).
LEGACY_STEP_STAGE = [
    ("SOLD", 12),
    ("SALES", 8),
    ("NOT USABLE", 10),
    ("INTERNAL", 13),
    ("IN TREATMENT", 5),
    ("INTERIM STORAGE", 4),
]
LEGACY_PRODUCTS = ["10K", "6K", "CS MINI"]


def _with_cells(sheet: DataFrame, cells: dict[str, tuple[str, Callable]]) -> DataFrame:
    """``sheet`` with parsed cells: name -> (the sheet's column, its parser); columns that a sheet lacks have none."""
    return sheet.select("*", *[parse(c(x)).alias(name) for name, (x, parse) in cells.items() if x in sheet.columns])


def _production_cells(sheet: DataFrame) -> DataFrame:
    return _with_cells(sheet, {
        "product_id_int": ("product_id", X.parse_bigint_strict), "filament_id_int": ("filament_id", X.parse_bigint_strict),
        "harvest_ts": ("date_harvest", X.parse_ts_generic), "transfer_key": ("transfer_id", X.clean_key)})


def production_sheet(db) -> DataFrame:
    """The production sheet with the cells that several steps filter on parsed once, written by its first reader."""
    return written_once(db, "stg_excel_data", _production_cells)


def _spool_cells(sheet: DataFrame) -> DataFrame:
    # few bytes a row, but much parsing: dealt to all cores, since small files are read by few tasks
    return _with_cells(sheet.repartition(*sheet.columns), {
        "spool_id": ("filament_id", X.parse_bigint), "spool_id_int": ("filament_id", X.parse_bigint_strict),
        "vsc_ts": ("vsc_date", X.parse_date_de), "vsc_ts_any": ("vsc_date", X.parse_date_multi)})


def spool_sheet(db) -> DataFrame:
    """The spool sheet with ids and dates parsed once, written by its first reader in files for all cores."""
    return written_once(db, "stg_filament_excel_data", _spool_cells)


def v_unified_legacy_prints(db, cutoff: str) -> DataFrame:
    """Valid legacy print rows since ``cutoff``, resolved to spool mount, type, sku, status, stage.

    ``harvest_seq`` is a global row number by product id (ties broken by the
    remaining columns so it is deterministic), assigned without a
    single-partition window.
    """
    sed = production_sheet(db)
    valid = (sed.where(c("product_id_int").isNotNull() & c("filament_id_int").isNotNull()
                       & c("status_quality_check").isNotNull()
                       & F.trim(c("product")).isin(*LEGACY_PRODUCTS)
                       & (c("harvest_ts").cast("date") >= F.to_date(F.lit(cutoff))))
             .select(
                 c("product_id_int").alias("product_id_bigint"),
                 c("filament_id_int").alias("filament_id_bigint"),
                 F.trim(c("printer")).alias("printer_name"),
                 F.trim(c("operator_harvest")).alias("operator_name"),
                 c("harvest_ts").alias("print_date_dt"),
                 c("harvest_ts").cast("date").alias("print_date_d"),
                 F.trim(c("product")).alias("product_name"),
                 F.trim(c("storage")).alias("storage_name"),
                 F.upper(F.trim(c("status_quality_check"))).alias("qc"),
                 F.upper(F.trim(F.coalesce(c("second_rate_goods"), F.lit("")))).alias("second_rate"),
                 F.upper(F.trim(F.coalesce(c("prozess_step"), F.lit("")))).alias("step_u"))
             .distinct())
    f = db.filaments.select(c("id").alias("filament_tracking_id"), c("filament_id").alias("_f_fid"))
    p = db.printers.select(c("id").alias("printer_id"), F.trim(c("name")).alias("_p_name"))
    fm = db.filament_mounting.select(c("id").alias("filament_mounting_id"), c("filament_tracking_id").alias("_fm_f"),
                                     c("printer_id").alias("_fm_p"))
    t = db.product_types.select(c("id").alias("product_type_id"), F.trim(c("name")).alias("_t_name"))
    min_sku = db.product_skus.groupBy(c("product_type_id").alias("_s_type")).agg(F.min("id").alias("sku_id"))
    status_ids = db.product_statuses.groupBy(c("status_name").alias("_st_name")).agg(F.min("id").alias("_st_id"))
    # mounts meet their spools and printers first: the prints, which are many more, are then dealt once
    mounts = f.join(fm, c("_fm_f") == c("filament_tracking_id")).join(p, c("_fm_p") == c("printer_id"))
    j = (valid.join(mounts, (c("filament_id_bigint") == c("_f_fid")) & (c("printer_name") == c("_p_name")))
         .join(t, c("_t_name") == F.trim(c("product_name")))
         .join(F.broadcast(min_sku), c("_s_type") == c("product_type_id"), "left")
         .join(db.users.select(c("id").alias("_u_id"), c("display_name").alias("_u_name")),
               c("_u_name") == c("operator_name"), "left")
         .withColumn("_st_want", X.legacy_status_name(c("qc"), c("second_rate")))
         .join(F.broadcast(status_ids), c("_st_want") == c("_st_name"), "left"))
    stage = None
    for step, sid in LEGACY_STEP_STAGE:
        stage = F.when(c("step_u") == step, F.lit(sid)) if stage is None else stage.when(c("step_u") == step, F.lit(sid))
    stage = stage.otherwise(1).cast("long")
    resolved = j.select(
        "product_id_bigint", "filament_id_bigint", "filament_tracking_id", "printer_id", "filament_mounting_id",
        "operator_name", F.coalesce(c("_u_id"), F.lit(1).cast("long")).alias("printed_by_id"),
        "print_date_dt", "print_date_d", "product_name", "storage_name", "qc", "second_rate", "step_u",
        "product_type_id", "sku_id", c("_st_id").alias("current_status_id"), stage.alias("current_stage_id"))
    return row_number_global(resolved, ["product_id_bigint", "filament_mounting_id", "printed_by_id",
                                        "print_date_dt", "storage_name", "qc", "second_rate", "step_u"],
                             col="harvest_seq")


# ---------------------------------------------------------------------------
# D8-D15 canned queries
# ---------------------------------------------------------------------------

def q_approved_not_shipped(db, approved: str = "Passed") -> DataFrame:
    """Lifecycle rows whose final result is ``approved`` and that have no shipment."""
    v = v_product_lifecycle(db)
    return v.where((c("final_qc_result") == approved) & c("shipment_status").isNull())


def q_pending_initial_qc(db) -> DataFrame:
    """Printed units with no QC row."""
    qc = db.product_quality_control.select(c("product_tracking_id").alias("_qc_pt"))
    out = (db.product_tracking.alias("pt")
           .join(qc, c("pt.id") == c("_qc_pt"), "left_anti")
           .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
           .join(db.users.alias("u"), c("ph.printed_by") == c("u.id")))
    return out.select(c("pt.id").alias("product_id"), c("ph.print_date").alias("print_date"),
                      c("u.display_name").alias("printed_by"))


def q_failed_initial_qc(db, results=("B-Ware", "Waste")) -> DataFrame:
    """Units whose QC result is in ``results``."""
    out = (db.product_tracking.alias("pt")
           .join(db.product_quality_control.alias("pqc"), c("pqc.product_tracking_id") == c("pt.id"))
           .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
           .where(c("pqc.inspection_result").isin(*results)))
    return out.select(c("pt.id").alias("product_id"), c("pqc.inspection_result").alias("inspection_result"))


def q_waiting_treatment(db, passed: str = "Passed") -> DataFrame:
    """QC-passed units that are in no treatment batch."""
    tbp = db.treatment_batch_products.select(c("product_tracking_id").alias("_tbp_pt"))
    out = (db.product_tracking.alias("pt")
           .join(db.product_quality_control.alias("pqc"), c("pqc.product_tracking_id") == c("pt.id"))
           .where(c("pqc.inspection_result") == passed)
           .join(tbp, c("pt.id") == c("_tbp_pt"), "left_anti")
           .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
           .join(db.product_statuses.alias("ps"), c("pt.current_status_id") == c("ps.id"), "left"))
    return out.select(c("pt.id").alias("id"), c("ps.status_name").alias("current_status"))


def q_in_treatment(db, statuses=("Shipped", "In Transit")) -> DataFrame:
    """Units whose batch is out for treatment."""
    tb = db.treatment_batches.where(c("status").isin(*statuses)).alias("tb")
    out = (db.treatment_batch_products.alias("tbp").join(tb, c("tbp.batch_id") == c("tb.id"))
           .join(db.product_tracking.alias("pt"), c("tbp.product_tracking_id") == c("pt.id")))
    return out.select(c("pt.id").alias("id"), c("tb.status").alias("status"), c("tb.sent_at").alias("sent_at"))


def q_treatment_failures(db, rejected=("Waste",)) -> DataFrame:
    """Units whose post-treatment inspection result is in ``rejected``."""
    out = (db.post_treatment_inspections.alias("pti").where(c("pti.qc_result").isin(*rejected))
           .join(db.product_tracking.alias("pt"), c("pti.product_tracking_id") == c("pt.id")))
    return out.select(c("pt.id").alias("id"), c("pti.qc_result").alias("final_result"))


def q_low_inventory_spools(db, threshold: int = 200) -> DataFrame:
    """Spools whose weight minus the QC weight of all units printed from them is below ``threshold``.

    QC weight is summed per mount before joining to mounts and spools: the
    per-harvest mount key is hot (few mounts, many prints), and a partial
    aggregate collapses it map-side instead of shuffling every print row.
    """
    per_mount = (db.product_quality_control.alias("pqc")
                 .join(db.product_tracking.alias("pt"), c("pqc.product_tracking_id") == c("pt.id"))
                 .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
                 .groupBy(c("ph.filament_mounting_id").alias("_fm_id"))
                 .agg(F.sum("pqc.weight_grams").alias("_w")))
    per_spool = (db.filament_mounting.alias("fm").join(per_mount, c("fm.id") == c("_fm_id"))
                 .groupBy(c("fm.filament_tracking_id").alias("_f_id")).agg(F.sum("_w").alias("_used")))
    out = db.filaments.alias("f").join(per_spool, c("f.id") == c("_f_id"))
    cur = (c("f.weight_grams") - F.coalesce(c("_used"), F.lit(0))).cast("decimal(18,2)")
    return out.select(c("f.id").alias("id"), c("f.serial_number").alias("name"), cur.alias("current_weight")).where(
        c("current_weight") < threshold)


def q_product_status_v1(db) -> DataFrame:
    """Older status view: type via the request's sku only, printed-by user required."""
    harvest = (db.product_harvest.alias("ph")
               .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
               .join(db.product_skus.alias("sku"), c("pr.sku_id") == c("sku.id"))
               .join(db.product_types.alias("ptype"), c("sku.product_type_id") == c("ptype.id"))
               .join(db.users.alias("u"), c("ph.printed_by") == c("u.id")))
    out = (db.product_tracking.alias("pt")
           .join(db.product_quality_control.alias("qc"), c("qc.product_tracking_id") == c("pt.id"), "left")
           .join(db.treatment_batch_products.alias("tbi"), c("tbi.product_tracking_id") == c("pt.id"), "left")
           .join(db.post_treatment_inspections.alias("pti"), c("pti.product_tracking_id") == c("pt.id"), "left")
           .join(_shipment_links(db), c("si.product_tracking_id") == c("pt.id"), "left")
           .join(harvest, c("pt.harvest_id") == c("ph.id"))
           .join(db.product_statuses.alias("st"), c("pt.current_status_id") == c("st.id"), "left"))
    return out.select(
        c("pt.id").alias("tracking_id"), c("st.status_name").alias("current_status"),
        c("pt.last_updated_at").alias("last_updated_at"), c("pr.id").alias("request_id"),
        c("pr.lot_number").alias("lot_number"), c("ptype.name").alias("product_type"),
        c("pr.status").alias("request_status"), c("pr.requested_at").alias("requested_at"),
        c("ph.id").alias("harvest_id"), c("ph.print_date").alias("print_date"), c("u.display_name").alias("printed_by"),
        c("qc.inspection_result").alias("qc_result"), c("qc.weight_grams").alias("weight_grams"),
        c("qc.visual_pass").alias("visual_pass"), c("tbi.batch_id").alias("treatment_batch_id"),
        c("pti.qc_result").alias("post_treatment_result"), c("s.id").alias("shipment_id"),
        c("s.status").alias("shipment_status"), c("s.delivery_date").alias("delivery_date"))
