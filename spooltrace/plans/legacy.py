"""Legacy data-module queries (I1-I10) re-expressed on current columns.

The legacy modules compare statuses that the current vocabulary no longer
has ('In Acclimatization', 'In Interim Storage', print_status 'Printed').
They are mapped to their current equivalents (acclimatization status
'Acclimatizing', stage code 'InInterimStorage', stage code 'Printed').
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

ACCLIMATIZING = "Acclimatizing"
BUSY_ACCLIMATIZATION = ["Acclimatizing", "In Production"]


def active_filaments(db) -> DataFrame:
    """Spools not acclimatizing/in production as 'Storage', UNION (distinct) acclimatizing spools."""
    busy = db.filament_acclimatization.where(c("status").isin(*BUSY_ACCLIMATIZATION)).select(
        c("filament_tracking_id").alias("_b"))
    loc = db.storage_locations.select(c("id").alias("_l"), "location_name")
    storage = (db.filaments.join(busy, c("id") == c("_b"), "left_anti").join(loc, c("location_id") == c("_l"), "left")
               .select("serial_number", "qc_result", c("weight_grams").alias("initial_weight"), "received_at",
                       "location_name", F.lit("Storage").alias("status"),
                       F.lit(None).cast("timestamp_ntz").alias("moved_at"),
                       F.lit(None).cast("timestamp_ntz").alias("ready_at")))
    accl = (db.filaments.alias("f")
            .join(db.filament_acclimatization.alias("fa"), c("f.id") == c("fa.filament_tracking_id"))
            .join(loc, c("f.location_id") == c("_l"), "left")
            .where(c("fa.status") == ACCLIMATIZING)
            .select(c("f.serial_number").alias("serial_number"), c("f.qc_result").alias("qc_result"),
                    c("f.weight_grams").alias("initial_weight"), c("f.received_at").alias("received_at"),
                    c("location_name"), c("fa.status").alias("status"), c("fa.moved_at").alias("moved_at"),
                    c("fa.ready_at").alias("ready_at")))
    return storage.unionByName(accl).distinct()


def archived_filaments(db) -> DataFrame:
    """Unmounted mounts with spool, printer and unmounting user."""
    out = (db.filaments.alias("f")
           .join(db.filament_mounting.alias("fm"), c("f.id") == c("fm.filament_tracking_id"))
           .join(db.printers.alias("p"), c("fm.printer_id") == c("p.id"), "left")
           .join(db.users.alias("u"), c("fm.unmounted_by") == c("u.id"), "left")
           .where(c("fm.unmounted_at").isNotNull()))
    return out.select(c("f.serial_number").alias("serial_number"), c("f.qc_result").alias("qc_result"),
                      c("f.weight_grams").alias("initial_weight"), c("fm.remaining_weight").alias("remaining_weight"),
                      c("p.name").alias("printer_name"), c("fm.status").alias("status"),
                      c("fm.mounted_at").alias("mounted_at"), c("fm.unmounted_at").alias("unmounted_at"),
                      c("u.display_name").alias("unmounted_by"))


def in_use_filaments(db) -> DataFrame:
    """Open mounts with spool, printer, receiver and location."""
    out = (db.filaments.alias("f")
           .join(db.filament_mounting.alias("fm"), c("f.id") == c("fm.filament_tracking_id"))
           .join(db.printers.alias("p"), c("fm.printer_id") == c("p.id"))
           .join(db.users.alias("u"), c("f.received_by") == c("u.id"), "left")
           .join(db.storage_locations.alias("sl"), c("f.location_id") == c("sl.id"), "left")
           .where(c("fm.unmounted_at").isNull()))
    return out.select(c("f.id").alias("id"), c("f.serial_number").alias("serial_number"),
                      c("f.qc_result").alias("qc_result"), c("f.weight_grams").alias("initial_weight"),
                      c("fm.remaining_weight").alias("remaining_weight"), c("p.name").alias("printer_name"),
                      c("fm.mounted_at").alias("mounted_at"), c("f.received_at").alias("received_at"),
                      c("u.display_name").alias("received_by"), c("sl.location_name").alias("location_name"))


def filaments_with_mount(db) -> DataFrame:
    """I4: every spool with its open mount (the open-mount predicate sits in the join condition)."""
    out = (db.filaments.alias("f")
           .join(db.filament_mounting.alias("fm"),
                 (c("f.id") == c("fm.filament_tracking_id")) & c("fm.unmounted_at").isNull(), "left")
           .join(db.printers.alias("p"), c("fm.printer_id") == c("p.id"), "left")
           .join(db.storage_locations.alias("loc"), c("f.location_id") == c("loc.id"), "left")
           .join(db.users.alias("u"), c("f.received_by") == c("u.id"), "left"))
    return out.select(c("f.id").alias("id"), c("f.serial_number").alias("serial_number"),
                      c("f.weight_grams").alias("initial_weight"), c("fm.remaining_weight").alias("remaining_weight"),
                      c("f.qc_result").alias("qc_result"), c("f.received_at").alias("received_at"),
                      c("loc.location_name").alias("storage_location"), c("u.display_name").alias("received_by"),
                      c("p.name").alias("printer_name")).orderBy("id")


def low_filaments(db, threshold: int = 2500) -> DataFrame:
    """Mounts with less than ``threshold`` grams remaining."""
    out = (db.filament_mounting.alias("fm")
           .join(db.filaments.alias("f"), c("fm.filament_tracking_id") == c("f.id"))
           .join(db.printers.alias("p"), c("fm.printer_id") == c("p.id"))
           .where(c("fm.remaining_weight") < threshold))
    return out.select(c("fm.id").alias("id"), c("f.serial_number").alias("serial_number"),
                      c("fm.remaining_weight").alias("remaining_weight"), c("p.name").alias("printer_name"))


def not_acclimatizing(db) -> DataFrame:
    """PASS spools not in acclimatization or production."""
    busy = db.filament_acclimatization.where(c("status").isin(*BUSY_ACCLIMATIZATION)).select(
        c("filament_tracking_id").alias("_b"))
    return db.filaments.where(c("qc_result") == "PASS").join(busy, c("id") == c("_b"), "left_anti").select(
        "id", "serial_number")


def needs_storage_v1(db) -> DataFrame:
    """Units without location whose QC result is Passed/B-Ware/Quarantine and that are in no batch."""
    tbp = db.treatment_batch_products.select(c("product_tracking_id").alias("_t"))
    out = (db.product_tracking.alias("pt")
           .join(tbp, c("pt.id") == c("_t"), "left_anti")
           .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
           .join(db.product_quality_control.alias("pqc"), c("pqc.product_tracking_id") == c("pt.id"))
           .join(db.filament_mounting.alias("fm"), c("ph.filament_mounting_id") == c("fm.id"))
           .join(db.filaments.alias("f"), c("fm.filament_tracking_id") == c("f.id"))
           .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
           .join(db.product_skus.alias("s"), c("pr.sku_id") == c("s.id"))
           .join(db.product_types.alias("ptype"), c("s.product_type_id") == c("ptype.id"))
           .join(db.users.alias("u"), c("ph.printed_by") == c("u.id"), "left")
           .join(db.lifecycle_stages.alias("lc"), c("pt.current_stage_id") == c("lc.id"), "left")
           .where(c("pt.location_id").isNull() & c("pqc.inspection_result").isin("Passed", "B-Ware", "Quarantine")))
    return out.select(c("pt.id").alias("tracking_id"), c("lc.stage_name").alias("current_status"),
                      c("pt.location_id").alias("location_id"), c("ph.id").alias("harvest_id"),
                      c("pt.last_updated_at").alias("last_updated_at"),
                      c("pqc.inspection_result").alias("inspection_result"),
                      c("f.serial_number").alias("filament_serial"), c("ptype.name").alias("product_type"),
                      c("u.display_name").alias("printed_by"), c("ph.print_date").alias("print_date"))


def qc_passed_v1(db) -> DataFrame:
    """I8: units in interim storage that are in no treatment batch."""
    tbp = db.treatment_batch_products.select(c("product_tracking_id").alias("_t"))
    out = (db.product_tracking.alias("pt")
           .join(db.lifecycle_stages.alias("lc"), c("pt.current_stage_id") == c("lc.id"))
           .where(c("lc.stage_code") == "InInterimStorage")
           .join(tbp, c("pt.id") == c("_t"), "left_anti")
           .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
           .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
           .join(db.product_skus.alias("s"), c("pr.sku_id") == c("s.id"))
           .join(db.product_types.alias("ptype"), c("s.product_type_id") == c("ptype.id"))
           .join(db.product_quality_control.alias("pqc"), c("pqc.product_tracking_id") == c("pt.id"))
           .join(db.storage_locations.alias("loc"), c("pt.location_id") == c("loc.id"), "left"))
    return out.select(c("pt.id").alias("tracking_id"), c("lc.stage_name").alias("current_status"),
                      c("pt.last_updated_at").alias("last_updated_at"), c("ph.id").alias("harvest_id"),
                      c("ptype.name").alias("product_type"), c("pqc.inspection_result").alias("inspection_result"),
                      c("loc.location_name").alias("location_name"))


def printed_without_qc(db) -> DataFrame:
    """Harvests of units at stage 'Printed' that have no QC row, by print date."""
    qc = db.product_quality_control.select(c("product_tracking_id").alias("_q"))
    out = (db.product_harvest.alias("ph")
           .join(db.product_tracking.alias("pt"), c("pt.harvest_id") == c("ph.id"))
           .join(db.lifecycle_stages.alias("lc"), c("pt.current_stage_id") == c("lc.id"))
           .where(c("lc.stage_code") == "Printed")
           .join(qc, c("pt.id") == c("_q"), "left_anti")
           .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
           .join(db.product_skus.alias("s"), c("pr.sku_id") == c("s.id"))
           .join(db.product_types.alias("ty"), c("s.product_type_id") == c("ty.id"))
           .join(db.product_print_specs.alias("sp"), c("sp.sku_id") == c("s.id"), "left"))
    return out.select(c("ph.id").alias("harvest_id"), c("pr.id").alias("request_id"), c("ty.name").alias("product_type"),
                      c("sp.average_weight_g").alias("average_weight"), c("sp.weight_buffer_g").alias("buffer_weight"),
                      c("pr.lot_number").alias("lot_number"), c("ph.print_date").alias("print_date")).orderBy("print_date")


def product_record(db) -> DataFrame:
    """Every unit with its stage, location and post-treatment inspection flags."""
    out = (db.product_tracking.alias("pt")
           .join(db.post_treatment_inspections.alias("pti"), c("pt.id") == c("pti.product_tracking_id"), "left")
           .join(db.lifecycle_stages.alias("lc"), c("pt.current_stage_id") == c("lc.id"), "left"))
    return out.select(c("pt.id").alias("tracking_id"), c("lc.stage_name").alias("current_status"),
                      c("pt.location_id").alias("location_id"), c("pti.visual_pass").alias("visual_pass"),
                      c("pti.surface_treated").alias("surface_treated"), c("pti.sterilized").alias("sterilized"),
                      c("pti.qc_result").alias("qc_result"))


# Tables whose records may be read one by one.
RECORD_TABLES = ["filaments", "filament_mounting", "filament_acclimatization", "lids", "seals", "product_requests",
                 "product_harvest", "product_quality_control", "product_tracking", "treatment_batches",
                 "treatment_batch_products", "post_treatment_inspections"]


def record_by_id(db, table: str, record_id: int) -> DataFrame:
    """I10 (by id): the record as one row per field (position, field, value as text); no row if there is none.

    Only ``RECORD_TABLES`` may be read; the id reaches the scan as a filter.
    """
    if table not in RECORD_TABLES:
        raise ValueError(f"{table!r} is not open to look-ups by id")
    rows = getattr(db, table).where(c("id") == record_id)
    return rows.select(F.posexplode(F.array(*[
        F.struct(F.lit(x).alias("field"), c(x).cast("string").alias("value")) for x in rows.columns])).alias("position", "f")
    ).select("position", "f.field", "f.value")
