"""Production, inspection, logistics and quality queries.

Unit-level queries start from ``product_tracking`` and join harvest and
request on their keys (1:1); QC/inspection/quarantine satellites are joined
on the unit id. Rule tables (shelf keywords, stage rules, labels) are
literal and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.functions import exprs as X
from spooltrace.functions import rules as R
from spooltrace.operators.sampling import smallest_share
from spooltrace.session import broadcast_if_small

c = F.col


def _unit_base(db) -> DataFrame:
    """product_tracking JOIN harvest JOIN request JOIN sku (by the unit's sku)."""
    return (db.product_tracking.alias("pt")
            .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
            .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
            .join(db.product_skus.alias("ps"), c("ps.id") == c("pt.sku_id")))


def _stage(db, alias: str = "lc") -> DataFrame:
    return db.lifecycle_stages.alias(alias)


def requestable_skus(db) -> DataFrame:
    """G1: active skus that are serialized or bundles, by name."""
    return (db.product_skus.where(c("is_active") & (c("is_serialized") | c("is_bundle")))
            .select("id", "sku", "name", "is_bundle", "pack_qty").orderBy("name"))


def pending_requests(db) -> DataFrame:
    """Pending non-legacy requests with sku, requester and print spec, oldest first."""
    out = (db.product_requests.alias("pr").where((c("pr.status") == "Pending") & (c("pr.lot_number") != "LEGACY_LOT"))
           .join(db.product_skus.alias("ps"), c("ps.id") == c("pr.sku_id"))
           .join(db.product_print_specs.alias("sps"), c("sps.sku_id") == c("ps.id"), "left")
           .join(db.users.alias("u"), c("u.id") == c("pr.requested_by")))
    return out.select(c("pr.id").alias("id"), c("ps.sku").alias("sku"), c("ps.name").alias("sku_name"),
                      c("u.display_name").alias("requested_by"), c("pr.lot_number").alias("lot_number"),
                      c("pr.status").alias("status"), c("pr.requested_at").alias("requested_at"),
                      c("pr.is_tech_transfer").alias("is_tech_transfer"),
                      c("sps.average_weight_g").alias("average_weight_g"),
                      c("sps.weight_buffer_g").alias("weight_buffer_g")).orderBy("requested_at")


def harvested_products(db) -> DataFrame:
    """Harvests with request, sku, spool, printer, lid and printer operator, newest first."""
    out = (db.product_harvest.alias("ph")
           .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
           .join(db.product_skus.alias("ps"), c("pr.sku_id") == c("ps.id"))
           .join(db.filament_mounting.alias("fm"), c("ph.filament_mounting_id") == c("fm.id"))
           .join(db.filaments.alias("f"), c("fm.filament_tracking_id") == c("f.id"))
           .join(db.printers.alias("p"), c("fm.printer_id") == c("p.id"))
           .join(db.lids.alias("l"), c("ph.lid_id") == c("l.id"))
           .join(db.users.alias("u"), c("ph.printed_by") == c("u.id")))
    return out.select(c("ph.id").alias("harvest_id"), c("ph.filament_mounting_id").alias("mount_id"),
                      c("ph.lid_id").alias("lid_id"), c("ph.seal_id").alias("seal_id"),
                      c("pr.id").alias("request_id"), c("ps.sku").alias("sku"), c("ps.name").alias("sku_name"),
                      c("f.serial_number").alias("filament_serial"), c("p.name").alias("printer_name"),
                      c("l.serial_number").alias("lid_serial"), c("u.display_name").alias("printed_by"),
                      c("ph.print_date").alias("print_date")).orderBy(c("print_date").desc())


def printed_pending_qc(db) -> DataFrame:
    """Units at stage order 1 (printed), not legacy, with spec and printer."""
    out = (db.product_tracking.alias("pt")
           .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
           .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
           .join(db.product_skus.alias("ps"), c("ps.id") == c("pr.sku_id"))
           .join(db.product_print_specs.alias("sps"), c("sps.sku_id") == c("ps.id"), "left")
           .join(_stage(db), c("pt.current_stage_id") == c("lc.id"), "left")
           .join(db.filament_mounting.alias("fm"), c("ph.filament_mounting_id") == c("fm.id"), "left")
           .join(db.printers.alias("p"), c("fm.printer_id") == c("p.id"), "left")
           .where((c("lc.stage_order") == 1) & (c("pr.lot_number") != "LEGACY_LOT")))
    return out.select(c("pt.id").alias("id"), c("pt.product_id").alias("product_id"),
                      c("pt.harvest_id").alias("harvest_id"), c("pr.id").alias("request_id"),
                      c("ps.sku").alias("sku"), c("ps.name").alias("sku_name"),
                      c("sps.average_weight_g").alias("average_weight_g"),
                      c("sps.weight_buffer_g").alias("weight_buffer_g"), c("pr.lot_number").alias("lot_number"),
                      c("p.name").alias("printer"), c("ph.print_date").alias("print_date")).orderBy("print_date")


def completed_qc(db) -> DataFrame:
    """QC rows with unit, harvest, sku and lot, newest QC id first."""
    out = (db.product_quality_control.alias("qc")
           .join(db.product_tracking.alias("pt"), c("qc.product_tracking_id") == c("pt.id"))
           .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
           .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
           .join(db.product_skus.alias("ps"), c("pr.sku_id") == c("ps.id")))
    return out.select(c("qc.id").alias("qc_id"), c("pt.id").alias("id"), c("pt.product_id").alias("product_id"),
                      c("ph.id").alias("harvest_id"), c("ps.sku").alias("sku"), c("ps.name").alias("sku_name"),
                      c("pr.lot_number").alias("lot_number"), c("qc.weight_grams").alias("weight_grams"),
                      c("qc.pressure_drop").alias("pressure_drop"), c("qc.visual_pass").alias("visual_pass"),
                      c("qc.inspection_result").alias("inspection_result"), c("qc.notes").alias("notes"),
                      c("ph.print_date").alias("print_date")).orderBy(c("qc_id").desc())


def completed_post_treatment_qc(db) -> DataFrame:
    """Post-treatment inspections with product type (via the request's sku), newest first."""
    out = (db.post_treatment_inspections.alias("pti")
           .join(db.product_tracking.alias("t"), c("pti.product_tracking_id") == c("t.id"))
           .join(db.product_harvest.alias("ph"), c("t.harvest_id") == c("ph.id"))
           .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
           .join(db.product_skus.alias("s"), c("pr.sku_id") == c("s.id"))
           .join(db.product_types.alias("ty"), c("s.product_type_id") == c("ty.id")))
    return out.select(c("pti.id").alias("inspection_id"), c("pti.product_tracking_id").alias("product_tracking_id"),
                      c("ty.name").alias("product_type"), c("pti.surface_treated").alias("surface_treated"),
                      c("pti.sterilized").alias("sterilized"), c("pti.visual_pass").alias("visual_pass"),
                      c("pti.qc_result").alias("qc_result"), c("pti.inspected_by").alias("inspected_by"),
                      c("pti.inspected_at").alias("inspected_at")).orderBy(c("inspected_at").desc())


def qc_evaluation(db) -> DataFrame:
    """Harvest QC rule (F20) over every printed unit with a measured weight and pressure.

    The measurements are the unit's recorded QC row (command input); spec
    comes from the unit's request sku.
    """
    g4 = printed_pending_qc(db)
    qc = db.product_quality_control.select(c("product_tracking_id").alias("_pt"), "weight_grams", "pressure_drop")
    out = g4.join(qc, g4.id == qc._pt)
    return out.select("id", "product_id", "sku", "weight_grams", "pressure_drop",
                      X.harvest_qc_rule(c("weight_grams"), c("pressure_drop"), c("average_weight_g"),
                                        c("weight_buffer_g")).alias("suggested_result"))


def treatment_candidates(db) -> DataFrame:
    """Units at stage QMTreatmentApproval with QC result, status and location."""
    out = (_unit_base(db)
           .join(_stage(db), c("pt.current_stage_id") == c("lc.id"))
           .join(db.product_quality_control.alias("qc"), c("qc.product_tracking_id") == c("pt.id"))
           .join(db.product_statuses.alias("st"), c("st.id") == c("pt.current_status_id"))
           .join(db.storage_locations.alias("loc"), c("pt.location_id") == c("loc.id"), "left")
           .where(c("lc.stage_code") == "QMTreatmentApproval"))
    return out.select(c("pt.id").alias("id"), c("pt.product_id").alias("product_id"),
                      c("lc.stage_name").alias("current_stage"), c("st.status_name").alias("current_status"),
                      c("pt.last_updated_at").alias("last_updated_at"), c("ph.id").alias("harvest_id"),
                      c("ps.sku").alias("sku"), c("ps.name").alias("sku_name"),
                      c("qc.inspection_result").alias("inspection_result"),
                      c("loc.location_name").alias("location_name")).orderBy(c("last_updated_at").desc())


def needs_storage_harvest(db) -> DataFrame:
    """Units at HarvestQCComplete without a location."""
    out = (_unit_base(db)
           .join(_stage(db), c("pt.current_stage_id") == c("lc.id"))
           .join(db.product_quality_control.alias("qc"), c("qc.product_tracking_id") == c("pt.id"))
           .join(db.filament_mounting.alias("fm"), c("ph.filament_mounting_id") == c("fm.id"))
           .join(db.filaments.alias("f"), c("fm.filament_tracking_id") == c("f.id"))
           .join(db.users.alias("u"), c("ph.printed_by") == c("u.id"), "left")
           .where((c("lc.stage_code") == "HarvestQCComplete") & c("pt.location_id").isNull()))
    return out.select(c("pt.id").alias("id"), c("pt.product_id").alias("product_id"),
                      c("lc.stage_name").alias("current_stage_name"), c("pt.location_id").alias("location_id"),
                      c("ph.id").alias("harvest_id"), c("pt.last_updated_at").alias("last_updated_at"),
                      c("qc.inspection_result").alias("inspection_result"),
                      c("f.serial_number").alias("filament_serial"), c("ps.sku").alias("sku"),
                      c("ps.name").alias("sku_name"), c("u.display_name").alias("printed_by"),
                      c("ph.print_date").alias("print_date")).orderBy(c("last_updated_at").desc())


def needs_storage_treatment(db) -> DataFrame:
    """Units at PostTreatmentQC with their inspection result."""
    out = (_unit_base(db)
           .join(db.post_treatment_inspections.alias("pti"), c("pt.id") == c("pti.product_tracking_id"))
           .join(_stage(db), c("pt.current_stage_id") == c("lc.id"))
           .where(c("lc.stage_code") == "PostTreatmentQC"))
    return out.select(c("pt.id").alias("id"), c("pt.product_id").alias("product_id"), c("ph.id").alias("harvest_id"),
                      c("ps.sku").alias("sku"), c("ps.name").alias("sku_name"),
                      c("pti.qc_result").alias("inspection_result"))


def needs_storage_adhoc(db) -> DataFrame:
    """Active quarantine records without a location."""
    out = (_unit_base(db)
           .join(_stage(db), c("pt.current_stage_id") == c("lc.id"))
           .join(db.quarantined_products.alias("q"), c("pt.id") == c("q.product_tracking_id"))
           .join(db.product_statuses.alias("st"), c("pt.current_status_id") == c("st.id"))
           .where((c("q.quarantine_status") == "Active") & c("q.location_id").isNull()))
    return out.select(c("pt.id").alias("id"), c("pt.product_id").alias("product_id"), c("q.id").alias("quarantine_id"),
                      c("lc.stage_name").alias("current_stage_name"), c("ps.sku").alias("sku"),
                      c("ps.name").alias("sku_name"), c("st.status_name").alias("inspection_result"),
                      c("pt.last_updated_at").alias("last_updated_at"), c("q.quarantined_by").alias("quarantined_by"),
                      c("q.quarantine_date").alias("quarantine_date"))


def shipped_batches(db) -> DataFrame:
    """Treatment batches out for treatment, newest first."""
    return db.treatment_batches.where(c("status") == "Shipped").select("id", "sent_at", "notes").orderBy(
        c("sent_at").desc())


def batch_products(db, batch_id: int | None = None) -> DataFrame:
    """Units of a batch (all batches when ``batch_id`` is None) with QC, stage and status."""
    tbp = db.treatment_batch_products
    if batch_id is not None:
        tbp = tbp.where(c("batch_id") == batch_id)
    out = (tbp.alias("tbp")
           .join(db.product_tracking.alias("pt"), c("tbp.product_tracking_id") == c("pt.id"))
           .join(db.product_harvest.alias("ph"), c("ph.id") == c("pt.harvest_id"))
           .join(db.product_requests.alias("pr"), c("pr.id") == c("ph.request_id"))
           .join(db.product_skus.alias("ps"), c("pt.sku_id") == c("ps.id"))
           .join(db.product_quality_control.alias("pqc"), c("pt.id") == c("pqc.product_tracking_id"), "left")
           .join(_stage(db), c("pt.current_stage_id") == c("lc.id"), "left")
           .join(db.product_statuses.alias("pst"), c("pt.current_status_id") == c("pst.id"), "left"))
    return out.select(c("tbp.id").alias("batch_product_id"), c("tbp.batch_id").alias("batch_id"),
                      c("pt.id").alias("id"), c("pt.product_id").alias("product_id"),
                      c("pst.status_name").alias("current_status"), c("lc.stage_name").alias("current_stage"),
                      c("pt.location_id").alias("location_id"), c("ps.sku").alias("sku"),
                      c("ps.name").alias("sku_name"), c("pqc.inspection_result").alias("inspection_result"),
                      c("tbp.surface_treat").alias("surface_treat"), c("tbp.sterilize").alias("sterilize"),
                      F.lit(None).cast("boolean").alias("visual_pass"))


def stored_products(db, unit: int | None = None) -> DataFrame:
    """Units with a storage location; one unit alone if its id is given."""
    out = (_unit_base(db)
           .join(db.storage_locations.alias("sl"), c("pt.location_id") == c("sl.id"))
           .join(_stage(db), c("pt.current_stage_id") == c("lc.id"), "left"))
    if unit is not None:
        out = out.where(c("pt.id") == unit)
    return out.select(c("pt.id").alias("product_id"), c("ph.id").alias("harvest_id"), c("ps.sku").alias("sku"),
                      c("ps.name").alias("sku_name"), c("lc.stage_name").alias("current_status"),
                      c("sl.id").alias("location_id"), c("sl.location_name").alias("location_name"),
                      c("sl.description").alias("description"))


def shelf_options(db, units: DataFrame, mode: str) -> DataFrame:
    """For each unit needing storage, every shelf allowed for its business status in ``mode``.

    Shelf matching runs on (rule x location); units join it on
    the business status (equi-join; at most the location count per unit).
    """
    opts = R.shelf_options_table(db.spark, db.storage_locations).where(c("mode") == mode).drop("mode")
    u = units.select("id", "product_id",
                     X.business_status(c("inspection_result"), "A-Ware").alias("business_status"))
    return u.join(broadcast_if_small(opts), "business_status").distinct().select(
        "id", "product_id", "business_status", "location_id", "location_name", "description", "next_stage_code")


def _located_units(db) -> DataFrame:
    return (db.product_tracking.alias("pt")
            .join(_stage(db), c("pt.current_stage_id") == c("lc.id"))
            .join(db.storage_locations.alias("sl"), c("pt.location_id") == c("sl.id"))
            .join(db.product_statuses.alias("st"), c("pt.current_status_id") == c("st.id"), "left")
            .select(c("pt.id").alias("product_id"), c("st.status_name").alias("status_name"),
                    c("lc.stage_code").alias("stage_code"), c("sl.id").alias("location_id"),
                    c("sl.location_name").alias("location_name"), c("sl.description").alias("description")))


def shelf_stage_mismatch(db) -> DataFrame:
    """Stored units whose shelf description holds no keyword allowed for the stage
    (a stage without rules is always a mismatch)."""
    valid = R.stage_valid_locations(db.spark, db.storage_locations).select(
        c("stage_code").alias("_sc"), c("location_id").alias("_loc"))
    u = _located_units(db)
    return u.join(broadcast_if_small(valid), (c("stage_code") == c("_sc")) & (c("location_id") == c("_loc")), "left_anti")


def mismatch_fixes(db) -> DataFrame:
    """Every valid shelf for each mismatched unit."""
    valid = R.stage_valid_locations(db.spark, db.storage_locations).select(
        c("stage_code").alias("_sc"), c("location_id").alias("valid_location_id"),
        c("location_name").alias("valid_location_name"), c("description").alias("valid_description"))
    m = shelf_stage_mismatch(db)
    return m.join(broadcast_if_small(valid), c("stage_code") == c("_sc")).drop("_sc")


def sample_key(unit_id, seed: int) -> F.Column:
    """Pseudo-random order of unit ids that depends on the seed as a whole (any id, no overflow)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), unit_id.cast("string")))


def inspection_sample(db, seed: int = 7, inspect_all: bool = False) -> DataFrame:
    """Per treatment batch a random sample of min(n, max(2, round_half_even(0.05 n))) units;
    with ``inspect_all`` every unit of the batch.

    Per-batch counts come from a partial aggregate; only rows that can be in a
    sample are shuffled (``smallest_share``).
    """
    tbp = db.treatment_batch_products.select("batch_id", "product_tracking_id")
    if inspect_all:
        n = tbp.groupBy(c("batch_id").alias("_b")).agg(F.count(F.lit(1)).alias("n"))
        return tbp.join(n, c("batch_id") == c("_b")).select("batch_id", "product_tracking_id", c("n").alias("batch_size"),
                                                            c("n").alias("sample_size"))
    size = F.least(c("n"), F.greatest(F.lit(2), F.bround(c("n") * F.lit(0.05), 0).cast("long")))
    keyed = tbp.withColumn("_k", sample_key(c("product_tracking_id"), seed))
    return smallest_share(keyed, "batch_id", "_k", "product_tracking_id", size, 0.05).select(
        "batch_id", "product_tracking_id", c("n").alias("batch_size"), c("wanted").alias("sample_size"))


def treatment_qc_evaluation(db, inputs: DataFrame) -> DataFrame:
    """Treatment QC rule (F21) over batch units; a manual outcome wins on visual fail.

    ``inputs``: (product_tracking_id, surface_treated, sterilized, quarantine, visual_pass, manual_outcome).
    """
    units = (db.treatment_batch_products.alias("tbp")
             .join(db.product_tracking.alias("pt"), c("tbp.product_tracking_id") == c("pt.id"))
             .join(db.product_statuses.alias("st"), c("pt.current_status_id") == c("st.id"), "left")
             .select(c("pt.id").alias("id"), c("tbp.batch_id").alias("batch_id"),
                     c("tbp.surface_treat").alias("surface_treat"), c("st.status_name").alias("current_status")))
    out = units.join(inputs, units.id == inputs.product_tracking_id)
    visual = F.coalesce(c("visual_pass"), F.lit(True))
    suggested = X.treatment_qc_rule(c("current_status"), c("surface_treat"), c("surface_treated"), c("sterilized"),
                                    c("quarantine"), visual)
    result = F.when(~visual & c("manual_outcome").isNotNull(), c("manual_outcome")).otherwise(suggested)
    return out.select("id", "batch_id", suggested.alias("suggested_result"), result.alias("qc_result"),
                      F.when(c("quarantine"), F.lit(True)).otherwise(visual).alias("visual_pass"))


def treatment_inputs(db) -> DataFrame:
    """Command table for G19 derived from recorded inspections (one row per inspected unit)."""
    return db.post_treatment_inspections.select(
        "product_tracking_id", "surface_treated", "sterilized", (c("id") % 11 == 0).alias("quarantine"),
        "visual_pass", F.when(c("id") % 2 == 0, F.lit("Waste")).otherwise(F.lit(None)).alias("manual_outcome"))


def _expiry_base(db) -> DataFrame:
    return (db.product_tracking.alias("pt")
            .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
            .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
            .join(db.product_skus.alias("s"), c("s.id") == c("pt.sku_id"))
            .join(_stage(db, "ls"), c("pt.current_stage_id") == c("ls.id"))
            .where(c("ls.stage_code") != "Expired"))


def expiring_soon(db, as_of: str) -> DataFrame:
    """Units not yet expired, printed in [as_of - 1 year, as_of - 358 days)."""
    t = F.lit(as_of).cast("timestamp_ntz")
    out = _expiry_base(db).where((c("ph.print_date") < F.timestamp_add("DAY", F.lit(-358), t))
                                 & (c("ph.print_date") >= F.timestamp_add("YEAR", F.lit(-1), t)))
    return out.select(c("pt.id").alias("id"), c("ph.print_date").alias("print_date"), c("s.sku").alias("sku"),
                      c("s.name").alias("sku_name"))


def expired(db, as_of: str) -> DataFrame:
    """Units not yet expired, printed before as_of - 1 year."""
    t = F.lit(as_of).cast("timestamp_ntz")
    out = _expiry_base(db).where(c("ph.print_date") < F.timestamp_add("YEAR", F.lit(-1), t))
    return out.select(c("pt.id").alias("id"), c("ph.print_date").alias("print_date"), c("s.sku").alias("sku"),
                      c("s.name").alias("sku_name"))


def qm_review(db) -> DataFrame:
    """Units at InInterimStorage with QC and inspector."""
    out = (_unit_base(db)
           .join(_stage(db), c("pt.current_stage_id") == c("lc.id"))
           .join(db.product_quality_control.alias("qc"), c("qc.product_tracking_id") == c("pt.id"))
           .join(db.users.alias("u"), c("qc.inspected_by") == c("u.id"))
           .join(db.storage_locations.alias("sl"), c("pt.location_id") == c("sl.id"), "left")
           .where(c("lc.stage_code") == "InInterimStorage"))
    return out.select(c("pt.id").alias("product_tracking_id"), c("pt.product_id").alias("product_id"),
                      c("lc.stage_name").alias("current_stage_name"), c("pt.last_updated_at").alias("last_updated_at"),
                      c("pr.lot_number").alias("lot_number"), c("ps.sku").alias("sku"), c("ps.name").alias("sku_name"),
                      c("qc.inspection_result").alias("inspection_result"), c("u.display_name").alias("inspected_by"),
                      c("qc.weight_grams").alias("weight_grams"), c("qc.pressure_drop").alias("pressure_drop"),
                      c("qc.visual_pass").alias("visual_pass"), c("qc.notes").alias("notes"),
                      c("sl.location_name").alias("current_location")).orderBy(c("last_updated_at").desc())


def qm_post_treatment(db) -> DataFrame:
    """Units at PostTreatmentStorage with (optional) inspection and inspector."""
    out = (_unit_base(db)
           .join(_stage(db), c("pt.current_stage_id") == c("lc.id"))
           .join(db.post_treatment_inspections.alias("pti"), c("pti.product_tracking_id") == c("pt.id"), "left")
           .join(db.users.alias("u"), c("pti.inspected_by") == c("u.id"), "left")
           .join(db.storage_locations.alias("sl"), c("pt.location_id") == c("sl.id"), "left")
           .where(c("lc.stage_code") == "PostTreatmentStorage"))
    return out.select(c("pt.id").alias("product_tracking_id"), c("pt.product_id").alias("product_id"),
                      c("lc.stage_name").alias("current_stage_name"), c("pt.last_updated_at").alias("last_updated_at"),
                      c("ps.sku").alias("sku"), c("ps.name").alias("sku_name"),
                      c("pti.qc_result").alias("inspection_result"), c("u.display_name").alias("inspected_by"),
                      c("pti.visual_pass").alias("visual_pass"), c("pti.surface_treated").alias("surface_treated"),
                      c("pti.sterilized").alias("sterilized"),
                      c("sl.location_name").alias("current_location")).orderBy(c("last_updated_at").desc())


def quarantined(db) -> DataFrame:
    """Active located quarantine records not under investigation, with previous stage name."""
    out = (_unit_base(db)
           .join(db.quarantined_products.alias("q"), c("q.product_tracking_id") == c("pt.id"))
           .join(db.product_quality_control.alias("qc"), c("qc.product_tracking_id") == c("pt.id"), "left")
           .join(db.post_treatment_inspections.alias("pti"), c("pti.product_tracking_id") == c("pt.id"), "left")
           .join(db.storage_locations.alias("sl"), c("pt.location_id") == c("sl.id"), "left")
           .join(_stage(db), c("pt.current_stage_id") == c("lc.id"))
           .join(_stage(db, "prev"), c("pt.previous_stage_id") == c("prev.id"), "left")
           .join(db.product_investigations.alias("inv"), c("inv.product_tracking_id") == c("pt.id"), "left")
           .join(db.users.alias("u"), c("q.quarantined_by") == c("u.id"))
           .where((c("q.quarantine_status") == "Active") & c("q.location_id").isNotNull()
                  & (c("inv.id").isNull() | (c("inv.status") != "Under Investigation"))))
    return out.select(c("pt.id").alias("product_id"), c("pt.product_id").alias("tracking_id"),
                      c("ps.sku").alias("sku"), c("ps.name").alias("sku_name"),
                      c("prev.stage_name").alias("previous_stage_name"), c("lc.stage_name").alias("current_stage_name"),
                      c("sl.location_name").alias("location_name"), c("qc.inspection_result").alias("inspection_result"),
                      c("pti.qc_result").alias("qc_result"), c("q.quarantine_date").alias("quarantine_date"),
                      c("q.quarantine_reason").alias("quarantine_reason"), c("u.display_name").alias("quarantined_by"),
                      c("qc.weight_grams").alias("weight_grams"), c("qc.pressure_drop").alias("pressure_drop"),
                      c("pt.last_updated_at").alias("last_updated_at"))


def investigated(db) -> DataFrame:
    """Units with an investigation 'Under Investigation'."""
    out = (_unit_base(db)
           .join(_stage(db), c("pt.current_stage_id") == c("lc.id"))
           .join(db.storage_locations.alias("sl"), c("pt.location_id") == c("sl.id"), "left")
           .join(db.product_quality_control.alias("qc"), c("qc.product_tracking_id") == c("pt.id"), "left")
           .join(_stage(db, "prev"), c("pt.previous_stage_id") == c("prev.id"), "left")
           .join(db.product_investigations.alias("inv"), c("inv.product_tracking_id") == c("pt.id"))
           .join(db.users.alias("u"), c("inv.created_by") == c("u.id"))
           .where(c("inv.status") == "Under Investigation"))
    return out.select(c("pt.id").alias("product_id"), c("ps.sku").alias("sku"), c("ps.name").alias("sku_name"),
                      c("prev.stage_name").alias("previous_stage_name"), c("lc.stage_name").alias("current_stage_name"),
                      c("pt.last_updated_at").alias("last_updated_at"), c("sl.location_name").alias("location_name"),
                      c("qc.inspection_result").alias("inspection_result"),
                      c("inv.deviation_number").alias("deviation_number"), c("inv.comment").alias("comment"),
                      c("u.display_name").alias("created_by"), c("inv.created_at").alias("created_at"))


def quarantine_search(db, unit: int | None = None, lot: str | None = None, batch: int | None = None,
                      mount: int | None = None) -> DataFrame:
    """The units that could be put in quarantine: not Waste and in no active quarantine.

    Each argument that is given narrows them: the unit, the lot of its request, a treatment batch it is in,
    the mount it was printed from.
    """
    wanted = {"u.id": unit, "r.lot_number": lot, "h.filament_mounting_id": mount}
    held = db.quarantined_products.where(c("quarantine_status") == "Active").select("product_tracking_id")
    if batch is not None:
        in_batch = db.treatment_batch_products.where(c("batch_id") == batch).select("product_tracking_id")
        units = db.product_tracking.join(in_batch, c("id") == c("product_tracking_id"), "left_semi")
    else:
        units = db.product_tracking
    free = units.join(held, c("id") == c("product_tracking_id"), "left_anti").alias("u")
    waste = db.product_statuses.where(c("status_name") == "Waste").select("id")
    free = free.join(F.broadcast(waste).alias("w"), c("u.current_status_id") == c("w.id"), "left_anti")
    chain = (free.join(db.product_harvest.alias("h"), c("h.id") == c("u.harvest_id"))
             .join(db.product_requests.alias("r"), c("r.id") == c("h.request_id")))
    for column, value in wanted.items():
        if value is not None:
            chain = chain.where(c(column) == value)
    names = (chain.join(db.product_skus.alias("k"), c("k.id") == c("u.sku_id"))
             .join(_stage(db, "now"), c("now.id") == c("u.current_stage_id"))
             .join(db.product_statuses.alias("s"), c("s.id") == c("u.current_status_id"), "left")
             .join(db.storage_locations.alias("at"), c("at.id") == c("u.location_id"), "left"))
    return names.select(*[c(source).alias(name) for name, source in QUARANTINE_SEARCH_COLUMNS.items()])


QUARANTINE_SEARCH_COLUMNS = {
    "product_id": "u.id", "tracking_id": "u.product_id", "sku": "k.sku", "sku_name": "k.name", "lot_number": "r.lot_number",
    "request_id": "r.id", "harvest_id": "h.id", "current_stage_name": "now.stage_name", "current_status": "s.status_name",
    "location_name": "at.location_name", "last_updated_at": "u.last_updated_at"}


def audit_entries(db) -> DataFrame:
    """Audit log, newest first."""
    return db.audit_log.select("table_name", "record_id", "field_name", "old_value", "new_value", "reason",
                               "changed_by", "changed_at").orderBy(c("changed_at").desc())


def previous_stage(db) -> DataFrame:
    """Previous stage id per unit."""
    return db.product_tracking.select(c("id").alias("product_tracking_id"), "previous_stage_id")


def reasons(db, include_inactive: bool = False) -> DataFrame:
    """Reasons (active only unless ``include_inactive``) by category and label."""
    r = db.issue_reasons
    if not include_inactive:
        r = r.where(c("is_active"))
    return r.select("id", "reason_code", "reason_label", "category", "default_outcome", "severity",
                    "is_active").orderBy("category", "reason_label")


def contexts(db) -> DataFrame:
    """Issue contexts by code."""
    return db.issue_contexts.select("id", "context_code").orderBy("context_code")


def reasons_for_context(db, context_code: str | None = None, outcome: str | None = None,
                        include_inactive: bool = False) -> DataFrame:
    """Reasons enabled per context (all contexts when ``context_code`` is None), optionally
    kept only when their default outcome is neutral or equals ``outcome`` (F32)."""
    out = (db.issue_reasons.alias("r")
           .join(db.issue_reason_contexts.alias("rc"), c("rc.reason_id") == c("r.id"))
           .join(db.issue_contexts.alias("cx"), c("cx.id") == c("rc.context_id")))
    if context_code is not None:
        out = out.where(c("cx.context_code") == context_code)
    if not include_inactive:
        out = out.where(c("r.is_active"))
    out = out.where(X.reason_matches_outcome(c("r.default_outcome"), outcome))
    return out.select(c("cx.context_code").alias("context_code"), c("r.id").alias("id"),
                      c("r.reason_code").alias("reason_code"), c("r.reason_label").alias("reason_label"),
                      c("r.category").alias("category"), c("r.default_outcome").alias("default_outcome")
                      ).orderBy("context_code", "category", "reason_label")


def label_data(db, stage_code: str | None = "Printed") -> DataFrame:
    """Label fields per unit (by stage, or all units when ``stage_code`` is None), expiry = print + 2 years."""
    out = (db.product_tracking.alias("pt")
           .join(db.product_types.alias("ptype"), c("pt.product_type_id") == c("ptype.id"))
           .join(db.product_skus.alias("ps"), c("pt.sku_id") == c("ps.id"))
           .join(db.product_print_specs.alias("pps"), c("ps.id") == c("pps.sku_id"))
           .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
           .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
           .join(_stage(db, "ls"), c("pt.current_stage_id") == c("ls.id")))
    if stage_code is not None:
        out = out.where(c("ls.stage_code") == stage_code)
    exp = X.label_expiry(c("ph.print_date"))
    return out.select(c("pt.id").alias("id"), c("pt.product_id").alias("product_id"),
                      c("ps.sku").alias("reference_number"), c("ptype.name").alias("product_type"),
                      c("pps.average_weight_g").alias("volume"), c("pr.lot_number").alias("lot_number"),
                      exp["expiry_date"].alias("expiration_date"), exp["expiry_label"].alias("expiration_label"))


def label_id_series(requests: DataFrame, max_labels: int | None = None) -> DataFrame:
    """(request_id, first_id, n) -> n consecutive label ids per request; more than ``max_labels``, if given, raises."""
    n = c("n")
    bad = n < 1
    if max_labels is not None:
        bad = bad | (n > max_labels)
    checked = requests.withColumn("n", F.when(bad, F.raise_error(F.lit("label count out of range"))).otherwise(n))
    return checked.select("request_id", F.explode(F.sequence(c("first_id"), c("first_id") + c("n") - 1))
                          .alias("label_id"))


def label_requests(db) -> DataFrame:
    """Command table for G33: one label run per harvested unit."""
    return db.product_tracking.select(c("id").alias("request_id"), c("product_id").alias("first_id"),
                                      (F.lit(1) + c("id") % 5).alias("n"))


def effective_access(db, memberships: DataFrame) -> DataFrame:
    """(user_id, group_oid) memberships -> highest access level per (user, area)."""
    out = (memberships.alias("m")
           .join(db.group_area_rights.alias("g"), c("g.group_oid") == c("m.group_oid"))
           .join(db.application_areas.alias("a"), c("a.id") == c("g.area_id")))
    return (out.groupBy(c("m.user_id").alias("user_id"), c("a.area_name").alias("area_name"))
            .agg(F.max_by(c("g.access_level"), X.level_rank(c("g.access_level"))).alias("access_level")))


def user_memberships(db) -> DataFrame:
    """Command table for G35: each user is in the group of its supplier nation and of (key mod 25)."""
    s = db.src("supplier").join(db.src("nation"), c("s_nationkey") == c("n_nationkey"))
    a = s.select((c("s_suppkey") + 1).cast("long").alias("user_id"), c("n_name").alias("group_oid"))
    b = db.src("supplier").select((c("s_suppkey") + 1).cast("long").alias("user_id"),
                                  F.concat(F.lit("NATION_"), (c("s_suppkey") % 25).cast("string")).alias("group_oid"))
    return a.unionByName(b).distinct()


QM_STAGE_LABELS = {"Post-Harvest Approval": "Stored; Pending QM Approval for Treatment",
                   "Post-Treatment Approval": "Stored; Pending QM Approval"}


def qm_bulk_eligible(db) -> DataFrame:
    """Review rows (G22, G23) whose stage name equals the approval's stage label."""
    a = qm_review(db).where(c("current_stage_name") == QM_STAGE_LABELS["Post-Harvest Approval"]).select(
        F.lit("Post-Harvest Approval").alias("approval_type"), c("product_tracking_id").alias("pid"),
        c("inspection_result").alias("result"))
    b = qm_post_treatment(db).where(c("current_stage_name") == QM_STAGE_LABELS["Post-Treatment Approval"]).select(
        F.lit("Post-Treatment Approval").alias("approval_type"), c("product_tracking_id").alias("pid"),
        c("inspection_result").alias("result"))
    return a.unionByName(b)


def label_templates(db, stage_code: str | None = "Printed") -> DataFrame:
    """Every unit of the label run with each label template allowed for its sku (QR flag, print size,
    surface area); the template list is literal and broadcast, so the join is bounded per unit."""
    units = label_data(db, stage_code)
    labels = F.broadcast(R.label_table(db.spark))
    return units.join(labels, units.reference_number == labels.sku).select(
        "id", "product_id", "reference_number", "label", "qr_required", "print_size", "surface_area",
        "expiration_label")
