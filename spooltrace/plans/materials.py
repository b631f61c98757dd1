"""Material queries (M1-M22): spools, mounts, lids, seals and material feasibility.

Spool, mount, lid and seal tables scale with inventory, not with units; the
usage table scales with units and is only ever reduced by a partial
aggregate (``groupBy``) before it meets inventory tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spooltrace.functions import exprs as X
from spooltrace.operators.ranking import running_min_within, running_sum_within
from spooltrace.plans import views

c = F.col


def filaments_in_storage(db) -> DataFrame:
    """M1: PASS spools whose derived status is 'In Storage'."""
    v = views.v_filament_status(db)
    return v.where((c("qc_result") == "PASS") & (c("current_status") == "In Storage")).select(
        "id", "filament_id", "serial_number")


def mountable_filaments(db, min_weight: int = 165) -> DataFrame:
    """M2: spools with no 'In Use' mount anywhere and coalesce(remaining, initial) >= min_weight."""
    in_use = db.filament_mounting.where(c("status") == "In Use").select(c("filament_tracking_id").alias("_busy"))
    out = (db.filaments.alias("f")
           .join(in_use, c("f.id") == c("_busy"), "left_anti")
           .join(db.storage_locations.alias("loc"), c("f.location_id") == c("loc.id"))
           .join(db.filament_mounting.alias("fm"), c("f.id") == c("fm.filament_tracking_id"), "left"))
    w = F.coalesce(c("fm.remaining_weight"), c("f.weight_grams"))
    return out.where(w >= min_weight).select(
        c("f.id").alias("id"), c("f.filament_id").alias("filament_id"), c("f.serial_number").alias("serial_number"),
        c("loc.location_name").alias("location_name"), w.alias("weight_grams"))


def _acclimatizing(db, as_of: str | None) -> DataFrame:
    mounted = db.filament_mounting.select(c("filament_tracking_id").alias("_m"))
    a = db.filament_acclimatization.where(c("status") == "Acclimatizing")
    if as_of is not None:
        a = a.where(c("ready_at") <= F.lit(as_of).cast("timestamp_ntz"))
    out = (a.alias("a")
           .join(mounted, c("a.filament_tracking_id") == c("_m"), "left_anti")
           .join(db.filaments.alias("f"), c("a.filament_tracking_id") == c("f.id"))
           .join(db.storage_locations.alias("loc"), c("f.location_id") == c("loc.id")))
    return out.select(
        c("f.id").alias("id"), c("f.filament_id").alias("filament_id"), c("f.serial_number").alias("serial_number"),
        c("f.weight_grams").alias("weight_grams"), c("a.id").alias("acclimatization_id"),
        c("a.ready_at").alias("ready_at"), c("loc.location_name").alias("location_name")).orderBy("ready_at")


def acclimatized_ready(db, as_of: str) -> DataFrame:
    """M3: acclimatizing spools ready by ``as_of`` and never mounted, by ready time."""
    return _acclimatizing(db, as_of)


def acclimatizing_restorable(db) -> DataFrame:
    """M4: acclimatizing spools never mounted (no time test)."""
    return _acclimatizing(db, None)


def available_printers(db) -> DataFrame:
    """M5: active printers without an open mount."""
    open_m = db.filament_mounting.where(c("unmounted_at").isNull()).select(c("printer_id").alias("_p"))
    return (db.printers.where(c("status") == "Active")
            .join(open_m, c("id") == c("_p"), "left_anti"))


def _mount_detail(db) -> DataFrame:
    return (db.filament_mounting.alias("fm")
            .join(db.filaments.alias("f"), c("fm.filament_tracking_id") == c("f.id"))
            .join(db.printers.alias("p"), c("fm.printer_id") == c("p.id")))


def mounted_filaments(db) -> DataFrame:
    """M6: 'In Use' mounts with spool and printer, by printer name."""
    return (_mount_detail(db).where(c("fm.status") == "In Use")
            .select(c("fm.id").alias("mount_id"), c("f.filament_id").alias("filament_id"),
                    c("f.serial_number").alias("serial_number"), c("p.name").alias("printer_name"),
                    c("fm.remaining_weight").alias("remaining_weight"))
            .orderBy("printer_name"))


def mounts_with_weight(db, required_weight) -> DataFrame:
    """M7: 'In Use' mounts with at least ``required_weight`` remaining."""
    return (_mount_detail(db).where((c("fm.status") == "In Use") & (c("fm.remaining_weight") >= required_weight))
            .select(c("fm.id").alias("id"), c("f.filament_id").alias("filament_id"),
                    c("f.serial_number").alias("serial_number"), c("p.name").alias("printer_name"),
                    c("fm.remaining_weight").alias("remaining_weight")))


def request_mount_candidates(db) -> DataFrame:
    """M8 (re-aimed): for every pending request, the number of 'In Use' mounts holding at
    least the required weight (avg + buffer + 10) and the best one (most remaining, then
    smallest mount id).

    The required weight depends only on the sku. Mounts are counted per weight,
    and the skus' requirements take their places in that order: the running
    count there is the number of mounts that suffice, so no mount meets a sku.
    The best mount is the same for every sku that has one.
    """
    req = db.product_requests.where((c("status") == "Pending") & (c("lot_number") != "LEGACY_LOT"))
    need = (db.product_skus.alias("s")
            .join(db.product_print_specs.alias("sp"), c("sp.sku_id") == c("s.id"), "left")
            .select(c("s.id").alias("_sku"), X.required_weight(c("sp.average_weight_g"), c("sp.weight_buffer_g"))
                    .alias("required_weight")))
    mounts = db.filament_mounting.where(c("status") == "In Use").select(
        c("id").alias("_m_id"), c("remaining_weight").alias("_m_rem"))
    weight = "decimal(14,2)"
    line = (mounts.where(c("_m_rem").isNotNull()).groupBy((-c("_m_rem")).cast(weight).alias("_v"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .select(F.lit(1).alias("_all"), "_v", F.lit(0).alias("_kind"), "_n", F.lit(None).cast("long").alias("_sku"))
            .unionByName(need.select(F.lit(1).alias("_all"), (-c("required_weight")).cast(weight).alias("_v"),
                                     F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_n"), "_sku")))
    counted = running_sum_within(line, ["_all"], ["_v", "_kind", "_sku"], "_n", col="candidate_mounts")
    best = mounts.agg(F.max(F.struct("_m_rem", (-c("_m_id")).alias("i"))).alias("_b")).withColumn("_k", F.lit(1))  # one row
    per_sku = (counted.where((c("_kind") == 1) & (c("candidate_mounts") > 0)).withColumn("_k", F.lit(1))
               .join(F.broadcast(best), "_k")
               .select("_sku", "candidate_mounts", (-c("_b.i")).alias("best_mount_id"),
                       c("_b._m_rem").alias("best_remaining_weight")))
    out = (req.alias("r").join(need, c("r.sku_id") == c("_sku"), "left")
           .join(per_sku.withColumnRenamed("_sku", "_sku2"), c("r.sku_id") == c("_sku2"), "left"))
    return out.select(c("r.id").alias("request_id"), c("r.sku_id").alias("sku_id"),
                      F.coalesce(c("required_weight"), F.lit(0).cast("decimal(10,2)")).alias("required_weight"),
                      F.coalesce(c("candidate_mounts"), F.lit(0)).cast("long").alias("candidate_mounts"),
                      c("best_mount_id"), c("best_remaining_weight"))


def filament_current_weight(db) -> DataFrame:
    """M9: per spool: 'In Use' remaining weight, else initial weight if > 0, else NULL; with source."""
    fm = db.filament_mounting.where(c("status") == "In Use").alias("fm")
    out = db.filaments.alias("f").join(fm, c("fm.filament_tracking_id") == c("f.id"), "left")
    has_mount = c("fm.id").isNotNull()
    return out.select(
        c("f.id").alias("filament_pk"), c("f.filament_id").alias("filament_id"),
        c("f.serial_number").alias("serial_number"), c("fm.id").alias("mount_id"),
        F.when(has_mount, c("fm.remaining_weight")).when(c("f.weight_grams") > 0, c("f.weight_grams"))
         .alias("current_weight"),
        F.when(has_mount, "mounting").when(c("f.weight_grams") > 0, "filament").otherwise("none")
         .alias("weight_source"))


def filament_list(db) -> DataFrame:
    """All spools by id."""
    return db.filaments.orderBy("id")


def open_mounts(db) -> DataFrame:
    """Mounts not yet unmounted, by id."""
    return db.filament_mounting.where(c("unmounted_at").isNull()).orderBy("id")


def unmounted_mounts(db) -> DataFrame:
    """Unmounted mounts with spool and printer, newest unmount first."""
    return (_mount_detail(db).where(c("fm.unmounted_at").isNotNull())
            .select(c("fm.id").alias("mount_id"), c("f.filament_id").alias("filament_id"),
                    c("f.serial_number").alias("serial_number"), c("p.name").alias("printer_name"),
                    c("fm.remaining_weight").alias("remaining_weight"), c("fm.unmounted_at").alias("unmounted_at"),
                    c("fm.status").alias("status"), c("fm.unmounted_by").alias("unmounted_by"))
            .orderBy(c("unmounted_at").desc()))


def weight_health_report(db) -> DataFrame:
    """Spools in use with a Critical/Low/OK level of their remaining weight."""
    v = views.v_filament_status(db).where(c("current_status") == "In Use")
    return v.select("filament_id", "serial_number", "printer_name", "remaining_weight",
                    X.weight_health(c("remaining_weight")).alias("health"))


def filament_inventory(db) -> DataFrame:
    """D2 with both weights as number-or-NULL."""
    v = views.v_filament_status(db)
    return v.withColumn("initial_weight", c("initial_weight").try_cast("decimal(10,2)")).withColumn(
        "remaining_weight", c("remaining_weight").try_cast("decimal(10,2)"))


def lid_inventory(db) -> DataFrame:
    """D3 without the other kind's legacy row, newest first."""
    return views.v_lid_inventory(db).where(c("serial_number") != "LEGACY_SEAL").orderBy(c("received_at").desc())


def seal_inventory(db) -> DataFrame:
    """D5 without the other kind's legacy row, newest first."""
    return views.v_seal_inventory(db).where(c("serial_number") != "LEGACY_LID").orderBy(c("received_at").desc())


def available_lids(db) -> DataFrame:
    """PASS lid batches except the legacy one, newest first."""
    return (db.lids.where((c("qc_result") == "PASS") & (c("serial_number") != "LEGACY_LID"))
            .orderBy(c("received_at").desc()).select("id", "serial_number"))


def available_seals(db) -> DataFrame:
    """PASS seal batches except the legacy one, newest first."""
    return (db.seals.where((c("qc_result") == "PASS") & (c("serial_number") != "LEGACY_SEAL"))
            .orderBy(c("received_at").desc()).select("id", "serial_number"))


def all_lids(db) -> DataFrame:
    """All lid batches, newest first."""
    return db.lids.orderBy(c("received_at").desc())


def all_seals(db) -> DataFrame:
    """All seal batches, newest first."""
    return db.seals.orderBy(c("received_at").desc())


def material_usage_summary(db) -> DataFrame:
    """D6 ordered by product type; the few types are spread by usage id, so that no task sorts a whole type."""
    return views.v_material_usage_summary(db).orderBy("product_type", "usage_id")


def _unit_weight(db) -> DataFrame:
    """Per sku: average + buffer weight (NULL when the sku has no spec)."""
    return (db.product_skus.alias("s")
            .join(db.product_print_specs.alias("sp"), c("sp.sku_id") == c("s.id"), "left")
            .select(c("s.id").alias("sku_id"),
                    (c("sp.average_weight_g") + c("sp.weight_buffer_g")).alias("unit_weight")))


def filament_lot_grams(db) -> DataFrame:
    """Sum of remaining weight of 'In Use' mounts per PASS spool lot."""
    return (db.filament_mounting.alias("fm").where(c("fm.status") == "In Use")
            .join(db.filaments.alias("f").where(c("f.qc_result") == "PASS"), c("fm.filament_tracking_id") == c("f.id"))
            .groupBy(c("f.lot_number").alias("lot_number"))
            .agg(F.sum("fm.remaining_weight").cast("decimal(18,2)").alias("available_grams")))


def filament_lot_units(db) -> DataFrame:
    """Per sku the spool lot yielding most units = floor(grams / (avg + buffer)).

    A lot only counts when it yields at least one unit; ties go to the
    smallest lot number; no such lot gives a NULL lot and 0 units.
    """
    uw = _unit_weight(db).where(c("unit_weight").isNotNull())
    return (uw.join(_best_lots(filament_lot_grams(db), uw), "sku_id", "left")
            .select("sku_id", c("b.lot_number").alias("lot_number"), c("b.available_grams").alias("available_grams"),
                    F.coalesce(c("max_units"), F.lit(0).cast("long")).alias("max_units")))


def _best_lots(lots: DataFrame, uw: DataFrame) -> DataFrame:
    """(sku_id, b(lot_number, available_grams), max_units): the smallest lot with the most units per sku.

    The heaviest lot gives the most units for every sku, so the units are known
    from one scalar, and with them the grams that a lot must hold. Lots and skus
    then stand in one ordering by falling grams, where the running least lot
    number at a sku's place is its lot: one range shuffle, no inequality join.
    """
    top = lots.agg(F.max("available_grams").alias("_top")).withColumn("_k", F.lit(1))  # one row
    want = (uw.withColumn("_k", F.lit(1)).join(F.broadcast(top), "_k")
            .withColumn("max_units", F.floor(c("_top") / c("unit_weight")).cast("long"))
            .where(c("max_units") >= 1))
    grams = "decimal(38,6)"
    offers = lots.where(c("lot_number").isNotNull()).select(
        c("available_grams").cast(grams).alias("grams"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("sku_id"),
        F.lit(None).cast("long").alias("max_units"), F.struct("lot_number", "available_grams").alias("lot"))
    asks = want.select((c("unit_weight") * c("max_units")).cast(grams).alias("grams"), F.lit(1).alias("asks"),
                       c("sku_id").cast("long").alias("sku_id"), "max_units",
                       F.lit(None).cast(offers.schema["lot"].dataType).alias("lot"))
    order = [c("grams").desc(), c("asks")]  # a lot of exactly the grams asked for comes first
    return (running_min_within(offers.unionByName(asks), [], order, "lot", col="b")
            .where("asks = 1").select("sku_id", "b", "max_units"))


def _batch_remaining(db, table: DataFrame, material: str) -> DataFrame:
    avail = (table.where(c("qc_result") == "PASS").groupBy("serial_number")
             .agg(F.sum("quantity").cast("long").alias("available_units")))
    used = (db.material_usage.where((c("material_type") == material) & c("lot_number").isNotNull())
            .groupBy(c("lot_number").alias("_lot")).agg(F.count(F.lit(1)).alias("used_units")))
    return (avail.join(used, c("serial_number") == c("_lot"), "left")
            .select("serial_number", "available_units",
                    F.coalesce(c("used_units"), F.lit(0)).cast("long").alias("used_units"),
                    (c("available_units") - F.coalesce(c("used_units"), F.lit(0))).cast("long").alias("remaining_units")))


def lid_remaining(db) -> DataFrame:
    """Per PASS lid batch: quantity minus the number of lid usage rows booked to it."""
    return _batch_remaining(db, db.lids, "Lid")


def seal_remaining(db) -> DataFrame:
    """Per PASS seal batch: quantity minus the number of seal usage rows booked to it."""
    return _batch_remaining(db, db.seals, "Seal")


def _best_batch(rem: DataFrame, prefix: str) -> DataFrame:
    pos = rem.where(c("remaining_units") > 0)
    return pos.agg(
        F.min_by(c("serial_number"), F.struct(-c("remaining_units"), c("serial_number"))).alias(f"best_{prefix}"),
        F.max("remaining_units").alias(f"_max_{prefix}"))


def material_feasibility(db, requests: DataFrame) -> DataFrame:
    """For each (sku_id, quantity) row: shortage flags per material from the single best
    lot/batch and the max producible units = least of the three bests; missing spec flagged.

    Lot and batch tables are aggregated first (one row per lot/batch), and
    each best is a one-row global aggregate joined on a constant key.
    """
    uw = _unit_weight(db)
    lots = filament_lot_grams(db)
    per_sku = _best_lots(lots, uw.where(c("unit_weight").isNotNull())).select(
        "sku_id", c("b.lot_number").alias("best_filament_lot"), c("max_units").alias("_max_f"))
    lid = _best_batch(lid_remaining(db), "lid").withColumn("_k", F.lit(1))
    seal = _best_batch(seal_remaining(db), "seal").withColumn("_k", F.lit(1))
    out = (requests.alias("q")
           .join(uw, "sku_id", "left")
           .join(per_sku, "sku_id", "left")
           .withColumn("_k", F.lit(1))
           .join(F.broadcast(lid), "_k", "left")
           .join(F.broadcast(seal), "_k", "left"))
    mf = F.coalesce(c("_max_f"), F.lit(0))
    ml = F.coalesce(c("_max_lid"), F.lit(0))
    ms = F.coalesce(c("_max_seal"), F.lit(0))
    has_spec = c("unit_weight").isNotNull()
    return out.select(
        "sku_id", "quantity", has_spec.alias("has_spec"),
        F.when(has_spec, mf < c("quantity")).alias("filament_short"),
        F.when(has_spec, ml < c("quantity")).alias("lid_short"),
        F.when(has_spec, ms < c("quantity")).alias("seal_short"),
        F.when(has_spec, c("best_filament_lot")).alias("best_filament_lot"),
        F.when(has_spec, c("best_lid")).alias("best_lid"),
        F.when(has_spec, c("best_seal")).alias("best_seal"),
        F.when(has_spec, F.least(mf, ml, ms)).cast("long").alias("max_units"))


def pending_demand(db) -> DataFrame:
    """Command table for M21: pending (non-legacy) requests counted per sku."""
    return (db.product_requests.where((c("status") == "Pending") & (c("lot_number") != "LEGACY_LOT"))
            .groupBy("sku_id").agg(F.count(F.lit(1)).cast("long").alias("quantity")))


def storage_locations_sorted(db) -> DataFrame:
    """Storage locations by name."""
    return db.storage_locations.orderBy("location_name")


def printers_sorted(db) -> DataFrame:
    """Printers by name."""
    return db.printers.orderBy("name")


def users_sorted(db) -> DataFrame:
    """Users by display name."""
    return db.users.orderBy("display_name")
