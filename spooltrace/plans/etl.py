"""Staging -> core ETL transforms (E1-E16) as DataFrame functions returning new table versions.

``etl_pipeline`` runs them in the source's order: spools (E1), mounts (E3),
acclimatization (E4), unified legacy prints (D7) on those versions, new
harvests (E5) and the product->harvest map (E6), units (E8), QC (E9),
treatment batches (E10-E12), post-treatment (E14), consistency rules (E15).
Every step is a set-based transform (joins, anti-joins, upserts); ids for new
rows come from the distributed numbering kernel. ``as_of`` replaces the system
clock everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spooltrace.functions import exprs as X
from spooltrace.session import broadcast_if_small, materialize, written_once
from spooltrace.operators import merge as C
from spooltrace.plans import views

c = F.col

LEGACY_PRODUCTS = ["10K", "6K", "CS MINI"]
# Fixed default rows the transforms rely on.
DEFAULT_LOCATIONS = [("Unassigned", "Virtual", "Unassigned"), ("Waste", "Waste", "Disposed Product"),
                     ("Offsite", "Offsite", "Treatment/Partner/Customer")]


def ensure_default_locations(db) -> DataFrame:
    """C9 (locations): add Unassigned / Waste / Offsite when missing (computed once per catalogue)."""
    locations = db.storage_locations  # read also where the result is at hand: it depends on them
    cached = db.__dict__.get("_ensured_locations") if hasattr(db, "__dict__") else None
    if cached is not None:
        return cached
    rows = db.spark.createDataFrame([(None, n, t, d, True) for n, t, d in DEFAULT_LOCATIONS],
                                    "id BIGINT, location_name STRING, location_type STRING, description STRING, "
                                    "is_active BOOLEAN")
    new, _ = C.insert_missing(locations, rows, ["location_name"], id_col="id",
                              id_order=["location_name"])
    if hasattr(db, "__dict__"):
        db.__dict__["_ensured_locations"] = new
    return new


def fallback_user(users: DataFrame) -> DataFrame:
    """One-row table (fallback_user_id): user named 'Unassigned', else id 1, else the smallest id."""
    return users.agg(F.coalesce(F.min(F.when(c("display_name") == "Unassigned", c("id"))),
                                F.min(F.when(c("id") == 1, c("id"))), F.min("id")).alias("fallback_user_id"))


def _with_fallback(df: DataFrame, users: DataFrame) -> DataFrame:
    # one-row scalar, joined on a constant key
    fb = fallback_user(users).withColumn("_fbk", F.lit(1))
    return df.withColumn("_fbk", F.lit(1)).join(F.broadcast(fb), "_fbk").drop("_fbk")


def _harvested_since(cutoff: str) -> Column:
    return c("harvest_ts").cast("date") >= F.to_date(F.lit(cutoff))


def _staging_scope(cutoff: str) -> Column:
    return (c("product_id_int").isNotNull() & F.trim(c("product")).isin(*LEGACY_PRODUCTS) & _harvested_since(cutoff))


def _parsed(df: DataFrame, *cells: Column) -> DataFrame:
    """``cells`` of ``df``, out of a generator of one row: a later filter on a parsed cell stays behind it and is not put
    into the scan, where each parser would run once for the filter and again for the value."""
    return df.select(F.inline(F.array(F.struct(*cells))))


def etl_new_shelves(db) -> DataFrame:
    """Distinct trimmed staging shelves that are not yet storage locations."""
    shelves = (views.spool_sheet(db).select(X.blank_to_null(c("shelf")).alias("location_name"))
               .where(c("location_name").isNotNull()).distinct())
    return shelves.join(db.storage_locations.select("location_name"), "location_name", "left_anti")


def _legacy_request_per_type(db) -> DataFrame:
    """(product_name, request_id): the smallest LEGACY_LOT request per product type, else the first request."""
    leg = (db.product_requests.alias("pr").where(c("pr.lot_number") == "LEGACY_LOT")
           .join(db.product_skus.alias("s"), c("pr.sku_id") == c("s.id"))
           .join(db.product_types.alias("t"), c("s.product_type_id") == c("t.id"))
           .groupBy(c("t.name").alias("product_name")).agg(F.min("pr.id").alias("request_id")))
    return leg


def etl_harvest(db, cutoff: str, unified: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E5: one new harvest per unified print whose (mount, printer user, print date) has no harvest yet.

    Returns (new product_harvest, inserted harvest rows, product->harvest candidates).
    """
    u = unified if unified is not None else views.v_unified_legacy_prints(db, cutoff)
    req = _legacy_request_per_type(db)
    first_req = db.product_requests.agg(F.min("id").alias("_first_req")).withColumn("_k", F.lit(1))
    legacy = (db.lids.where(c("serial_number") == "LEGACY_LID").agg(F.min("id").alias("_lid"))
              .withColumn("_k", F.lit(1))
              .join(db.seals.where(c("serial_number") == "LEGACY_SEAL").agg(F.min("id").alias("_seal"))
                    .withColumn("_k", F.lit(1)), "_k"))  # one-row scalars
    toins = (u.withColumn("_pname", F.when(c("product_name").isin("10K", "6K", "CS MINI"), c("product_name"))
                          .otherwise("10K"))
             .join(F.broadcast(req), c("_pname") == req.product_name, "left").drop(req.product_name)
             .withColumn("_k", F.lit(1))
             .join(F.broadcast(first_req), "_k").join(F.broadcast(legacy), "_k").drop("_k"))
    h = db.product_harvest
    key = ["filament_mounting_id", "printed_by", "print_date"]
    src = toins.select(
        "harvest_seq", "product_id_bigint",
        F.coalesce(c("request_id"), c("_first_req")).alias("request_id"), c("_lid").alias("lid_id"),
        c("_seal").alias("seal_id"), "filament_mounting_id", c("printed_by_id").alias("printed_by"),
        c("print_date_dt").alias("print_date"))
    # one harvest a key: a hot key does not multiply the prints
    known = h.groupBy(*key).agg(F.min("id").alias("_hid"), F.lit(True).alias("_known"))
    met = materialize(src.join(known, key, "left"))  # both the new and the known: the harvests are gathered once
    start = C.next_id(h)
    ins = C.assign_ids(met.where(c("_known").isNull()).drop("_hid", "_known"), ["harvest_seq"], start, "id")
    inserted = ins.select(*h.columns)
    new_h = h.unionByName(inserted)
    existing = met.where(c("_known")).groupBy("product_id_bigint").agg(F.min("_hid").alias("harvest_id"))
    cand = ins.select("product_id_bigint", c("id").alias("harvest_id")).unionByName(existing)
    return new_h, inserted, cand


def etl_harvest_map(candidates: DataFrame, existing_map: DataFrame | None = None) -> DataFrame:
    """One-to-one product -> harvest: smallest harvest per product, then smallest product per harvest;
    pairs that conflict with an existing map on either key are skipped."""
    per_product = candidates.groupBy("product_id_bigint").agg(F.min("harvest_id").alias("harvest_id"))
    one_to_one = per_product.groupBy("harvest_id").agg(F.min("product_id_bigint").alias("product_id_bigint"))
    if existing_map is not None:
        one_to_one = (one_to_one.join(existing_map.select("product_id_bigint"), "product_id_bigint", "left_anti")
                      .join(existing_map.select("harvest_id"), "harvest_id", "left_anti"))
    return one_to_one.select("product_id_bigint", "harvest_id")


def etl_tracking(db, cutoff: str, harvest_map: DataFrame, as_of: str,
                 unified: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Upsert units by product id from unified prints joined to the harvest map (location fallback)."""
    u = unified if unified is not None else views.v_unified_legacy_prints(db, cutoff)
    locs = ensure_default_locations(db)
    unassigned = locs.where(c("location_name") == "Unassigned").select(c("id").alias("_unassigned")).withColumn(
        "_k", F.lit(1))
    src = (u.join(harvest_map, "product_id_bigint")
           .join(locs.select(c("id").alias("_loc"), c("location_name").alias("_ln")),
                 c("storage_name") == c("_ln"), "left")
           .withColumn("_k", F.lit(1)).join(F.broadcast(unassigned), "_k")
           .select(c("product_id_bigint").alias("product_id"), "harvest_id", "product_type_id", "sku_id",
                   "current_status_id", F.lit(None).cast("long").alias("previous_stage_id"), "current_stage_id",
                   F.coalesce(c("_loc"), c("_unassigned")).alias("location_id"),
                   F.lit(as_of).cast("timestamp_ntz").alias("last_updated_at")))
    return C.merge_upsert(
        db.product_tracking, src, ["product_id"],
        set_cols=["harvest_id", "product_type_id", "sku_id", "current_status_id", "current_stage_id", "location_id",
                  "last_updated_at"],
        insert_cols=src.columns, id_col="id", id_order=["product_id"])


def etl_quality_control(db, tracking: DataFrame, cutoff: str, serial_offset: int = -2) -> tuple[DataFrame, DataFrame]:
    """Staging QC rows -> upsert into product_quality_control by (unit, inspected_at)."""
    sed = views.production_sheet(db)
    raw = _parsed(sed.where(_staging_scope(cutoff) & c("date_of_quality_check").isNotNull()
                            & c("weight_check_g").isNotNull() & c("pressure_drop_check_mbar").isNotNull()),
                  c("product_id_int").alias("product_id_bigint"),
                  F.trim(c("operater_quality_check")).alias("operator_name"),
                  X.parse_date_multi(c("date_of_quality_check"), serial_offset).alias("inspected_at"),
                  X.parse_decimal_comma(c("weight_check_g"), 6, 2).alias("weight_grams"),
                  X.parse_decimal_comma(c("pressure_drop_check_mbar"), 6, 3).alias("pressure_drop"),
                  F.upper(F.trim(c("visual_check"))).alias("visual_chk"),
                  F.upper(F.trim(c("status_quality_check"))).alias("status_qc"),
                  F.upper(F.trim(F.coalesce(c("second_rate_goods"), F.lit("")))).alias("second_rate"),
                  X.clip_text(c("comment"), 255).alias("notes"))
    t = tracking.select(c("id").alias("product_tracking_id"), c("product_id").alias("_pid"))
    users = db.users.select(c("id").alias("_uid"), c("display_name").alias("_uname"))
    m = (raw.join(t, c("product_id_bigint") == c("_pid"))
         .join(users, c("_uname") == c("operator_name"), "left")
         .where(c("inspected_at").isNotNull() & c("weight_grams").isNotNull() & c("pressure_drop").isNotNull()))
    m = _with_fallback(m, db.users)
    src = m.select("product_tracking_id", F.coalesce(c("_uid"), c("fallback_user_id")).alias("inspected_by"),
                   "inspected_at", "weight_grams", "pressure_drop",
                   F.when(c("visual_chk") == "FAIL", False).otherwise(True).alias("visual_pass"),
                   X.qc_result_matrix(c("status_qc"), c("second_rate")).alias("inspection_result"), "notes")
    return C.merge_upsert(db.product_quality_control, src, ["product_tracking_id", "inspected_at"],
                          set_cols=["inspected_by", "weight_grams", "pressure_drop", "visual_pass",
                                    "inspection_result", "notes"],
                          id_col="id", id_order=["product_tracking_id", "inspected_at"])


def etl_post_treatment(db, tracking: DataFrame, cutoff: str, serial_offset: int = -2) -> tuple[DataFrame, DataFrame]:
    """Staging incoming-goods checks -> upsert into post_treatment_inspections by (unit, inspected_at)."""
    sed = views.production_sheet(db)
    raw = _parsed(sed.where(_staging_scope(cutoff) & c("date_of_visual_check_incoming_goods").isNotNull()),
                  c("product_id_int").alias("product_id_bigint"),
                  F.trim(c("operator_visual_check_incoming_goods")).alias("operator_name"),
                  X.parse_date_multi(c("date_of_visual_check_incoming_goods"), serial_offset).alias("inspected_at"),
                  F.upper(F.trim(c("visual_check_1"))).alias("visual_chk_1"),
                  F.upper(F.trim(c("surface_treatment"))).alias("surface_treat"),
                  F.upper(F.trim(c("sterilization"))).alias("sterilization_chk"),
                  X.clip_text(c("comment"), 255).alias("notes"))
    t = tracking.select(c("id").alias("product_tracking_id"), c("product_id").alias("_pid"))
    users = db.users.select(c("id").alias("_uid"), c("display_name").alias("_uname"))
    m = (raw.join(t, c("product_id_bigint") == c("_pid"))
         .join(users, c("_uname") == c("operator_name"), "left")
         .where(c("inspected_at").isNotNull()))
    m = _with_fallback(m, db.users)
    flags = X.post_treat_flags(c("visual_chk_1"), c("surface_treat"), c("sterilization_chk"))
    src = m.select("product_tracking_id", F.coalesce(c("_uid"), c("fallback_user_id")).alias("inspected_by"),
                   "inspected_at", flags["visual_pass"].alias("visual_pass"),
                   flags["surface_treated"].alias("surface_treated"), flags["sterilized"].alias("sterilized"),
                   flags["qc_result"].alias("qc_result"), "notes")
    return C.merge_upsert(db.post_treatment_inspections, src, ["product_tracking_id", "inspected_at"],
                          set_cols=["inspected_by", "visual_pass", "surface_treated", "sterilized", "qc_result", "notes"],
                          id_col="id", id_order=["product_tracking_id", "inspected_at"])


def etl_consistency_rules(db, tracking: DataFrame, as_of: str) -> DataFrame:
    """(1) location Waste => stage Disposed + status Waste; (2) stage Disposed => status Waste and
    location Waste; (3) stage InTreatment/Shipped => location Offsite. Rules apply in order; only rows
    a rule changes get ``last_updated_at = as_of``."""
    locs = ensure_default_locations(db)
    ids = (locs.groupBy().pivot("location_name", ["Waste", "Offsite"]).agg(F.min("id"))
           .withColumnRenamed("Waste", "_waste_loc").withColumnRenamed("Offsite", "_offsite_loc"))
    st = db.lifecycle_stages.groupBy().pivot("stage_code", ["Disposed", "InTreatment", "Shipped"]).agg(F.min("id"))
    stat = db.product_statuses.groupBy().pivot("status_name", ["Waste"]).agg(F.min("id")).withColumnRenamed(
        "Waste", "_waste_status")
    consts = (ids.withColumn("_k", F.lit(1)).join(st.withColumn("_k", F.lit(1)), "_k")
              .join(stat.withColumn("_k", F.lit(1)), "_k"))  # one-row scalars
    t = tracking.withColumn("_k", F.lit(1)).join(F.broadcast(consts), "_k").drop("_k")
    r1 = c("location_id") == c("_waste_loc")
    stage1 = F.when(r1, c("Disposed")).otherwise(c("current_stage_id"))
    status1 = F.when(r1, c("_waste_status")).otherwise(c("current_status_id"))
    r2 = stage1 == c("Disposed")
    status2 = F.when(r2, c("_waste_status")).otherwise(status1)
    loc2 = F.when(r2, c("_waste_loc")).otherwise(c("location_id"))
    r3 = stage1.isin(c("InTreatment"), c("Shipped"))
    loc3 = F.when(r3, c("_offsite_loc")).otherwise(loc2)
    changed = (~stage1.eqNullSafe(c("current_stage_id")) | ~status2.eqNullSafe(c("current_status_id"))
               | ~loc3.eqNullSafe(c("location_id")))
    out = (t.withColumn("_ns", stage1).withColumn("_nst", status2).withColumn("_nl", loc3)
           .withColumn("_chg", changed))
    cols = []
    for x in tracking.columns:
        if x == "current_stage_id":
            cols.append(c("_ns").alias(x))
        elif x == "current_status_id":
            cols.append(c("_nst").alias(x))
        elif x == "location_id":
            cols.append(c("_nl").alias(x))
        elif x == "last_updated_at":
            cols.append(F.when(c("_chg"), F.lit(as_of).cast("timestamp_ntz")).otherwise(c(x)).alias(x))
        else:
            cols.append(c(x))
    return out.select(*cols)


class Versions:
    """The tables of ``db``, with the newer versions that the pipeline has written laid over them."""

    def __init__(self, db):
        self._db, self._new = db, {}

    def __getattr__(self, name):
        return self._new[name] if name in self._new else getattr(self._db, name)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        if name == "storage_locations":
            self.__dict__.pop("_ensured_locations", None)  # derived from the locations
        new = self._new[name] = materialize(df)
        self.__dict__.setdefault("_written_once", {})[name] = (new, new)
        return new

    def prints(self, cutoff: str) -> DataFrame:
        """The unified legacy prints (D7) of the versions at the first call; their numbering has written them."""
        if "_prints" not in self.__dict__:
            self.__dict__["_prints"] = views.v_unified_legacy_prints(self, cutoff)
        return self.__dict__["_prints"]

    def written(self) -> dict[str, DataFrame]:
        return dict(self._new)


def _run_filaments(v, cutoff, as_of):
    users = v.put("users", ensure_legacy_user(v))
    locations = v.put("storage_locations", _locations_with_shelves(v))
    v.__dict__["_ensured_locations"] = locations  # they hold the default rows
    v.put("filaments", etl_filaments(v, cutoff, as_of, users, locations)[0])


def _run_harvest(v, cutoff, as_of):
    harvest, _, cand = etl_harvest(v, cutoff, v.prints(cutoff))
    v.put("etl_harvest_map", etl_harvest_map(cand))
    v.put("product_harvest", harvest)


def _run_treatment(v, cutoff, as_of):
    out = etl_treatment_batches(v, v.product_tracking, cutoff)
    v.put("treatment_batches", out["treatment_batches"])
    v.put("treatment_batch_products", out["treatment_batch_products"])


# label -> step; the order is the source pipeline's
PIPELINE_STEPS = {
    "filaments": _run_filaments,
    "filament_mounting": lambda v, cutoff, as_of: v.put("filament_mounting", etl_mounting(v, as_of)),
    "filament_acclimatization": lambda v, cutoff, as_of: v.put("filament_acclimatization", etl_acclimatization(v, as_of)[0]),
    "product_harvest": _run_harvest,
    "product_tracking": lambda v, cutoff, as_of: v.put(
        "product_tracking", etl_tracking(v, cutoff, v.etl_harvest_map, as_of, v.prints(cutoff))[0]),
    "product_quality_control": lambda v, cutoff, as_of: v.put(
        "product_quality_control", etl_quality_control(v, v.product_tracking, cutoff)[0]),
    "treatment_batch": _run_treatment,
    "post_treatment_inspections": lambda v, cutoff, as_of: v.put(
        "post_treatment_inspections", etl_post_treatment(v, v.product_tracking, cutoff)[0]),
    "consistency_rules": lambda v, cutoff, as_of: v.put(
        "product_tracking", etl_consistency_rules(v, v.product_tracking, as_of)),
}


def etl_pipeline(db, cutoff: str, as_of: str, only: set[str] | None = None, stage: bool = True, transform: bool = True,
                 staging: dict[str, DataFrame] | None = None, until: str | None = None) -> dict[str, DataFrame]:
    """Stage new extracts, then run the transforms in order; returns every table version written.

    ``only`` restricts staging tables and transforms to its labels, ``stage`` and
    ``transform`` switch either half off, ``staging`` holds new staging tables by
    label, and ``until`` ends after that transform. Each version is written once,
    and later steps read it.
    """
    unknown = ((only or set()) | ({until} if until else set())) - set(PIPELINE_STEPS) - set(staging or {})
    if unknown:
        raise ValueError(f"no such step or staging table: {sorted(unknown)}")
    v = Versions(db)
    for label, extract in (staging or {}).items() if stage else ():
        if only is None or label in only:
            v.put(label, extract)
    for label, step in PIPELINE_STEPS.items() if transform else ():
        if only is None or label in only:
            step(v, cutoff, as_of)
        if label == until:
            break
    return v.written()


def version_outcome(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """One row: rows of the new version, rows with new ids, and old rows that differ."""
    names = sorted(x for x in new.columns if x != "id")
    before = old.select(c("id").alias("_old"), F.struct(*names).alias("_was"))
    j = new.select("id", F.struct(*names).alias("_is")).join(before, c("id") == c("_old"), "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(c("_old").isNull()).alias("n_inserted"),
                 F.count_if(c("_old").isNotNull() & ~c("_is").eqNullSafe(c("_was"))).alias("n_changed")).select(
        F.lit(table).alias("table_name"), "n_rows", "n_inserted", "n_changed")


def pipeline_outcome(db, versions: dict[str, DataFrame]) -> DataFrame:
    """C4 for E16: one row per table that the pipeline wrote and that existed before."""
    out = None
    for name, df in versions.items():
        if name != "etl_harvest_map":
            row = version_outcome(getattr(db, name), df, name)
            out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------------------
# Materials: spools (E1, E13), mounts (E3), acclimatization
# ---------------------------------------------------------------------------

LEGACY_IMPORT_UPN = "legacy-import@system"
LEGACY_IMPORT_NAME = "Legacy Import (System)"


def ensure_legacy_user(db) -> DataFrame:
    """C9 (users): the inactive legacy-import user, in the first department, added when missing."""
    dept = db.departments.agg(F.min("id").alias("department_id"))
    row = dept.select(F.lit(None).cast("long").alias("id"), F.lit(LEGACY_IMPORT_NAME).alias("display_name"),
                      c("department_id").cast("long"), F.lit(False).alias("is_active"),
                      F.lit(None).cast("string").alias("azure_ad_object_id"),
                      F.lit(LEGACY_IMPORT_UPN).alias("user_principal_name"))
    new, _ = C.insert_missing(db.users, row, ["user_principal_name"], id_col="id", id_order=["display_name"])
    return new


def _locations_with_shelves(db) -> DataFrame:
    """Storage locations after C9 (Unassigned) and E2 (staging shelves as new 'Shelf' locations)."""
    base = ensure_default_locations(db)
    shelves = etl_new_shelves(db).join(base.select("location_name"), "location_name", "left_anti").select(
        F.lit(None).cast("long").alias("id"), "location_name", F.lit("Shelf").alias("location_type"),
        F.lit("Imported from legacy filaments").alias("description"), F.lit(True).alias("is_active"))
    new, _ = C.insert_missing(base, shelves, ["location_name"], id_col="id", id_order=["location_name"])
    return new


def _eligible_spools(db, cutoff: str) -> DataFrame:
    sed = views.production_sheet(db)
    used = (sed.where(c("filament_id_int").isNotNull() & _harvested_since(cutoff))
            .select(c("filament_id_int").alias("filament_id")))
    fe = views.spool_sheet(db)
    received = (fe.where(c("vsc_ts_any").cast("date") >= F.to_date(F.lit(cutoff)))
                .select(c("spool_id").alias("filament_id")))
    return used.union(received).distinct()


def etl_filaments(db, cutoff: str, as_of: str, users: DataFrame | None = None,
                  locations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Upsert spools by filament id from the spool sheet, for spools used or received since ``cutoff``.

    Location by shelf name (new shelves are added first, blank -> Unassigned);
    receiver by case/accent-insensitive display name, else the legacy-import
    user; duplicate source rows per spool keep the latest receipt (then the
    smallest serial).
    """
    users = ensure_legacy_user(db) if users is None else users
    fallback = users.where(c("user_principal_name") == LEGACY_IMPORT_UPN).agg(F.min("id").alias("_fb")).withColumn(
        "_k", F.lit(1))
    locs = _locations_with_shelves(db) if locations is None else locations
    unassigned = locs.where(c("location_name") == "Unassigned").agg(F.min("id").alias("_un")).withColumn(
        "_k", F.lit(1))
    fe = views.spool_sheet(db)
    base = fe.select(c("spool_id").alias("filament_id"),
                     X.blank_to_null(c("filament")).alias("filament_raw"),
                     X.blank_to_null(c("shelf")).alias("shelf_name"),
                     F.replace(c("weight_fl"), F.lit(","), F.lit(".")).try_cast("decimal(10,2)").alias("weight_grams"),
                     c("vsc_ts").alias("received_at"),
                     X.blank_to_null(c("vsc_operator")).alias("operator_legacy"),
                     F.coalesce(c("vs_check"), F.lit("")).alias("vs_check"))
    # names are compared by collation once per operator; the sheet's rows then join by plain text
    u = (base.select(c("operator_legacy").alias("_op")).distinct()
         .join(users.select(c("id").alias("_uid"), F.collate(c("display_name"), "UNICODE_CI_AI").alias("_uname")),
               F.collate(c("_op"), "UNICODE_CI_AI") == c("_uname")).select("_op", "_uid"))
    norm = (base.where(c("filament_raw").isNotNull() & c("filament_id").isNotNull())
            .join(locs.select(c("id").alias("_loc"), c("location_name").alias("_ln")),
                  c("shelf_name") == c("_ln"), "left")
            .join(u, c("operator_legacy") == c("_op"), "left")
            .withColumn("_k", F.lit(1))
            .join(F.broadcast(fallback), "_k").join(F.broadcast(unassigned), "_k")
            .select("filament_id",
                    X.clip_text(c("filament_raw"), 100).alias("serial_number"),
                    X.lot_prefix(c("filament_raw")).alias("lot_number"),
                    F.coalesce(c("_loc"), c("_un")).alias("location_id"),
                    F.coalesce(c("weight_grams"), F.lit(0).cast("decimal(10,2)")).alias("weight_grams"),
                    F.coalesce(c("received_at"), F.lit(as_of).cast("timestamp_ntz")).alias("received_at"),
                    F.coalesce(c("_uid"), c("_fb")).alias("received_by"),
                    X.pass_fail(c("vs_check")).alias("qc_result")))
    src = norm.join(_eligible_spools(db, cutoff), "filament_id", "left_semi")
    # one row per spool: latest receipt, then smallest serial (aggregate, so a hot key and equal rows collapse map-side)
    src = (src.groupBy("filament_id")
           .agg(F.min_by(F.struct("serial_number", "lot_number", "location_id", "weight_grams", "received_at",
                                  "received_by", "qc_result"),
                         F.struct(F.lit(0) - F.unix_micros(c("received_at").cast("timestamp")), c("serial_number"),
                                  c("location_id"), c("weight_grams"), c("received_by"), c("qc_result"))).alias("b"))
           .select("filament_id", "b.*"))
    return C.merge_upsert(db.filaments, src, ["filament_id"],
                          set_cols=["serial_number", "lot_number", "location_id", "weight_grams", "received_at",
                                    "received_by", "qc_result"], id_col="id", id_order=["filament_id"])


def etl_acclimatization(db, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Spools whose staging shelf is AIR LOCK get an 'Acclimatizing' record when they have none."""
    fe = views.spool_sheet(db)
    air = (fe.select(c("spool_id").alias("_fid"), F.upper(F.trim(c("shelf"))).alias("_shelf"))
           .where(c("_fid").isNotNull() & (c("_shelf") == "AIR LOCK")).select("_fid").distinct())
    mover = db.users.agg(F.coalesce(F.min(F.when(c("id") == 1, c("id"))), F.min("id")).alias("moved_by")).withColumn(
        "_k", F.lit(1))
    src = (air.join(db.filaments.select(c("id").alias("filament_tracking_id"), c("filament_id").alias("_f")),
                    c("_fid") == c("_f"))
           .withColumn("_k", F.lit(1)).join(F.broadcast(mover), "_k")
           .select(F.lit(None).cast("long").alias("id"), "filament_tracking_id", "moved_by",
                   F.lit(as_of).cast("timestamp_ntz").alias("moved_at"),
                   X.ready_at(F.lit(as_of).cast("timestamp_ntz")).alias("ready_at"),
                   F.lit("Acclimatizing").alias("status")))
    return C.insert_missing(db.filament_acclimatization, src, ["filament_tracking_id"], id_col="id",
                            id_order=["filament_tracking_id"])


def etl_mounting(db, as_of: str) -> DataFrame:
    """(spool, printer) pairs used in production or listed in the spool sheet -> mounts.

    Pairs from inventory with a printer are 'In Use' with the sheet's weight
    (text that is not a plain decimal gives 0); pairs seen only in production
    are 'Unmounted'. Matched mounts take weight and status and get their
    unmount time/user set once; new pairs are inserted.
    """
    sed, fe = views.production_sheet(db), views.spool_sheet(db)
    used = (sed.where(c("filament_id_int").isNotNull() & c("printer").isNotNull() & (F.trim(c("printer")) != ""))
            .select(c("filament_id_int").alias("fid"), F.trim(c("printer")).alias("pname")).distinct())
    inv = (fe.where(c("spool_id_int").isNotNull()
                    & (c("usage").isNull() | (F.upper(F.trim(c("usage"))) != "NO"))
                    & c("printer_fi").isNotNull() & (F.trim(c("printer_fi")) != ""))
           .select(c("spool_id_int").alias("fid"), F.trim(c("printer_fi")).alias("pname"),
                   "usage", "weight_fl", "printer_fi").distinct())
    pairs = used.union(inv.select("fid", "pname")).distinct()
    base = (pairs.join(db.filaments.select(c("id").alias("filament_tracking_id"), c("filament_id").alias("_f")),
                       c("fid") == c("_f"))
            .join(broadcast_if_small(db.printers.select(c("id").alias("printer_id"), c("name").alias("_pn"))),
                  c("pname") == c("_pn"))
            .join(inv.withColumnRenamed("fid", "_ifid").withColumnRenamed("pname", "_ipn"),
                  (c("fid") == c("_ifid")) & (c("pname") == c("_ipn")), "left"))
    who = db.users.agg(F.coalesce(F.min(F.when(c("display_name") == "Unassigned", c("id"))), F.min("id"))
                       .alias("_by")).withColumn("_k", F.lit(1))
    now = F.lit(as_of).cast("timestamp_ntz")
    in_use = c("printer_fi").isNotNull() & (F.trim(c("printer_fi")) != "")
    src = (base.withColumn("_k", F.lit(1)).join(F.broadcast(who), "_k")  # one-row scalar
           .select("filament_tracking_id", "printer_id", c("_by").alias("mounted_by"), now.alias("mounted_at"),
                   F.when(~F.coalesce(in_use, F.lit(False)), now).alias("unmounted_at"),
                   F.when(~F.coalesce(in_use, F.lit(False)), c("_by")).alias("unmounted_by"),
                   F.coalesce(c("weight_fl").try_cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)"))
                   .alias("remaining_weight"),
                   F.when(in_use, "In Use").otherwise("Unmounted").alias("status")))
    return C.merge_upsert(db.filament_mounting, src, ["filament_tracking_id", "printer_id"],
                          set_cols=["remaining_weight", "status"], fill_cols=["unmounted_at", "unmounted_by"])[0]


# ---------------------------------------------------------------------------
# Treatment batches
# ---------------------------------------------------------------------------

TREATMENT_ACTIVE = ["AT GEB", "AT BBF", "YES"]


def _empty_treatment_map(spark) -> DataFrame:
    return spark.createDataFrame([], "treatment_key STRING, batch_id BIGINT")


def etl_treatment_batches(db, tracking: DataFrame, cutoff: str,
                          existing_map: DataFrame | None = None) -> dict[str, DataFrame]:
    """Legacy treatments -> batches, received dates, batch units.

    E10: treatment keys (cleaned) that occur as a transfer id in the product
    sheet since ``cutoff``, sent since ``cutoff``, with an active treatment
    flag, become new batches unless already mapped. E11: Inspected batches
    take the earliest incoming-goods date of their transfer key. E12: units of
    the product sheet are linked to the batch of their transfer key when they
    are in no batch yet (a unit under two keys goes to the earliest batch).
    """
    cut = F.to_date(F.lit(cutoff))
    sed = views.production_sheet(db)
    in_scope = c("transfer_key").isNotNull() & _harvested_since(cutoff)
    xfer = sed.where(in_scope).select(c("transfer_key").alias("treatment_key")).distinct()
    t = written_once(db, "stg_treatment_excel_data").select(
        X.clean_key(c("treatment_id")).alias("treatment_key"), X.clean_key(c("in_treatment")).alias("in_treat"),
        F.trim(c("operator")).alias("operator_name"), X.parse_date_multi(c("run_date")).alias("sent_at"))
    treat = (t.join(xfer, "treatment_key", "left_semi")
             .where(c("treatment_key").isNotNull() & (c("treatment_key") != "") & c("sent_at").isNotNull()
                    & (c("sent_at").cast("date") >= cut) & (c("in_treat") != "NO")
                    & c("in_treat").isin(*TREATMENT_ACTIVE))
             .select("treatment_key", "sent_at", X.treatment_status(c("in_treat")).alias("status"),
                     X.treatment_notes(c("treatment_key"), c("operator_name")).alias("notes"))
             .distinct())
    treat = materialize(treat)  # read by the check, the new batches and the received dates
    C.check_unique(treat, ["treatment_key"])
    old_map = existing_map if existing_map is not None else _empty_treatment_map(db.spark)
    sender = db.users.agg(F.coalesce(F.min(F.when(c("user_principal_name") == LEGACY_IMPORT_UPN, c("id"))),
                                     F.min("id")).alias("sent_by")).withColumn("_k", F.lit(1))
    batches = db.treatment_batches
    new = (treat.join(old_map, "treatment_key", "left_anti")
           .withColumn("_k", F.lit(1)).join(F.broadcast(sender), "_k").drop("_k"))
    new = C.assign_ids(new, ["treatment_key"], C.next_id(batches), "id")
    new_map = old_map.unionByName(new.select("treatment_key", c("id").alias("batch_id")))
    new_batches = new.select("id", "sent_by", "sent_at", F.lit(None).cast("timestamp_ntz").alias("received_at"),
                             "notes", "status")
    # Received date for Inspected batches
    recv = (sed.where(in_scope & c("date_of_visual_check_incoming_goods").isNotNull())
            .groupBy(c("transfer_key").alias("treatment_key"))
            .agg(F.min(X.parse_date_multi(c("date_of_visual_check_incoming_goods"))).alias("_recv")))
    upd = (treat.where(c("status") == "Inspected").select("treatment_key").join(new_map, "treatment_key")
           .join(recv, "treatment_key").where(c("_recv").isNotNull()).select(c("batch_id").alias("_bid"), "_recv"))
    all_batches = batches.unionByName(new_batches)
    all_batches = (all_batches.join(upd, all_batches.id == upd._bid, "left")
                   .withColumn("received_at", F.coalesce(c("_recv"), c("received_at"))).drop("_bid", "_recv"))
    # Batch units
    prod = (sed.where(in_scope & c("product_id_int").isNotNull())
            .select(c("transfer_key").alias("treatment_key"), c("product_id_int").alias("_pid"))
            .join(tracking.select(c("id").alias("product_tracking_id"), c("product_id").alias("_tpid")),
                  c("_pid") == c("_tpid"))
            .select("treatment_key", "product_tracking_id").distinct()
            .join(new_map, "treatment_key"))
    links = (prod.join(db.treatment_batch_products.select("product_tracking_id"), "product_tracking_id", "left_anti")
             .groupBy("product_tracking_id").agg(F.min("batch_id").alias("batch_id")))
    links = C.assign_ids(links, ["product_tracking_id"], C.next_id(db.treatment_batch_products), "id").select(
        "id", "batch_id", "product_tracking_id", F.lit(True).alias("surface_treat"), F.lit(True).alias("sterilize"))
    return {"treatment_batches": all_batches, "etl_treatment_map": new_map,
            "treatment_batch_products": db.treatment_batch_products.unionByName(links),
            "new_batch_products": links}


# ---------------------------------------------------------------------------
# Harvest map with clones
# ---------------------------------------------------------------------------

def etl_harvest_clone(db, harvest: DataFrame, cutoff: str,
                      existing_map: DataFrame | None = None) -> dict[str, DataFrame]:
    """Earliest qualifying staging row per product, matched to harvests by (printer user, print date).

    Each product takes its smallest matching harvest. Per harvest, the first
    product (smallest id) reuses it when the harvest is not mapped yet; every
    other product gets a clone of that harvest row with a new id. Products
    with no matching harvest are reported as unmapped.
    """
    sed = views.production_sheet(db)
    valid = (sed.where(c("product").isin(*LEGACY_PRODUCTS) & c("status_quality_check").isNotNull()
                       & c("printer").isNotNull() & c("product_id_int").isNotNull() & c("filament_id_int").isNotNull()
                       & _harvested_since(cutoff))
             .select(c("product_id_int").alias("product_id_bigint"), c("harvest_ts").alias("print_date_dt"),
                     F.trim(c("operator_harvest")).alias("operator_trim")))
    # earliest row per product (aggregate: a product with many rows collapses map-side)
    pick = C.earliest_per_key(valid, ["product_id_bigint"], ["print_date_dt", "operator_trim"])
    fb = db.users.agg(F.min("id").alias("_fb")).withColumn("_k", F.lit(1))
    pick_u = (pick.join(db.users.select(c("id").alias("_uid"), c("display_name").alias("_un")),
                        c("operator_trim") == c("_un"), "left")
              .withColumn("_k", F.lit(1)).join(F.broadcast(fb), "_k")
              .select("product_id_bigint", "operator_trim", "print_date_dt",
                      F.coalesce(c("_uid"), c("_fb")).alias("printed_by_id")))
    # one row per (user, date) before the join: a day's products and harvests are not paired with one another
    least = harvest.groupBy(c("printed_by").alias("_pb"), c("print_date").alias("_pd")).agg(
        F.min("id").alias("base_harvest_id"))
    matches = (pick_u.join(least, (c("printed_by_id") == c("_pb")) & (c("print_date_dt") == c("_pd")))
               .groupBy("product_id_bigint").agg(F.min("base_harvest_id").alias("base_harvest_id")))
    old = existing_map if existing_map is not None else db.spark.createDataFrame(
        [], "product_id_bigint BIGINT, harvest_id BIGINT")
    todo = matches.join(old.select("product_id_bigint"), "product_id_bigint", "left_anti")
    used = old.select(c("harvest_id").alias("_used")).distinct()
    first = todo.groupBy("base_harvest_id").agg(F.min("product_id_bigint").alias("_first"))
    ranked = (todo.join(first, "base_harvest_id")
              .join(used, c("base_harvest_id") == c("_used"), "left")
              .withColumn("reuse", (c("product_id_bigint") == c("_first")) & c("_used").isNull()))
    reuse = ranked.where(c("reuse")).select("product_id_bigint", c("base_harvest_id").alias("harvest_id"))
    # few harvests stand for all products of their day: reduced to them, the table can be broadcast
    bases = views.used_rows(harvest, first, "base_harvest_id")
    clone_src = (ranked.where(~c("reuse")).join(bases.alias("h"), c("base_harvest_id") == c("h.id"))
                 .select("product_id_bigint", "h.request_id", "h.lid_id", "h.seal_id", "h.filament_mounting_id",
                         "h.printed_by", "h.print_date"))
    clones = C.assign_ids(clone_src, ["product_id_bigint"], C.next_id(harvest), "id")
    new_map = old.unionByName(reuse).unionByName(clones.select("product_id_bigint", c("id").alias("harvest_id")))
    mapped = (reuse.withColumn("how", F.lit("reuse"))
              .unionByName(clones.select("product_id_bigint", c("id").alias("harvest_id"), F.lit("clone").alias("how"))))
    unmapped = pick_u.join(new_map.select("product_id_bigint"), "product_id_bigint", "left_anti").select(
        "product_id_bigint", "operator_trim", "print_date_dt")
    return {"etl_harvest_map": new_map, "mapped": mapped,
            "product_harvest": harvest.unionByName(clones.select(*harvest.columns)), "unmapped": unmapped}


def etl_filaments_by_serial(db, as_of: str) -> tuple[DataFrame, DataFrame]:
    """E13 (debug variant of E1): serial = the sheet's id text, lot = the full spool text; upsert by serial.

    Shelves are added as locations before 'Unassigned'; the receiver is the
    first user; weight and receipt keep the old value when the new one is
    missing. Duplicate serials in the sheet (which the database would reject)
    keep the latest receipt, then the smallest lot.
    """
    shelves = etl_new_shelves(db).select(F.lit(None).cast("long").alias("id"), "location_name",
                                         F.lit("Shelf").alias("location_type"),
                                         F.lit("Imported from legacy filaments").alias("description"),
                                         F.lit(True).alias("is_active"))
    locs, _ = C.insert_missing(db.storage_locations, shelves, ["location_name"], id_col="id", id_order=["location_name"])
    un = db.spark.createDataFrame([(None, "Unassigned", "Virtual", "Fallback for missing shelf", True)],
                                  "id BIGINT, location_name STRING, location_type STRING, description STRING, "
                                  "is_active BOOLEAN")
    locs, _ = C.insert_missing(locs, un, ["location_name"], id_col="id", id_order=["location_name"])
    consts = (locs.where(c("location_name") == "Unassigned").agg(F.min("id").alias("_un")).withColumn("_k", F.lit(1))
              .join(db.users.agg(F.min("id").alias("_fb")).withColumn("_k", F.lit(1)), "_k"))
    fe = views.spool_sheet(db)
    base = fe.select(X.blank_to_null(c("filament_id")).alias("serial_number"),
                     X.blank_to_null(c("filament")).alias("lot_number"),
                     X.blank_to_null(c("shelf")).alias("shelf_name"),
                     F.replace(c("weight_fl"), F.lit(","), F.lit(".")).try_cast("decimal(10,2)").alias("weight_grams"),
                     c("vsc_ts").alias("received_at"),
                     F.coalesce(c("vs_check"), F.lit("")).alias("vs_check"))
    norm = (base.where(c("serial_number").isNotNull())
            .join(locs.select(c("id").alias("_loc"), c("location_name").alias("_ln")),
                  c("shelf_name") == c("_ln"), "left")
            .withColumn("_k", F.lit(1)).join(F.broadcast(consts), "_k")
            .select("serial_number", "lot_number", F.coalesce(c("_loc"), c("_un")).alias("location_id"),
                    F.coalesce(c("weight_grams"), F.lit(0).cast("decimal(10,2)")).alias("weight_grams"),
                    F.coalesce(c("received_at"), F.lit(as_of).cast("timestamp_ntz")).alias("received_at"),
                    c("_fb").alias("received_by"), X.pass_fail(c("vs_check")).alias("qc_result"))
            .distinct())
    src = (norm.groupBy("serial_number")
           .agg(F.min_by(F.struct("lot_number", "location_id", "weight_grams", "received_at", "received_by", "qc_result"),
                         F.struct(F.lit(0) - F.unix_micros(c("received_at").cast("timestamp")), c("lot_number"),
                                  c("location_id"), c("weight_grams"), c("qc_result"))).alias("b"))
           .select("serial_number", "b.*"))
    return C.merge_upsert(db.filaments, src, ["serial_number"],
                          set_cols=["lot_number", "location_id", "weight_grams", "received_at", "received_by",
                                    "qc_result"], id_col="id", id_order=["serial_number"])
