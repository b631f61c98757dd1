"""The generic operators (C1-C9, A1, A5, A8, A14, I11) applied to the supplied data, one query each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.operators import merge as C
from spooltrace.operators.ranking import row_number_global
from spooltrace.sources import staging as A

c = F.col


def assign_ids(db) -> DataFrame:
    """Ids 1.. for the staging print rows in (product id text, event) order."""
    s = db._stg_excel_with_id().select(c("_event_id").alias("event_id"), "product_id")
    return C.assign_ids(s, ["product_id", "event_id"], 1, "id")


def global_row_number(db) -> DataFrame:
    """ROW_NUMBER() OVER (ORDER BY last update, id) over all units, without a single-partition window."""
    return row_number_global(db.product_tracking.select("id", "last_updated_at"), ["last_updated_at", "id"], col="rn")


def _lid_restock(db) -> DataFrame:
    used = (db.material_usage.where(c("material_type") == "Lid")
            .groupBy(c("lot_number").alias("serial_number")).agg(F.count(F.lit(1)).alias("_n")))
    cur = db.lids.select("serial_number", "quantity")
    return (used.join(cur, "serial_number", "left")
            .select("serial_number", (F.coalesce(c("quantity"), F.lit(0)) + c("_n")).cast("long").alias("quantity"),
                    F.lit(1).cast("long").alias("location_id"), F.lit("PASS").alias("qc_result")))


def merge_upsert(db):
    """Lid batches topped up by the number of lids used from them; unknown batches are inserted."""
    return C.merge_upsert(db.lids, _lid_restock(db), ["serial_number"], set_cols=["quantity"],
                          insert_cols=["serial_number", "quantity", "location_id", "qc_result"], id_col="id",
                          id_order=["serial_number"])


def merge_outcome(db) -> DataFrame:
    """C4: action counts of the lid top-up merge."""
    return C.merge_outcome(merge_upsert(db)[1])


def insert_missing(db) -> DataFrame:
    """Seal batches named in usage but missing from the seal table are inserted (insert-only)."""
    lots = (db.material_usage.where(c("material_type") == "Seal").select(c("lot_number").alias("serial_number"))
            .distinct().select("serial_number", F.lit(0).cast("long").alias("quantity"), F.lit("PASS").alias("qc_result")))
    return C.insert_missing(db.seals, lots, ["serial_number"], id_col="id", id_order=["serial_number"])[0]


def earliest_per_key(db) -> DataFrame:
    """The earliest material usage row per unit (ties broken by the remaining columns)."""
    u = db.material_usage.select("product_tracking_id", "used_at", "id", "material_type", "lot_number", "used_quantity")
    return C.earliest_per_key(u, ["product_tracking_id"], ["used_at", "id", "material_type", "lot_number",
                                                          "used_quantity"])


def next_tracking_id(db) -> DataFrame:
    """The next unit business id (max + 1, 1000000 for an empty table), as a one-row table."""
    return db.product_tracking.agg(F.coalesce(F.max("product_id") + 1, F.lit(1000000)).cast("long").alias("next_id"))


def ensure_default_rows(db) -> DataFrame:
    """The rows the transforms rely on after they are ensured: default locations, the legacy-import user and
    the legacy request of each product type."""
    from spooltrace.plans import etl as E
    locs = E.ensure_default_locations(db).where(c("location_name").isin("Unassigned", "Waste", "Offsite")).select(
        F.lit("storage_locations").alias("kind"), c("location_name").alias("name"), "id")
    user = E.ensure_legacy_user(db).where(c("user_principal_name") == E.LEGACY_IMPORT_UPN).select(
        F.lit("users").alias("kind"), c("display_name").alias("name"), "id")
    req = E._legacy_request_per_type(db).select(F.lit("product_requests").alias("kind"), c("product_name").alias("name"),
                                                c("request_id").alias("id"))
    return locs.unionByName(user).unionByName(req)


def _scratch(db) -> str:
    from spooltrace.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(db.spark)  # the session's shared checkpoint folder
    return f"{base.rstrip('/')}/staging-{uuid.uuid4().hex}"


def load_staging(db) -> DataFrame:
    """A5: the spool sheet staged (replaced) under the session's shared checkpoint folder and read back."""
    path = _scratch(db)
    A.load_staging(db.stg_filament_excel_data, path, truncate=True)
    return db.spark.read.parquet(path)


EXPORT_COLUMNS = ["order_id", "product_type_id", "product_type", "quantity"]


def export_csv(db) -> DataFrame:
    """A8 + A14: canceled order lines exported as CSV with a header and read back with the all-text schema."""
    from spooltrace.plans.sales import canceled_order_items
    path = _scratch(db)
    A.export_csv(canceled_order_items(db), path)
    return A.read_staging(db.spark, path, EXPORT_COLUMNS, fmt="csv")


def part_sheets(db) -> DataFrame:
    """A cell table: one sheet per part type, a title above, the parts' labels (messy, repeated, some blank) as its
    header and their prices below."""
    p = db.src("part")
    name = c("p_name")
    label = F.when(c("p_size") == 1, F.lit(" ")).otherwise(F.element_at(F.array(
        F.concat(F.lit(" "), name, F.lit("\t")), F.replace(name, F.lit(" "), F.lit("\n")),
        F.upper(F.replace(name, F.lit(" "), F.lit("   "))),
        F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit(" ["), c("p_brand"), F.lit("]"))),
        (c("p_partkey") % 4 + 1).cast("int")))
    at = [c("p_type").alias("sheet"), c("p_partkey").alias("position")]
    titles = p.groupBy(c("p_type").alias("sheet")).agg(F.min("p_partkey").alias("position")).select(
        "sheet", F.lit(1).alias("row_no"), "position", F.concat(F.lit("Parts of type "), "sheet").alias("value"))
    return (titles.unionByName(p.select(*at, F.lit(3).alias("row_no"), label.alias("value")))
            .unionByName(p.select(*at, F.lit(4).alias("row_no"), c("p_retailprice").cast("string").alias("value"))))


def stage_headers(db) -> DataFrame:
    """A1: the header row of every part sheet, found among its rows, with normalized names."""
    return A.header_cells(part_sheets(db))


def stage_dedupe_columns(db) -> DataFrame:
    """A2: the same names with repeats numbered by position."""
    return A.number_repeats(stage_headers(db))


def user_lookup(db) -> DataFrame:
    """Sign-in e-mails (trimmed, lower-cased) looked up by principal name among users after the sign-ins."""
    from spooltrace.plans import transitions as K
    users = K.apply_users(db, db.users, K.login_commands(db, 1))
    emails = db.src("supplier").select(
        F.concat(F.lit(" USER"), c("s_suppkey").cast("string"), F.lit("@PLANT.EXAMPLE ")).alias("email"))
    key = F.lower(F.trim(c("email")))
    return (emails.join(users.select("id", "display_name", "user_principal_name"), key == c("user_principal_name"))
            .select("email", "id", "display_name"))


TREATMENT_COLUMNS = ["treatment_id", "in_treatment", "run_date", "operator"]


def xl_staging_schema(db) -> DataFrame:
    """The treatment sheet dropped as CSV and read back with the all-text staging schema."""
    path = _scratch(db)
    A.export_csv(db.stg_treatment_excel_data.select(*TREATMENT_COLUMNS), path)
    return A.read_staging(db.spark, path, TREATMENT_COLUMNS, fmt="csv")


def stage_drop_empty(db) -> DataFrame:
    """A3: the production sheet body below the header, all-empty rows and 'Unnamed' (blank-header) columns
    dropped; columns keep their sheet position (p0, p1, ...)."""
    start, col0 = db.RAW_START_ROW, db.RAW_START_COL
    raw = db.raw_production_sheet
    cols = [f"c{k}" for k in range(col0, db.RAW_WIDTH + 1)]
    head = raw.where(c("row_no") == start).select(*cols).first()
    named = [(i, x) for i, x in enumerate(cols) if head[x] not in (None, "")]
    body = raw.where(c("row_no") > start).select(*[c(x).alias(f"p{i}") for i, x in enumerate(cols)])
    return body.na.drop(how="all").select(*[f"p{i}" for i, _ in named])
