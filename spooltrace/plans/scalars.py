"""The scalar rules (F1-F34) applied to the whole columns they serve, one query per rule.

Each query reads a table derived from the supplied data and returns the
input columns next to the rule's output, so every rule is checked against an
independent SQL form on the full column, not only on hand-made rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.functions import exprs as X
from spooltrace.functions import rules as R

c = F.col
AS_OF = "2000-06-30 00:00:00"


def _as_of_col():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _stg(db) -> DataFrame:
    return db._stg_excel_with_id()


def parse_bigint(db):
    fe = db.stg_filament_excel_data
    return fe.select(c("filament_id").alias("input"), X.parse_bigint(c("filament_id")).alias("output"))


def parse_bigint_strict(db):
    s = _stg(db)
    return s.select(c("_event_id").alias("event_id"), c("product_id").alias("input"),
                    X.parse_bigint_strict(c("product_id")).alias("output"))


def parse_decimal_comma(db):
    s = _stg(db)
    return s.select(c("_event_id").alias("event_id"), c("weight_check_g").alias("input"),
                    X.parse_decimal_comma(c("weight_check_g"), 6, 2).alias("output"))


def parse_date_multi(db):
    s = _stg(db)
    return s.select(c("_event_id").alias("event_id"), c("date_of_quality_check").alias("input"),
                    X.parse_date_multi(c("date_of_quality_check")).alias("output"))


def parse_date_de(db):
    fe = db.stg_filament_excel_data
    return fe.select(c("filament_id").alias("key"), c("vsc_date").alias("input"), X.parse_date_de(c("vsc_date")).alias("output"))


def clean_key(db):
    s = _stg(db)
    return s.select(c("_event_id").alias("event_id"), c("transfer_id").alias("input"),
                    X.clean_key(c("transfer_id")).alias("output"))


def blank_to_null(db):
    fe = db.stg_filament_excel_data
    return fe.select(c("filament_id").alias("key"), c("shelf").alias("input"), X.blank_to_null(c("shelf")).alias("output"))


def lot_prefix(db):
    fe = db.stg_filament_excel_data
    return fe.select(c("filament_id").alias("key"), c("filament").alias("input"), X.lot_prefix(c("filament")).alias("output"))


def pass_fail(db):
    fe = db.stg_filament_excel_data
    return fe.select(c("filament_id").alias("key"), c("vs_check").alias("input"), X.pass_fail(c("vs_check")).alias("output"))


def qc_result_matrix(db):
    s = _stg(db)
    st = F.upper(F.trim(c("status_quality_check")))
    sr = F.upper(F.trim(F.coalesce(c("second_rate_goods"), F.lit(""))))
    return s.select(c("_event_id").alias("event_id"), st.alias("status_qc"), sr.alias("second_rate"),
                    X.qc_result_matrix(st, sr).alias("output"))


def post_treat_flags(db):
    s = _stg(db)
    f = X.post_treat_flags(F.upper(F.trim(c("visual_check_1"))), F.upper(F.trim(c("surface_treatment"))),
                           F.upper(F.trim(c("sterilization"))))
    return s.select(c("_event_id").alias("event_id"), *[v.alias(k) for k, v in f.items()])


def legacy_status_stage(db):
    """staging QC text -> status id (via the status dim), process step -> stage id (else 1)."""
    from spooltrace.plans.views import LEGACY_STEP_STAGE
    s = _stg(db)
    qc = F.upper(F.trim(c("status_quality_check")))
    sr = F.upper(F.trim(F.coalesce(c("second_rate_goods"), F.lit(""))))
    step = F.upper(F.trim(F.coalesce(c("prozess_step"), F.lit(""))))
    stage = None
    for code, sid in LEGACY_STEP_STAGE:
        stage = F.when(step == code, F.lit(sid)) if stage is None else stage.when(step == code, F.lit(sid))
    ids = db.product_statuses.groupBy(c("status_name").alias("_n")).agg(F.min("id").alias("current_status_id"))
    out = s.select(c("_event_id").alias("event_id"), X.legacy_status_name(qc, sr).alias("_want"),
                   stage.otherwise(1).cast("long").alias("current_stage_id"))
    return out.join(F.broadcast(ids), c("_want") == c("_n"), "left").select("event_id", "current_status_id",
                                                                              "current_stage_id")


def treatment_status(db):
    t = db.stg_treatment_excel_data
    return t.select(c("treatment_id").alias("key"), c("in_treatment").alias("input"),
                    X.treatment_status(X.clean_key(c("in_treatment"))).alias("output"))


def treatment_notes(db):
    t = db.stg_treatment_excel_data
    return t.select(c("treatment_id").alias("key"),
                    X.treatment_notes(X.clean_key(c("treatment_id")), F.trim(c("operator"))).alias("output"))


def base36(db):
    o = db.src("orders")
    return o.select(c("o_orderkey").alias("input"), X.base36(c("o_orderkey")).alias("output"))


def lot_number(db):
    o = db.src("orders")
    return o.select(c("o_orderkey").alias("key"), X.lot_number(c("o_orderdate"), c("o_orderkey")).alias("output"))


def product_code(db):
    r = db.product_requests
    return r.select(c("id").alias("key"), X.product_code(c("lot_number"), c("id")).alias("output"))


def name_initials(db):
    cu = db.src("customer")
    name = F.concat(c("c_mktsegment"), F.lit(" "), c("c_name"))
    return cu.select(c("c_custkey").alias("key"), name.alias("input"), X.name_initials(name).alias("output"))


def ready_at(db):
    a = db.filament_acclimatization
    return a.select("id", "moved_at", X.ready_at(c("moved_at")).alias("output"))


def harvest_qc_rule(db):
    q = (db.product_quality_control.alias("q")
         .join(db.product_tracking.alias("t"), c("q.product_tracking_id") == c("t.id"))
         .join(db.product_print_specs.alias("s"), c("s.sku_id") == c("t.sku_id"), "left"))
    return q.select(c("q.id").alias("id"), X.harvest_qc_rule(c("q.weight_grams"), c("q.pressure_drop"),
                                                             c("s.average_weight_g"), c("s.weight_buffer_g")).alias("output"))


def treatment_qc_rule(db):
    from spooltrace.plans.operations import treatment_inputs, treatment_qc_evaluation
    return treatment_qc_evaluation(db, treatment_inputs(db)).select("id", "batch_id", c("suggested_result").alias("output"))


def business_status(db):
    q = db.product_quality_control
    return q.select("id", c("inspection_result").alias("input"),
                    X.business_status(c("inspection_result"), "Pending").alias("output"))


def next_stage_modes(db):
    """business status of the QC result and storage mode -> next stage code, for every mode that knows the status."""
    rows = [(s, m, code) for s, modes in R.NEXT_STAGE_BY_RESULT.items() for m, code in modes.items()]
    rules = db.spark.createDataFrame(rows, "business_status STRING, mode STRING, next_stage_code STRING")
    q = db.product_quality_control.select("id", X.business_status(c("inspection_result"), "A-Ware").alias("business_status"))
    return q.join(F.broadcast(rules), "business_status").select("id", "business_status", "mode", "next_stage_code")


def next_stage(db):
    """(business status of the QC result, Post-Harvest QC) -> next stage code via the literal rule table."""
    rows = [(s, m, code) for s, modes in R.NEXT_STAGE_BY_RESULT.items() for m, code in modes.items()]
    rules = db.spark.createDataFrame(rows, "business_status STRING, mode STRING, next_stage_code STRING").where(
        c("mode") == "Post-Harvest QC")
    q = db.product_quality_control.select("id", X.business_status(c("inspection_result"), "A-Ware").alias("business_status"))
    return q.join(F.broadcast(rules), "business_status", "left").select("id", "business_status", "next_stage_code")


def qm_target_stage(db):
    t = (db.product_tracking.alias("t")
         .join(db.lifecycle_stages.alias("s"), c("t.current_stage_id") == c("s.id"), "left"))
    res = F.element_at(F.array(F.lit("Passed"), F.lit("B-Ware"), F.lit("Waste")), (c("t.id") % 3 + 1).cast("int"))
    return t.select(c("t.id").alias("id"), res.alias("resolution"), c("s.stage_name").alias("stage_name"),
                    X.qm_target_stage(res, c("s.stage_name")).alias("output"))


def resolution_status(db):
    i = db.product_investigations
    res = F.element_at(F.array(F.lit("Passed"), F.lit("B-Ware"), F.lit("Waste")), (c("id") % 3 + 1).cast("int"))
    st = X.resolution_status(res)
    return i.select("id", res.alias("resolution"), st["investigation_status"].alias("investigation_status"),
                    st["quarantine_status"].alias("quarantine_status"))


def append_note(db):
    q = db.quarantined_products
    res = F.element_at(F.array(F.lit("Passed"), F.lit("B-Ware"), F.lit("Waste")), (c("id") % 3 + 1).cast("int"))
    comment = F.when(c("id") % 2 == 0, F.lit("checked"))
    old = F.when(c("id") % 5 == 0, F.lit("initial hold")).otherwise(c("quarantine_reason"))
    note = X.resolution_note(_as_of_col(), res, comment)
    return q.select("id", old.alias("old_note"), X.append_note(old, note).alias("output"))


def weight_health(db):
    m = db.filament_mounting
    return m.select("id", "remaining_weight", X.weight_health(c("remaining_weight")).alias("output"))


def label_expiry(db):
    h = db.product_harvest
    e = X.label_expiry(c("print_date"))
    return h.select("id", "print_date", e["expiry_date"].alias("expiry_date"), e["expiry_label"].alias("expiry_label"))


def required_weight(db):
    r = db.product_requests.alias("r").join(db.product_print_specs.alias("s"), c("s.sku_id") == c("r.sku_id"), "left")
    return r.select(c("r.id").alias("id"), X.required_weight(c("s.average_weight_g"), c("s.weight_buffer_g")).alias("output"))


def expanded_qty(db):
    i = db.order_items.alias("i").join(db.product_skus.alias("s"), c("i.product_sku_id") == c("s.id"))
    return i.select(c("i.order_id").alias("order_id"), c("i.product_sku_id").alias("product_sku_id"),
                    X.expanded_qty(c("i.quantity"), c("s.is_bundle"), c("s.pack_qty"), c("i.order_id") % 2 == 0)
                    .alias("output"))


def has_level(db):
    g = db.group_area_rights
    return g.select("id", "access_level", X.has_level(c("access_level"), F.lit("Write")).alias("output"))


def reason_matches_outcome(db):
    """F32: per QC outcome present in the data, the reasons whose default outcome is neutral or equal."""
    outcomes = db.product_quality_control.select(c("inspection_result").alias("outcome")).distinct()
    # the outcomes are an enumeration: one row holds them all
    every = outcomes.agg(F.collect_set("outcome").alias("outcomes"))
    matching = F.filter("outcomes", lambda x: X.reason_matches_outcome(c("default_outcome"), x))
    return (db.issue_reasons.crossJoin(F.broadcast(every))
            .select(c("id").alias("reason_id"), F.explode(matching).alias("outcome")).select("outcome", "reason_id"))


def parse_ts_generic(db):
    s = _stg(db)
    return s.select(c("_event_id").alias("event_id"), c("date_harvest").alias("input"),
                    X.parse_ts_generic(c("date_harvest")).alias("output"))


def clip_text(db):
    fe = db.stg_filament_excel_data
    return fe.select(c("filament_id").alias("key"), X.clip_text(c("filament"), 100).alias("output"))


NAMES = ["parse_bigint", "parse_bigint_strict", "parse_decimal_comma", "parse_date_multi", "parse_date_de",
         "clean_key", "blank_to_null", "lot_prefix", "pass_fail", "qc_result_matrix", "post_treat_flags",
         "legacy_status_stage", "treatment_status", "treatment_notes", "base36", "lot_number", "product_code",
         "name_initials", "ready_at", "harvest_qc_rule", "treatment_qc_rule", "business_status", "next_stage", "next_stage_modes",
         "qm_target_stage", "resolution_status", "append_note", "weight_health", "label_expiry", "required_weight",
         "expanded_qty", "has_level", "reason_matches_outcome", "parse_ts_generic", "clip_text"]
