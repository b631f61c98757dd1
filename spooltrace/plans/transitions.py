"""State transitions re-aimed as bulk transforms (2.K).

A transition takes the current tables plus a *command table* (one row per
requested change) and returns new versions of the touched tables and the
appended history rows, all computed from one input snapshot. ``as_of``
replaces the clock. A command table with a column ``seq`` may hold several
commands for one unit: they apply in that order, each from what the one before
left, with a history row per step. Without it a unit may appear once (checked).

The outputs are made when they are read (``Outputs``): reading one table numbers
and writes nothing for the others. Checks of the commands run at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spooltrace.functions import exprs as X
from spooltrace.operators import merge as C
from spooltrace.operators.outputs import Outputs, once
from spooltrace.operators.ranking import row_number_within
from spooltrace.session import materialize

c = F.col

HISTORY_COLUMNS = ["id", "product_tracking_id", "from_stage_id", "to_stage_id", "reason", "changed_by", "changed_at"]


def check_commands(commands: DataFrame, key: str) -> bool:
    """Whether the commands are ordered (``seq``); their (key, seq), else their key, must be unique."""
    ordered = "seq" in commands.columns
    C.check_unique(commands, [key, "seq"] if ordered else [key])
    return ordered


def ordered_steps(commands: DataFrame, key: str, value: str) -> DataFrame:
    """The commands with ``step`` (1, 2, ... within ``key`` by ``seq``) and ``_before``, the previous step's ``value``.

    Numbering is range-partitioned and the previous step is met by an equi-join on (key, step), so that a key
    holding a large part of all commands is spread over many tasks.
    """
    steps = row_number_within(commands, [key], ["seq"], col="step")
    before = steps.select(c(key).alias("_bk"), (c("step") + 1).alias("_bs"), c(value).alias("_before"))
    return steps.join(before, (c(key) == c("_bk")) & (c("step") == c("_bs")), "left").drop("_bk", "_bs")


def last_command(commands: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of each key's last command by ``seq``: an aggregate, so a hot key collapses map-side."""
    return commands.groupBy(key).agg(F.max_by(F.struct(value), c("seq")).alias("_v")).select(key, c(f"_v.{value}").alias(value))


def apply_stage_change(tracking: DataFrame, commands: DataFrame, as_of: str, history_start: int = 1) -> Outputs:
    """K1: commands (product_tracking_id, new_stage_id, reason, user_id, location_id?, seq?) ->
    tracking with previous := the stage before the last step, current := the last step's stage, the last given
    location, ``last_updated_at`` := as_of; plus one history row (from, to, reason, by, at) per step."""
    if "location_id" not in commands.columns:
        commands = commands.withColumn("location_id", F.lit(None).cast("long"))
    now = F.lit(as_of).cast("timestamp_ntz")
    key = "product_tracking_id"
    if check_commands(commands, key):
        steps = once(lambda: ordered_steps(commands, key, "new_stage_id"))
    else:
        steps = once(lambda: commands.withColumn("step", F.lit(1)).withColumn("_before", F.lit(None).cast("long")))

    def new_tracking() -> DataFrame:
        last = steps().groupBy(c(key).alias("_cid")).agg(
            F.max_by(F.struct(c("new_stage_id").alias("new"), c("_before").alias("before"), "step"), c("step")).alias("_last"),
            F.max_by(c("location_id"), F.when(c("location_id").isNotNull(), c("step"))).alias("_loc"))
        hit = c("_cid").isNotNull()
        before = F.when(c("_last.step") > 1, c("_last.before")).otherwise(c("current_stage_id"))
        new = {"previous_stage_id": F.when(hit, before).otherwise(c("previous_stage_id")),
               "current_stage_id": F.when(hit, c("_last.new")).otherwise(c("current_stage_id")),
               "location_id": F.coalesce(c("_loc"), c("location_id")),
               "last_updated_at": F.when(hit, now).otherwise(c("last_updated_at"))}
        return tracking.join(last, tracking.id == c("_cid"), "left").select(
            *[new.get(x, c(x)).alias(x) for x in tracking.columns])

    def history() -> DataFrame:
        start = tracking.select(c("id").alias("_tid"), c("current_stage_id").alias("_start"))
        rows = (steps().join(start, c(key) == c("_tid"))
                .select(key, F.when(c("step") > 1, c("_before")).otherwise(c("_start")).alias("from_stage_id"),
                        c("new_stage_id").alias("to_stage_id"), "reason", c("user_id").alias("changed_by"),
                        now.alias("changed_at"), "step"))
        return C.assign_ids(rows, [key, "step"], history_start, "id").select(*HISTORY_COLUMNS)

    return Outputs(product_tracking=new_tracking, product_status_history=history)


class UnknownStatus(ValueError):
    pass


def apply_status_change(tracking: DataFrame, statuses: DataFrame, commands: DataFrame, as_of: str) -> DataFrame:
    """K2: commands (product_tracking_id, status_name, seq?) -> tracking with the named status, the last one by
    ``seq``; an unknown status name is an error (checked before anything is written)."""
    ordered = check_commands(commands, "product_tracking_id")
    ids = statuses.groupBy("status_name").agg(F.min("id").alias("_sid"))
    bad = commands.join(ids, "status_name", "left_anti").limit(1).collect()
    if bad:
        raise UnknownStatus(f"Status '{bad[0]['status_name']}' not found in product_statuses table.")
    final = last_command(commands, "product_tracking_id", "status_name") if ordered else commands
    cmd = final.join(F.broadcast(ids), "status_name").select(c("product_tracking_id").alias("_cid"), "_sid")
    j = tracking.join(cmd, tracking.id == cmd._cid, "left")
    hit = c("_cid").isNotNull()
    return j.select(*[
        F.when(hit, c("_sid")).otherwise(c(x)).alias(x) if x == "current_status_id" else
        F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(c(x)).alias(x) if x == "last_updated_at" else c(x)
        for x in tracking.columns])


def apply_expiry(db, as_of: str, user_id: int = 1) -> Outputs:
    """Every unit printed more than a year before ``as_of`` and not yet Expired moves to Expired
    with a history row 'Auto-expired after 1 year'."""
    t = F.lit(as_of).cast("timestamp_ntz")
    expired_id = db.lifecycle_stages.where(c("stage_code") == "Expired").agg(F.min("id").alias("new_stage_id"))
    elig = (db.product_tracking.alias("pt")
            .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
            .join(db.lifecycle_stages.alias("ls"), c("pt.current_stage_id") == c("ls.id"))
            .where((c("ls.stage_code") != "Expired") & (c("ph.print_date") < F.timestamp_add("YEAR", F.lit(-1), t)))
            .select(c("pt.id").alias("product_tracking_id"))
            .withColumn("_k", F.lit(1))
            .join(F.broadcast(expired_id.withColumn("_k", F.lit(1))), "_k").drop("_k")
            .withColumn("reason", F.lit("Auto-expired after 1 year"))
            .withColumn("user_id", F.lit(user_id).cast("long")))
    return apply_stage_change(db.product_tracking, elig, as_of)


def stage_commands(db) -> DataFrame:
    """Command table for K1: every unit moves one to three times, to stages and locations chosen from its id."""
    seq = F.explode(F.sequence(F.lit(1), (F.lit(1) + c("id") % 3).cast("int"))).alias("seq")
    u = db.product_tracking.select("id", seq)
    return u.select(
        c("id").alias("product_tracking_id"), "seq", (F.lit(1) + (c("id") + 5 * c("seq")) % 14).alias("new_stage_id"),
        F.concat(F.lit("bulk move "), c("seq").cast("string")).alias("reason"),
        (F.lit(1) + (c("id") + c("seq")) % 10).alias("user_id"),
        F.when((c("id") + c("seq")) % 2 == 0, F.lit(1) + (c("id") + c("seq")) % 25).alias("location_id"))


STATUS_CHOICES = ["Pending", "A-Ware", "B-Ware", "In Quarantine", "Waste"]


def status_commands(db) -> DataFrame:
    """Command table for K2: every unit gets one or two statuses chosen from its id; the last one stays."""
    names = F.array(*[F.lit(s) for s in STATUS_CHOICES])
    u = db.product_tracking.select("id", F.explode(F.sequence(F.lit(1), (F.lit(1) + c("id") % 2).cast("int"))).alias("seq"))
    return u.select(c("id").alias("product_tracking_id"), "seq",
                    F.element_at(names, ((c("id") + c("seq")) % 5 + 1).cast("int")).alias("status_name"))


# ---------------------------------------------------------------------------
# K3 audited field changes
# ---------------------------------------------------------------------------

# Tables whose fields may be edited through the audited path.
ALLOWED_AUDIT_TABLES = [
    "filaments", "filament_mounting", "filament_acclimatization", "lids", "seals", "product_requests",
    "product_harvest", "product_quality_control", "product_tracking", "product_print_specs", "product_skus",
    "treatment_batches", "treatment_batch_products", "post_treatment_inspections", "users", "orders", "order_items",
    "order_supplements", "supplements",
]
SAFE_FIELD = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
AUDIT_COLUMNS = ["id", "table_name", "record_id", "field_name", "old_value", "new_value", "reason", "changed_by",
                 "changed_at"]


class AuditError(ValueError):
    pass


def _py_str(col):
    """Text form of a value as the audit log stores it (a missing value reads 'None')."""
    return F.coalesce(col.cast("string"), F.lit("None"))


def _current_text(target: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes with ``_now``, the text of the field on the target row before any change."""
    fields = [x for x in target.columns if x != "id"]
    texts = target.select(c("id").alias("_tid"), F.create_map(*[
        e for f in fields for e in (F.lit(f), c(f).cast("string"))]).alias("_texts"))
    return (changes.join(texts, c("record_id") == c("_tid"), "left")
            .withColumn("_now", F.try_element_at(c("_texts"), c("field_name"))).drop("_tid", "_texts"))


def _folded(target: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes with ``old_value``: what the previous change of the (record, field) by ``seq`` left, else the field's text."""
    keyed = _current_text(target, changes).withColumn("_field", F.struct("record_id", "field_name"))
    steps = ordered_steps(keyed, "_field", "new_value")
    return steps.withColumn("old_value", F.when(c("step") > 1, c("_before")).otherwise(c("_now"))).drop(
        "_field", "_now", "_before", "step")


def apply_field_changes(target: DataFrame, table_name: str, changes: DataFrame, as_of: str,
                        audit_start: int | Callable[[], int] = 1, update: bool = True) -> Outputs:
    """K3: change rows (record_id, field_name[, old_value], new_value, reason, changed_by[, seq]) for one table.

    A change is skipped when old equals new (numeric fields compared rounded
    to 5 decimals, others as text). The table must be whitelisted and field
    names must be plain identifiers (both checked before anything is
    written). Remaining changes append audit rows and, with ``update``, set
    the field on the target row (the last change per (record, field) by
    ``seq`` wins). Without ``old_value`` each change starts from what the one
    before it left, the first from the target row.
    """
    if table_name not in ALLOWED_AUDIT_TABLES:
        raise AuditError("Unauthorized table")
    if changes.where(~c("field_name").rlike(SAFE_FIELD)).limit(1).collect():
        raise AuditError("Unsafe field name")
    if "seq" not in changes.columns:
        changes = changes.withColumn("seq", F.lit(0))
    numeric = {f.name for f in target.schema.fields
               if f.dataType.typeName() in ("decimal", "double", "float")}
    is_num = c("field_name").isin(*numeric) if numeric else F.lit(False)
    o_num, n_num = c("old_value").try_cast("double"), c("new_value").try_cast("double")
    num_equal = (o_num.isNotNull() | c("old_value").isNull()) & (n_num.isNotNull() | c("new_value").isNull()) & \
        F.round(o_num, 5).eqNullSafe(F.round(n_num, 5))
    same = F.when(is_num, num_equal).otherwise(_py_str(c("old_value")) == _py_str(c("new_value")))
    effective = once(lambda: (changes if "old_value" in changes.columns else _folded(target, changes)).where(~same))

    def audit() -> DataFrame:
        rows = effective().select(
            F.lit(table_name).alias("table_name"), "record_id", "field_name", _py_str(c("old_value")).alias("old_value"),
            _py_str(c("new_value")).alias("new_value"), "reason", "changed_by",
            F.lit(as_of).cast("timestamp_ntz").alias("changed_at"), "seq")
        start = audit_start() if callable(audit_start) else audit_start
        return C.assign_ids(rows, ["record_id", "field_name", "seq"], start, "id").select(*AUDIT_COLUMNS)

    def updated() -> DataFrame:
        if not update:
            return target
        fields = [x for x in target.columns if x != "id"]
        piv = (effective().where(c("field_name").isin(*fields))
               .groupBy(c("record_id").alias("_rid"))
               .pivot("field_name", fields)
               .agg(F.max_by(F.struct(F.lit(True).alias("set"), c("new_value").alias("v")), c("seq"))))
        piv = piv.select("_rid", *[c(f"`{f}`").alias(f"_n_{f}") for f in fields])
        j = target.join(piv, target.id == piv._rid, "left")
        return j.select(*[c(x) if x == "id" else
                          F.when(c(f"_n_{x}.set"), c(f"_n_{x}.v").cast(target.schema[x].dataType)).otherwise(c(x)).alias(x)
                          for x in target.columns])

    return Outputs(**{table_name: updated, "audit_log": audit})


def _next_audit(db) -> Callable[[], int]:
    """The audit log's next id, looked up when an audit is numbered."""
    return lambda: C.next_id(db.audit_log)


def filament_change_commands(db) -> DataFrame:
    """Command table for K3: every spool changes its QC result and place once and its weight three times, of
    which one change sets what is there already."""
    w = c("weight_grams")

    def edit(seq: int, field: str, value) -> Column:
        return F.struct(F.lit(seq).alias("seq"), F.lit(field).alias("field_name"), value.cast("string").alias("new_value"))
    heavier = (w + F.lit(5.5)).cast("decimal(10,2)")
    edits = F.array(edit(1, "weight_grams", heavier), edit(2, "weight_grams", heavier),
                    edit(3, "weight_grams", (heavier - c("id") % 4).cast("decimal(10,2)")),
                    edit(4, "qc_result", F.when(c("qc_result") == "PASS", "FAIL").otherwise("PASS")),
                    edit(5, "location_id", F.lit(1) + (c("id") + 3) % 25))
    return db.filaments.select(
        c("id").alias("record_id"), F.explode(edits).alias("e"), F.lit("inventory correction").alias("reason"),
        (F.lit(1) + c("id") % 10).alias("changed_by")).select("record_id", "e.*", "reason", "changed_by")


# ---------------------------------------------------------------------------
# K4 requests
# ---------------------------------------------------------------------------

REQUEST_COLUMNS = ["id", "requested_by", "sku_id", "lot_number", "status", "requested_at", "notes", "is_tech_transfer"]


def apply_requests(requests: DataFrame, commands: DataFrame, as_of: str, batch_start: int) -> DataFrame:
    """K4: command rows (command_id, requested_by, sku_id, quantity, notes, is_tech_transfer) -> ``quantity``
    Pending request rows per command sharing one lot: YY of ``as_of`` + base-36 batch number, the batch
    numbers continuing from ``batch_start`` in command order."""
    cmd = C.assign_ids(commands, ["command_id"], batch_start, "batch_number")
    cmd = cmd.withColumn("lot_number", X.lot_number(F.lit(as_of).cast("timestamp_ntz"), c("batch_number")))
    rows = cmd.select("command_id", "requested_by", "sku_id", "lot_number", "notes", "is_tech_transfer",
                      F.explode(F.sequence(F.lit(1), c("quantity"))).alias("_n"))
    rows = C.assign_ids(rows, ["command_id", "_n"], C.next_id(requests), "id")
    return rows.select("id", "requested_by", "sku_id", "lot_number", F.lit("Pending").alias("status"),
                       F.lit(as_of).cast("timestamp_ntz").alias("requested_at"), "notes", "is_tech_transfer")


def request_commands(db) -> DataFrame:
    """Command table for K4: every order asks for 1-4 units of a sku chosen from its customer."""
    return db.src("orders").selectExpr(
        "CAST(o_orderkey AS BIGINT) AS command_id", "CAST(1 + o_custkey % 10 AS BIGINT) AS requested_by",
        "CAST(1 + o_custkey % 7 AS BIGINT) AS sku_id", "CAST(1 + o_orderkey % 4 AS INT) AS quantity",
        "CAST(NULL AS STRING) AS notes", "o_orderkey % 19 = 0 AS is_tech_transfer")


# ---------------------------------------------------------------------------
# K10-K13 quarantine, resolution, QM decisions, investigations
# ---------------------------------------------------------------------------

def _stage_id(db, code: str) -> DataFrame:
    return db.lifecycle_stages.where(c("stage_code") == code).agg(F.min("id").alias("_stage")).withColumn("_k", F.lit(1))


def apply_qm_decision(db, decisions: DataFrame, as_of: str, user_id: int = 1,
                      comment: str = "") -> Outputs:
    """Decisions (pid, result, decision in treatment|sales|decline, reason) ->
    approve for treatment (QMTreatmentApproval), for sales (Passed -> QMSalesApproval, else Internal Use),
    or decline (Disposed + status Waste); one history row per unit."""
    ids = db.lifecycle_stages.groupBy().pivot("stage_code", ["QMTreatmentApproval", "QMSalesApproval",
                                                              "Internal Use", "Disposed"]).agg(F.min("id"))
    ids = ids.withColumn("_k", F.lit(1))
    r = F.trim(F.coalesce(c("reason"), F.lit("")))
    suffix = F.when(r != "", F.concat(F.lit(": "), r)).otherwise(F.lit(""))
    d = decisions.withColumn("_k", F.lit(1)).join(F.broadcast(ids), "_k")
    cmd = d.select(
        c("pid").alias("product_tracking_id"),
        F.when(c("decision") == "treatment", c("QMTreatmentApproval"))
         .when(c("decision") == "sales", F.when(c("result") == "Passed", c("QMSalesApproval")).otherwise(c("Internal Use")))
         .otherwise(c("Disposed")).alias("new_stage_id"),
        F.when(c("decision") == "treatment", F.concat(F.lit("QM Approved for Treatment"), suffix))
         .when(c("decision") == "sales", F.when(c("result") == "Passed", F.concat(F.lit("QM Approved for Sales"), suffix))
               .otherwise(F.concat(F.lit("QM Approved for Internal Use"), suffix)))
         .otherwise(F.lit(f"Declined by QM: {comment}")).alias("reason"),
        F.lit(user_id).cast("long").alias("user_id"))
    moved = apply_stage_change(db.product_tracking, cmd, as_of)
    declined = decisions.where(c("decision") == "decline").select(
        c("pid").alias("product_tracking_id"), F.lit("Waste").alias("status_name"))
    return moved | Outputs(product_tracking=lambda: apply_status_change(
        moved["product_tracking"], db.product_statuses, declined, as_of))


def qm_decisions(db) -> DataFrame:
    """Command table for K12: every bulk-eligible unit is approved; every 13th is declined instead."""
    from spooltrace.plans.operations import qm_bulk_eligible
    e = qm_bulk_eligible(db)
    return e.select("pid", "result",
                    F.when(c("pid") % 13 == 0, "decline")
                     .when(c("approval_type") == "Post-Harvest Approval", "treatment").otherwise("sales").alias("decision"),
                    F.when(c("pid") % 2 == 0, F.lit("batch review")).otherwise(F.lit("")).alias("reason"))


INVESTIGATION_COLUMNS = ["id", "product_tracking_id", "status", "deviation_number", "comment", "created_by",
                         "created_at", "resolved_at", "resolved_by"]


def apply_investigation(investigations: DataFrame, commands: DataFrame, as_of: str) -> DataFrame:
    """Command rows (product_tracking_id, status, deviation_number, comment, created_by) -> new
    investigation rows (created now)."""
    rows = commands.select("product_tracking_id", "status", "deviation_number", "comment", "created_by",
                           F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
                           F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
                           F.lit(None).cast("long").alias("resolved_by"))
    rows = C.assign_ids(rows, ["product_tracking_id", "deviation_number"], C.next_id(investigations), "id")
    return rows.select(*INVESTIGATION_COLUMNS)


def investigation_commands(db) -> DataFrame:
    """Command table for K13: every active quarantine is escalated."""
    q = db.quarantined_products.where(c("quarantine_status") == "Active")
    return q.select("product_tracking_id", F.lit("Under Investigation").alias("status"),
                    F.concat(F.lit("DEV-Q"), c("id").cast("string")).alias("deviation_number"),
                    F.lit("escalated from quarantine").alias("comment"), c("quarantined_by").alias("created_by"))


QUARANTINE_COLUMNS = ["id", "product_tracking_id", "from_stage_id", "source", "location_id", "quarantine_date",
                      "quarantined_by", "quarantine_reason", "quarantine_status", "result", "resolved_at",
                      "resolved_by"]


def apply_quarantine(db, commands: DataFrame, as_of: str, adhoc: bool = True) -> Outputs:
    """Command rows (product_tracking_id, source, quarantined_by, reason, reason_ids) -> Active
    quarantine rows (from the unit's current stage) and distinct reason links; ad-hoc mode also moves
    the unit to stage Quarantine ('Ad-Hoc Quarantine: <reason>') with status 'In Quarantine'."""
    C.check_unique(commands, ["product_tracking_id"])
    t = db.product_tracking.select(c("id").alias("_tid"), c("current_stage_id").alias("from_stage_id"))
    rows = (commands.join(t, c("product_tracking_id") == c("_tid"))
            .select("product_tracking_id", "from_stage_id", "source", F.lit(None).cast("long").alias("location_id"),
                    F.lit(as_of).cast("timestamp_ntz").alias("quarantine_date"), "quarantined_by",
                    F.nullif(c("reason"), F.lit("")).alias("quarantine_reason"),
                    F.lit("Active").alias("quarantine_status"), F.lit(None).cast("string").alias("result"),
                    F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
                    F.lit(None).cast("long").alias("resolved_by"), "reason_ids"))
    numbered = once(lambda: C.assign_ids(rows, ["product_tracking_id"], C.next_id(db.quarantined_products), "id"))
    out = Outputs(
        quarantined_products=lambda: db.quarantined_products.unionByName(numbered().select(*QUARANTINE_COLUMNS)),
        new_quarantines=lambda: numbered().select(*QUARANTINE_COLUMNS),
        quarantined_product_reasons=lambda: _reason_links(numbered(), "quarantine_id"))
    if adhoc:
        stage = _stage_id(db, "Quarantine")
        cmd = (commands.withColumn("_k", F.lit(1)).join(F.broadcast(stage), "_k")
               .select("product_tracking_id", c("_stage").alias("new_stage_id"),
                       F.concat(F.lit("Ad-Hoc Quarantine: "), F.coalesce(c("reason"), F.lit(""))).alias("reason"),
                       c("quarantined_by").alias("user_id")))
        moved = apply_stage_change(db.product_tracking, cmd, as_of)
        status = commands.select("product_tracking_id", F.lit("In Quarantine").alias("status_name"))
        out = out | moved | Outputs(product_tracking=lambda: apply_status_change(
            moved["product_tracking"], db.product_statuses, status, as_of))
    return out


def _reason_links(rows: DataFrame, owner: str) -> DataFrame:
    """(id, owner, reason_id): one link for every distinct reason of a row."""
    links = rows.select(c("id").alias(owner), F.explode(F.array_distinct(c("reason_ids"))).alias("reason_id"))
    return C.assign_ids(links, [owner, "reason_id"], 1, "id").select("id", owner, "reason_id")


def quarantine_commands(db) -> DataFrame:
    """Command table for K10: every unit not already in an active quarantine, two reasons (one repeated)."""
    active = db.quarantined_products.where(c("quarantine_status") == "Active").select(c("product_tracking_id").alias("_a"))
    u = db.product_tracking.join(active, c("id") == c("_a"), "left_anti")
    return u.select(c("id").alias("product_tracking_id"), F.lit("Ad-Hoc").alias("source"),
                    (F.lit(1) + c("id") % 10).alias("quarantined_by"),
                    F.concat(F.lit("suspect lot "), (c("id") % 97).cast("string")).alias("reason"),
                    F.array((F.lit(1) + c("id") % 19), (F.lit(1) + c("id") % 19), (F.lit(1) + c("id") % 5)).cast(
                        "array<bigint>").alias("reason_ids"))


def apply_quarantine_resolution(db, commands: DataFrame, as_of: str) -> Outputs:
    """Command rows (product_tracking_id, resolution, comment, resolved_by) ->
    investigations 'Under Investigation' and Active quarantines of the unit are resolved
    (status from the resolution, note appended), the unit's status follows the resolution
    (unknown -> Pending) and its stage moves per the QM rule (current stage name, resolution)."""
    C.check_unique(commands, ["product_tracking_id"])
    now = F.lit(as_of).cast("timestamp_ntz")
    st = X.resolution_status(c("resolution"))
    note = X.resolution_note(now, c("resolution"), c("comment"))
    cmd = commands.select(c("product_tracking_id").alias("_pid"), "resolution", "comment", "resolved_by",
                          st["investigation_status"].alias("_inv_status"),
                          st["quarantine_status"].alias("_q_status"), note.alias("_note"))
    inv = db.product_investigations
    ji = inv.join(cmd, (inv.product_tracking_id == cmd._pid) & (inv.status == "Under Investigation"), "left")
    hit = c("_pid").isNotNull()
    cols = []
    for x in inv.columns:
        if x == "status":
            cols.append(F.when(hit, c("_inv_status")).otherwise(inv[x]).alias(x))
        elif x == "resolved_at":
            cols.append(F.when(hit, now).otherwise(inv[x]).alias(x))
        elif x == "resolved_by":
            cols.append(F.when(hit, cmd["resolved_by"]).otherwise(inv[x]).alias(x))
        elif x == "comment":
            cols.append(F.when(hit, X.append_note(inv["comment"], c("_note"))).otherwise(inv["comment"]).alias(x))
        else:
            cols.append(inv[x])
    new_inv = ji.select(*cols)
    q = db.quarantined_products
    jq = q.join(cmd, (q.product_tracking_id == cmd._pid) & (q.quarantine_status == "Active"), "left")
    hq = c("_pid").isNotNull()
    qcols = []
    for x in q.columns:
        if x == "quarantine_status":
            qcols.append(F.when(hq, c("_q_status")).otherwise(q[x]).alias(x))
        elif x == "result":
            qcols.append(F.when(hq, c("resolution")).otherwise(q[x]).alias(x))
        elif x == "resolved_at":
            qcols.append(F.when(hq, now).otherwise(q[x]).alias(x))
        elif x == "resolved_by":
            qcols.append(F.when(hq, cmd["resolved_by"]).otherwise(q[x]).alias(x))
        else:
            qcols.append(q[x])
    new_q = jq.select(*qcols)
    status = commands.select("product_tracking_id",
                             X.business_status(c("resolution"), "Pending").alias("status_name"))
    stages = db.lifecycle_stages
    cur = (db.product_tracking.select(c("id").alias("_tid"), c("current_stage_id").alias("_cur"))
           .join(F.broadcast(stages.select(c("id").alias("_sid"), c("stage_name").alias("_sname"))),
                 c("_cur") == c("_sid"), "left"))
    by_name = stages.groupBy(c("stage_name").alias("_tname")).agg(F.min("id").alias("new_stage_id"))
    moves = (commands.join(cur, c("product_tracking_id") == c("_tid"))
             .withColumn("_target", X.qm_target_stage(c("resolution"), c("_sname")))
             .join(F.broadcast(by_name), c("_target") == c("_tname"))
             .select("product_tracking_id", "new_stage_id",
                     F.concat(F.lit("QM resolution: "), c("resolution")).alias("reason"),
                     c("resolved_by").alias("user_id")))
    moved = apply_stage_change(db.product_tracking, moves, as_of)
    return moved | Outputs(
        product_investigations=lambda: new_inv, quarantined_products=lambda: new_q,
        product_tracking=lambda: apply_status_change(moved["product_tracking"], db.product_statuses, status, as_of))


def resolution_commands(db) -> DataFrame:
    """Command table for K11: every unit under investigation is resolved; the outcome cycles with its id."""
    inv = db.product_investigations.where(c("status") == "Under Investigation").select("product_tracking_id").distinct()
    res = F.element_at(F.array(F.lit("Passed"), F.lit("B-Ware"), F.lit("Waste")), (c("product_tracking_id") % 3 + 1)
                       .cast("int"))
    return inv.select("product_tracking_id", res.alias("resolution"),
                      F.when(c("product_tracking_id") % 2 == 0, F.lit("checked")).alias("comment"),
                      (F.lit(1) + c("product_tracking_id") % 10).alias("resolved_by"))


# ---------------------------------------------------------------------------
# K5 harvest, K6 harvest QC
# ---------------------------------------------------------------------------

USAGE_COLUMNS = ["id", "product_tracking_id", "harvest_id", "material_type", "lot_number", "used_quantity", "used_at",
                 "used_by", "reason"]


def next_product_id(tracking: DataFrame) -> int:
    """Next unit business id: max + 1, 1000000 for an empty table."""
    return C.next_id(tracking, "product_id", empty_start=1000000)


def apply_harvest(db, commands: DataFrame, as_of: str) -> Outputs:
    """K5: command rows (request_id, filament_mount_id, printed_by, lid_id, seal_id) ->
    one harvest and one unit per request (stage 1, status Pending, sku and type from the request,
    tech-transfer flag copied, product code = lot + next 4-digit sequence of that lot), lid and seal
    usage rows of one piece each, and the request marked Fulfilled."""
    C.check_unique(commands, ["request_id"])
    now = F.lit(as_of).cast("timestamp_ntz")
    req = db.product_requests.select(c("id").alias("_rid"), c("sku_id").alias("_sku"), "lot_number",
                                     c("is_tech_transfer").alias("_tt"))
    cmd = commands.join(req, c("request_id") == c("_rid"))
    harvest = once(lambda: C.assign_ids(cmd, ["request_id"], C.next_id(db.product_harvest), "harvest_id"))

    @once
    def units() -> DataFrame:
        # one unit a harvest, in the same order: its id goes with the harvest's
        first_unit, first_harvest = C.next_id(db.product_tracking), C.next_id(db.product_harvest)
        return (harvest().withColumn("id", c("harvest_id") - F.lit(first_harvest) + F.lit(first_unit))
                .withColumn("product_id", c("harvest_id") - F.lit(first_harvest) + F.lit(next_product_id(db.product_tracking))))

    def new_harvest() -> DataFrame:
        return harvest().select(c("harvest_id").alias("id"), "request_id", "lid_id", "seal_id",
                                c("filament_mount_id").alias("filament_mounting_id"), "printed_by", now.alias("print_date"))

    def new_tracking() -> DataFrame:
        # product codes: lot + (max existing sequence of the lot + rank of the request within the lot)
        seq0 = C.next_seq_for_lot(lot_codes(db.product_tracking, db.product_harvest, db.product_requests, cmd),
                                  cmd.select("lot_number"))
        ranked = row_number_within(units(), ["lot_number"], ["request_id"], col="_lot_rank")
        coded = (ranked.join(seq0, "lot_number")
                 .withColumn("product_code", X.product_code(c("lot_number"), c("next_seq") + c("_lot_rank") - 1)))
        pending = db.product_statuses.where(c("status_name") == "Pending").agg(
            F.min("id").alias("_pending")).withColumn("_k", F.lit(1))
        types = db.product_skus.select(c("id").alias("_sid"), "product_type_id")
        return (coded.join(types, c("_sku") == c("_sid"), "left").withColumn("_k", F.lit(1)).join(F.broadcast(pending), "_k")
                .select("id", "harvest_id", "product_id", "product_type_id", c("_sku").alias("sku_id"),
                        c("_pending").alias("current_status_id"), F.lit(None).cast("long").alias("previous_stage_id"),
                        F.lit(1).cast("long").alias("current_stage_id"), F.lit(None).cast("long").alias("location_id"),
                        now.alias("last_updated_at"), "product_code", c("_tt").alias("was_tech_transfer")))

    def usage() -> DataFrame:
        lids = db.lids.select(c("id").alias("_lid"), c("serial_number").alias("_lid_lot"))
        seals = db.seals.select(c("id").alias("_seal"), c("serial_number").alias("_seal_lot"))
        mats = (units().join(lids, c("lid_id") == c("_lid")).join(seals, c("seal_id") == c("_seal"))
                .select(c("id").alias("product_tracking_id"), "harvest_id", "printed_by", F.explode(F.array(
                    F.struct(F.lit("Lid").alias("material_type"), c("_lid_lot").alias("lot_number")),
                    F.struct(F.lit("Seal").alias("material_type"), c("_seal_lot").alias("lot_number")))).alias("m")))
        rows = mats.select("product_tracking_id", "harvest_id", "m.material_type", "m.lot_number",
                           F.lit(1).cast("decimal(10,2)").alias("used_quantity"), now.alias("used_at"),
                           c("printed_by").alias("used_by"), F.lit(None).cast("string").alias("reason"))
        return C.assign_ids(rows, ["product_tracking_id", "material_type"], C.next_id(db.material_usage), "id").select(
            *USAGE_COLUMNS)

    def requests() -> DataFrame:
        done = commands.select(c("request_id").alias("_done"))
        return (db.product_requests.join(done, c("id") == c("_done"), "left")
                .withColumn("status", F.when(c("_done").isNotNull(), "Fulfilled").otherwise(c("status"))).drop("_done"))

    return Outputs(product_harvest=new_harvest, product_tracking=new_tracking, material_usage=usage,
                   product_requests=requests)


def lot_codes(tracking: DataFrame, harvests: DataFrame, requests: DataFrame, lots: DataFrame) -> DataFrame:
    """(lot_number, product_code) of the units whose request belongs to one of ``lots``."""
    req = requests.select(c("id").alias("_req"), "lot_number").join(lots.select("lot_number").distinct(), "lot_number",
                                                                    "left_semi")
    har = harvests.select(c("id").alias("_har"), "request_id")
    return (tracking.select("harvest_id", "product_code").join(har, c("harvest_id") == c("_har"))
            .join(req, c("request_id") == c("_req")).select("lot_number", "product_code"))


def harvest_commands(db) -> DataFrame:
    """Command table for K5: every pending request is printed on the best mount for its sku,
    with the first PASS lid and seal batches."""
    from spooltrace.plans.materials import request_mount_candidates
    cand = request_mount_candidates(db).where(c("best_mount_id").isNotNull())
    lid = (db.lids.where((c("qc_result") == "PASS") & (c("serial_number") != "LEGACY_LID"))
           .agg(F.min("id").alias("lid_id")).withColumn("_k", F.lit(1)))
    seal = (db.seals.where((c("qc_result") == "PASS") & (c("serial_number") != "LEGACY_SEAL"))
            .agg(F.min("id").alias("seal_id")).withColumn("_k", F.lit(1)))
    req = db.product_requests.select(c("id").alias("_r"), "requested_by")
    return (cand.join(req, c("request_id") == c("_r"))
            .withColumn("_k", F.lit(1)).join(F.broadcast(lid), "_k").join(F.broadcast(seal), "_k")
            .select("request_id", c("best_mount_id").alias("filament_mount_id"), c("requested_by").alias("printed_by"),
                    "lid_id", "seal_id"))


QC_COLUMNS = ["id", "product_tracking_id", "inspected_by", "inspected_at", "weight_grams", "pressure_drop",
              "visual_pass", "inspection_result", "notes"]


def apply_qc(db, commands: DataFrame, as_of: str) -> Outputs:
    """K6: command rows (product_tracking_id, inspected_by, weight_grams, pressure_drop, visual_pass,
    inspection_result, notes, reason_ids) -> QC rows, distinct reason links, one filament usage row
    (the spool lot of the unit's mount, quantity = measured weight), stage HarvestQCComplete with
    history, a 'Harvest QC' quarantine row for 'Quarantine' results, the business status, and every
    mount's remaining weight reduced by the weight of its units inspected here."""
    C.check_unique(commands, ["product_tracking_id"])
    now = F.lit(as_of).cast("timestamp_ntz")
    qc = commands.select("product_tracking_id", "inspected_by", now.alias("inspected_at"),
                         c("weight_grams").cast("decimal(6,2)").alias("weight_grams"),
                         c("pressure_drop").cast("decimal(6,3)").alias("pressure_drop"), "visual_pass",
                         "inspection_result", "notes", "reason_ids")
    numbered = once(lambda: C.assign_ids(qc, ["product_tracking_id"], C.next_id(db.product_quality_control), "id"))
    unit = (db.product_tracking.select(c("id").alias("_t"), c("harvest_id").alias("_h"))
            .join(db.product_harvest.select(c("id").alias("_hid"), c("filament_mounting_id").alias("_m")),
                  c("_h") == c("_hid"))
            .join(db.filament_mounting.select(c("id").alias("_mid"), c("filament_tracking_id").alias("_f")),
                  c("_m") == c("_mid"))
            .join(db.filaments.select(c("id").alias("_fid"), c("lot_number").alias("_lot")), c("_f") == c("_fid")))
    used = qc.join(unit, c("product_tracking_id") == c("_t"))
    usage = used.select("product_tracking_id", c("_h").alias("harvest_id"), F.lit("Filament").alias("material_type"),
                        c("_lot").alias("lot_number"), c("weight_grams").cast("decimal(10,2)").alias("used_quantity"),
                        now.alias("used_at"), c("inspected_by").alias("used_by"), F.lit(None).cast("string").alias("reason"))
    stage = _stage_id(db, "HarvestQCComplete")
    cmd = (commands.withColumn("_k", F.lit(1)).join(F.broadcast(stage), "_k")
           .select("product_tracking_id", c("_stage").alias("new_stage_id"), F.lit("Harvest QC Complete").alias("reason"),
                   c("inspected_by").alias("user_id")))
    moved = apply_stage_change(db.product_tracking, cmd, as_of)
    quar = (commands.where(c("inspection_result") == "Quarantine").withColumn("_k", F.lit(1))
            .join(F.broadcast(stage), "_k")
            .select("product_tracking_id", c("_stage").alias("from_stage_id"), F.lit("Harvest QC").alias("source"),
                    F.lit(None).cast("long").alias("location_id"), now.alias("quarantine_date"),
                    c("inspected_by").alias("quarantined_by"), F.nullif(c("notes"), F.lit("")).alias("quarantine_reason"),
                    F.lit("Active").alias("quarantine_status"), F.lit(None).cast("string").alias("result"),
                    F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit(None).cast("long").alias("resolved_by")))
    status = commands.select("product_tracking_id",
                             X.business_status(c("inspection_result"), "Pending").alias("status_name"))
    per_mount = used.groupBy(c("_m").alias("_mount")).agg(F.sum("weight_grams").alias("_w"))
    fm = db.filament_mounting
    mounts = (fm.join(per_mount, fm.id == per_mount._mount, "left")
              .withColumn("remaining_weight", F.when(c("_w").isNotNull(),
                                                     (c("remaining_weight") - c("_w")).cast("decimal(10,2)"))
                          .otherwise(c("remaining_weight")))
              .drop("_mount", "_w"))
    return moved | Outputs(
        product_quality_control=lambda: numbered().select(*QC_COLUMNS),
        product_quality_control_reasons=lambda: _reason_links(numbered(), "qc_id"),
        material_usage=lambda: C.assign_ids(usage, ["product_tracking_id"], C.next_id(db.material_usage), "id").select(
            *USAGE_COLUMNS),
        product_tracking=lambda: apply_status_change(moved["product_tracking"], db.product_statuses, status, as_of),
        quarantined_products=lambda: _numbered_quarantines(db, quar), filament_mounting=lambda: mounts)


def _numbered_quarantines(db, rows: DataFrame) -> DataFrame:
    return C.assign_ids(rows, ["product_tracking_id"], C.next_id(db.quarantined_products), "id").select(*QUARANTINE_COLUMNS)


def qc_commands(db) -> DataFrame:
    """Command table for K6: every printed unit awaiting QC is measured (weight and pressure from its id);
    the result follows the harvest QC rule, every 11th unit is quarantined instead."""
    from spooltrace.plans.operations import printed_pending_qc
    u = printed_pending_qc(db)
    w = (F.lit(500) + (c("id") * 31) % 600).cast("decimal(6,2)")
    p = ((c("id") * 13) % 9).cast("decimal(6,3)")
    res = F.when(c("id") % 11 == 0, F.lit("Quarantine")).otherwise(
        X.harvest_qc_rule(w, p, c("average_weight_g"), c("weight_buffer_g")))
    return u.select("id").distinct().join(u.select(c("id").alias("_i"), "average_weight_g", "weight_buffer_g").distinct(),
                                          c("id") == c("_i")).select(
        c("id").alias("product_tracking_id"), (F.lit(1) + c("id") % 10).alias("inspected_by"), w.alias("weight_grams"),
        p.alias("pressure_drop"), (c("id") % 8 != 0).alias("visual_pass"), res.alias("inspection_result"),
        F.when(c("id") % 11 == 0, F.lit("held for review")).alias("notes"),
        F.array((F.lit(1) + c("id") % 19), (F.lit(1) + c("id") % 19)).cast("array<bigint>").alias("reason_ids"))


# ---------------------------------------------------------------------------
# K8 treatment batch, K9 post-treatment QC, K14 storage, K18 shipment status
# ---------------------------------------------------------------------------

def _location_id(db, name: str) -> DataFrame:
    return db.storage_locations.where(c("location_name") == name).agg(F.min("id").alias("_loc")).withColumn(
        "_k", F.lit(1))


def apply_treatment_batch(db, commands: DataFrame, as_of: str) -> Outputs:
    """K8: command rows (batch_key, sent_by, notes, product_tracking_id, surface_treat, sterilize) ->
    one 'Shipped' batch per batch key, its unit links, and every unit moved to InTreatment at Offsite."""
    C.check_unique(commands, ["product_tracking_id"])
    now = F.lit(as_of).cast("timestamp_ntz")
    heads = commands.groupBy("batch_key").agg(F.min("sent_by").alias("sent_by"), F.min("notes").alias("notes"))
    numbered = once(lambda: C.assign_ids(heads, ["batch_key"], C.next_id(db.treatment_batches), "batch_id"))

    def batches() -> DataFrame:
        return numbered().select(c("batch_id").alias("id"), "sent_by", now.alias("sent_at"),
                                 F.lit(None).cast("timestamp_ntz").alias("received_at"), "notes",
                                 F.lit("Shipped").alias("status"))

    def links() -> DataFrame:
        rows = commands.join(numbered().select("batch_key", "batch_id"), "batch_key")
        return C.assign_ids(rows, ["product_tracking_id"], C.next_id(db.treatment_batch_products), "id").select(
            "id", "batch_id", "product_tracking_id", c("surface_treat").cast("boolean"), c("sterilize").cast("boolean"))

    stage = _stage_id(db, "InTreatment")
    off = _location_id(db, "Offsite")
    cmd = (commands.withColumn("_k", F.lit(1)).join(F.broadcast(stage), "_k").join(F.broadcast(off), "_k")
           .select("product_tracking_id", c("_stage").alias("new_stage_id"),
                   F.lit("Sent for Treatment (batch creation)").alias("reason"), c("sent_by").alias("user_id"),
                   c("_loc").alias("location_id")))
    return apply_stage_change(db.product_tracking, cmd, as_of) | Outputs(
        treatment_batches=batches, treatment_batch_products=links)


def treatment_batch_commands(db) -> DataFrame:
    """Command table for K8: units approved for treatment and in no batch, batched per sku."""
    from spooltrace.plans.operations import treatment_candidates
    cand = treatment_candidates(db).select("id", "sku").distinct()
    free = cand.join(db.treatment_batch_products.select(c("product_tracking_id").alias("_t")), c("id") == c("_t"),
                     "left_anti")
    return free.select(c("sku").alias("batch_key"), F.lit(1).cast("long").alias("sent_by"),
                       F.concat(F.lit("batch "), c("sku")).alias("notes"), c("id").alias("product_tracking_id"),
                       (c("id") % 4 != 0).alias("surface_treat"), F.lit(True).alias("sterilize"))


PTI_COLUMNS = ["id", "product_tracking_id", "inspected_by", "inspected_at", "visual_pass", "surface_treated",
               "sterilized", "qc_result", "notes"]


def apply_post_treatment_qc(db, commands: DataFrame, inspected_by: int, as_of: str,
                            batch_ids: DataFrame | None = None) -> Outputs:
    """K9: command rows (product_tracking_id, surface_treat, sterilize, visual_pass, qc_result, notes,
    quarantine_reason, reason_ids) -> inspections, distinct reason links, 'Post-Treatment QC' quarantine
    rows for 'Quarantine' results, stage PostTreatmentQC with history, business status; batches in
    ``batch_ids`` become Inspected (received now)."""
    C.check_unique(commands, ["product_tracking_id"])
    now = F.lit(as_of).cast("timestamp_ntz")
    ins = commands.select("product_tracking_id", F.lit(inspected_by).cast("long").alias("inspected_by"),
                          now.alias("inspected_at"), "visual_pass", c("surface_treat").alias("surface_treated"),
                          c("sterilize").alias("sterilized"), "qc_result", "notes", "reason_ids")
    numbered = once(lambda: C.assign_ids(ins, ["product_tracking_id"], C.next_id(db.post_treatment_inspections), "id"))
    t = db.product_tracking.select(c("id").alias("_tid"), c("current_stage_id").alias("from_stage_id"))
    quar = (commands.where(c("qc_result") == "Quarantine").join(t, c("product_tracking_id") == c("_tid"))
            .select("product_tracking_id", "from_stage_id", F.lit("Post-Treatment QC").alias("source"),
                    F.lit(None).cast("long").alias("location_id"), now.alias("quarantine_date"),
                    F.lit(inspected_by).cast("long").alias("quarantined_by"),
                    F.nullif(c("quarantine_reason"), F.lit("")).alias("quarantine_reason"),
                    F.lit("Active").alias("quarantine_status"), F.lit(None).cast("string").alias("result"),
                    F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit(None).cast("long").alias("resolved_by")))
    stage = _stage_id(db, "PostTreatmentQC")
    cmd = (commands.withColumn("_k", F.lit(1)).join(F.broadcast(stage), "_k")
           .select("product_tracking_id", c("_stage").alias("new_stage_id"),
                   F.lit("Post-Treatment QC Complete").alias("reason"), F.lit(inspected_by).cast("long").alias("user_id")))
    moved = apply_stage_change(db.product_tracking, cmd, as_of)
    status = commands.select("product_tracking_id", X.business_status(c("qc_result"), "Pending").alias("status_name"))
    out = moved | Outputs(
        post_treatment_inspections=lambda: numbered().select(*PTI_COLUMNS),
        post_treatment_inspection_reasons=lambda: _reason_links(numbered(), "inspection_id"),
        quarantined_products=lambda: _numbered_quarantines(db, quar),
        product_tracking=lambda: apply_status_change(moved["product_tracking"], db.product_statuses, status, as_of))
    if batch_ids is None:
        return out

    def batches() -> DataFrame:
        done = batch_ids.select(c("batch_id").alias("_b")).distinct()
        b = db.treatment_batches.join(done, c("id") == c("_b"), "left")
        return (b.withColumn("status", F.when(c("_b").isNotNull(), "Inspected").otherwise(c("status")))
                .withColumn("received_at", F.when(c("_b").isNotNull(), now).otherwise(c("received_at"))).drop("_b"))
    return out | Outputs(treatment_batches=batches)


def post_treatment_commands(db) -> DataFrame:
    """Command table for K9: units of batches out for treatment, judged by the treatment QC rule."""
    units = (db.treatment_batch_products.alias("tbp")
             .join(db.treatment_batches.where(c("status") == "Shipped").alias("tb"), c("tbp.batch_id") == c("tb.id"))
             .join(db.product_tracking.alias("pt"), c("tbp.product_tracking_id") == c("pt.id"))
             .join(db.product_statuses.alias("st"), c("pt.current_status_id") == c("st.id"), "left"))
    vis = c("pt.id") % 6 != 3
    quar = c("pt.id") % 17 == 0
    res = X.treatment_qc_rule(c("st.status_name"), c("tbp.surface_treat"), c("tbp.surface_treat"), c("tbp.sterilize"),
                              quar, vis)
    return units.select(c("pt.id").alias("product_tracking_id"), c("tbp.batch_id").alias("batch_id"),
                        c("tbp.surface_treat").alias("surface_treat"), c("tbp.sterilize").alias("sterilize"),
                        F.when(quar, F.lit(True)).otherwise(vis).alias("visual_pass"), res.alias("qc_result"),
                        F.lit(None).cast("string").alias("notes"),
                        F.when(res == "Quarantine", F.lit("held after treatment")).alias("quarantine_reason"),
                        F.array(F.lit(1) + c("pt.id") % 19).cast("array<bigint>").alias("reason_ids"))


def apply_storage(db, assignments: DataFrame, user_id: int, as_of: str, update_stage: bool = True) -> Outputs:
    """Assignments (product_tracking_id, location_id, stage_code, seq?) -> active quarantine rows of units
    sent to Quarantine take the (last such) location; with ``update_stage`` units move to the stage at the location
    ('Moved to Quarantine' / 'Disposed' / 'Storage assignment'), one step per assignment."""
    ordered = check_commands(assignments, "product_tracking_id")

    def quarantines() -> DataFrame:
        sent = assignments.where(c("stage_code") == "Quarantine")
        sent = last_command(sent, "product_tracking_id", "location_id") if ordered else sent
        qa = sent.select(c("product_tracking_id").alias("_p"), c("location_id").alias("_l"))
        q = db.quarantined_products
        jq = q.join(qa, (q.product_tracking_id == qa._p) & (q.quarantine_status == "Active"), "left")
        return jq.select(*[F.coalesce(c("_l"), q[x]).alias(x) if x == "location_id" else q[x] for x in q.columns])

    out = Outputs(quarantined_products=quarantines)
    if not update_stage:
        return out
    ids = db.lifecycle_stages.select(c("stage_code").alias("_code"), c("id").alias("new_stage_id"))
    cmd = (assignments.join(F.broadcast(ids), c("stage_code") == c("_code"))
           .select("product_tracking_id", "new_stage_id", "location_id",
                   F.when(c("stage_code") == "Quarantine", "Moved to Quarantine")
                    .when(c("stage_code") == "Disposed", "Disposed").otherwise("Storage assignment").alias("reason"),
                   F.lit(user_id).cast("long").alias("user_id"), *(["seq"] if ordered else [])))
    return out | apply_stage_change(db.product_tracking, cmd, as_of)


def storage_assignments(db) -> DataFrame:
    """Command table for K14: every unit needing storage after harvest QC goes to its first allowed shelf and, if
    others are allowed, then to its last one; every unit in an active quarantine goes to a shelf of its own."""
    from spooltrace.plans.operations import needs_storage_harvest, shelf_options
    opts = shelf_options(db, needs_storage_harvest(db), "Post-Harvest QC")
    shelf = F.struct("location_id", "next_stage_code")
    ends = opts.groupBy(c("id").alias("product_tracking_id")).agg(F.min(shelf).alias("a"), F.max(shelf).alias("b"))
    ends = ends.select("product_tracking_id", F.posexplode(F.array_distinct(F.array("a", "b"))).alias("k", "to"))
    ends = ends.select("product_tracking_id", "to.location_id", c("to.next_stage_code").alias("stage_code"),
                       (c("k") + 1).alias("seq"))
    held = (db.quarantined_products.where(c("quarantine_status") == "Active").select("product_tracking_id").distinct()
            .join(ends.select("product_tracking_id").distinct(), "product_tracking_id", "left_anti"))
    return ends.unionByName(held.select(
        "product_tracking_id", (F.lit(1) + c("product_tracking_id") % 25).alias("location_id"),
        F.lit("Quarantine").alias("stage_code"), F.lit(1).alias("seq")))


def apply_shipment_status(db, commands: DataFrame, user_id: int, as_of: str) -> Outputs:
    """Command rows (shipment_id, action shipped|delivered, carrier, tracking_number) ->
    shipped: status, ship date, carrier, tracking number, and its units to stage Shipped at Offsite;
    delivered: status and delivery date."""
    C.check_unique(commands, ["shipment_id"])
    now = F.lit(as_of).cast("timestamp_ntz")
    s = db.shipments
    cm = commands.select(c("shipment_id").alias("_sid"), c("action").alias("_act"), c("carrier").alias("_car"),
                         c("tracking_number").alias("_trk"))
    j = s.join(cm, s.id == cm._sid, "left")
    shp, dlv = c("_act") == "shipped", c("_act") == "delivered"
    cols = []
    for x in s.columns:
        if x == "status":
            cols.append(F.when(shp, "Shipped").when(dlv, "Delivered").otherwise(c(x)).alias(x))
        elif x == "ship_date":
            cols.append(F.when(shp, now).otherwise(c(x)).alias(x))
        elif x == "delivery_date":
            cols.append(F.when(dlv, now).otherwise(c(x)).alias(x))
        elif x == "updated_at":
            cols.append(F.when(shp | dlv, now).otherwise(c(x)).alias(x))
        elif x == "carrier":
            cols.append(F.when(shp, c("_car")).otherwise(c(x)).alias(x))
        elif x == "tracking_number":
            cols.append(F.when(shp, c("_trk")).otherwise(c(x)).alias(x))
        else:
            cols.append(c(x))
    shipments = j.select(*cols)
    units = (db.shipment_unit_items.join(commands.where(c("action") == "shipped").select(c("shipment_id").alias("_s")),
                                         c("shipment_id") == c("_s"))
             .select("product_tracking_id"))
    stage = _stage_id(db, "Shipped")
    off = _location_id(db, "Offsite")
    cmd = (units.withColumn("_k", F.lit(1)).join(F.broadcast(stage), "_k").join(F.broadcast(off), "_k")
           .select("product_tracking_id", c("_stage").alias("new_stage_id"), F.lit("Shipment sent").alias("reason"),
                   F.lit(user_id).cast("long").alias("user_id"), c("_loc").alias("location_id")))
    return apply_stage_change(db.product_tracking, cmd, as_of) | Outputs(shipments=lambda: shipments)


def shipment_status_commands(db) -> DataFrame:
    """Command table for K18: pending shipments are sent (carrier by id), shipped ones are delivered."""
    s = db.shipments
    sent = s.where(c("status") == "Pending").select(
        c("id").alias("shipment_id"), F.lit("shipped").alias("action"),
        F.when(c("id") % 2 == 0, F.lit("UPS")).otherwise(F.lit("DHL")).alias("carrier"),
        F.concat(F.lit("TRK"), c("id").cast("string")).alias("tracking_number"))
    done = s.where(c("status") == "Shipped").select(
        c("id").alias("shipment_id"), F.lit("delivered").alias("action"), F.lit(None).cast("string").alias("carrier"),
        F.lit(None).cast("string").alias("tracking_number"))
    return sent.unionByName(done)


# ---------------------------------------------------------------------------
# K16 orders, K17 shipments
# ---------------------------------------------------------------------------

ORDER_COLUMNS = ["id", "parent_order_id", "customer_id", "order_date", "order_creator_id", "status", "updated_at",
                 "updated_by", "notes"]
ITEM_COLUMNS = ["id", "order_id", "product_sku_id", "quantity"]


def _ts_text(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def _header_audit(orders: DataFrame, cmds: DataFrame, new_status: str, reason: str, as_of: str,
                  audit_start: int) -> DataFrame:
    """Audit rows for (status, updated_by, updated_at) of order headers; unchanged values are skipped (K3)."""
    j = orders.join(cmds.select(c("order_id").alias("_oid"), c("user_id").alias("_uid")), c("id") == c("_oid"))
    changes = j.select(c("id").alias("record_id"), "_uid", F.explode(F.array(
        F.struct(F.lit("status").alias("field_name"), c("status").alias("old_value"), F.lit(new_status).alias("new_value"),
                 F.lit(0).alias("seq")),
        F.struct(F.lit("updated_by").alias("field_name"), c("updated_by").cast("string").alias("old_value"),
                 c("_uid").cast("string").alias("new_value"), F.lit(1).alias("seq")),
        F.struct(F.lit("updated_at").alias("field_name"), _ts_text(c("updated_at")).alias("old_value"),
                 _ts_text(F.lit(as_of).cast("timestamp_ntz")).alias("new_value"), F.lit(2).alias("seq")))).alias("ch"))
    changes = changes.select("record_id", "ch.*", F.lit(reason).alias("reason"), c("_uid").alias("changed_by"))
    return apply_field_changes(orders, "orders", changes, as_of, audit_start, update=False)["audit_log"]


def apply_order_cancel(db, cancels: DataFrame, as_of: str) -> Outputs:
    """K16 (cancel): cancel rows (order_id, user_id, notes) -> three audit rows per order (status,
    updated_by, updated_at) and the order set to Canceled with the new notes."""
    C.check_unique(cancels, ["order_id"])
    now = F.lit(as_of).cast("timestamp_ntz")
    cm = cancels.select(c("order_id").alias("_oid"), c("user_id").alias("_uid"), c("notes").alias("_notes"))
    o = db.orders.join(cm, c("id") == c("_oid"), "left")
    hit = c("_oid").isNotNull()
    orders = o.select(*[
        F.when(hit, "Canceled").otherwise(c(x)).alias(x) if x == "status" else
        F.when(hit, now).otherwise(c(x)).alias(x) if x == "updated_at" else
        F.when(hit, c("_uid")).otherwise(c(x)).alias(x) if x == "updated_by" else
        F.when(hit, c("_notes")).otherwise(c(x)).alias(x) if x == "notes" else c(x) for x in ORDER_COLUMNS])
    return Outputs(orders=lambda: orders, audit_log=lambda: _header_audit(
        db.orders, cancels, "Canceled", "Order request canceled", as_of, C.next_id(db.audit_log)))


def cancel_commands(db) -> DataFrame:
    """Command table for K16 cancel: every processing order is canceled."""
    return db.orders.where(c("status") == "Processing").select(
        c("id").alias("order_id"), (F.lit(1) + c("customer_id") % 10).alias("user_id"),
        F.lit("customer request").alias("notes"))


def apply_order_line_diff(db, desired: DataFrame, user_id: int, as_of: str) -> Outputs:
    """K16 (update): desired (order_id, product_sku_id, quantity) for the orders it names ->
    changed lines updated, new positive lines added, lines of those orders missing from ``desired``
    deleted; each with an audit row ('quantity' / 'quantity' from None / 'Deleted')."""
    # the lines and the commands are read by the check, the diff and each output: derived once
    items, desired = materialize(db.order_items), materialize(desired)
    C.check_unique(desired, ["order_id", "product_sku_id"])
    d = desired.where(c("quantity") >= 0)
    orders_touched = desired.select(c("order_id").alias("_o")).distinct()
    mine = items.join(orders_touched, c("order_id") == c("_o"), "left_semi")
    j = mine.alias("i").join(d.alias("d"), (c("i.order_id") == c("d.order_id"))
                             & (c("i.product_sku_id") == c("d.product_sku_id")), "full_outer")
    changed = j.where(c("i.id").isNotNull() & c("d.order_id").isNotNull() & (c("i.quantity") != c("d.quantity")))
    added = j.where(c("i.id").isNull() & (c("d.quantity") > 0))
    removed = j.where(c("i.id").isNotNull() & c("d.order_id").isNull() & (c("i.quantity") != 0))
    new_items = once(lambda: C.assign_ids(
        added.select(c("d.order_id").alias("order_id"), c("d.product_sku_id").alias("product_sku_id"),
                     c("d.quantity").cast("long").alias("quantity")),
        ["order_id", "product_sku_id"], C.next_id(items), "id").select(*ITEM_COLUMNS))
    # lines are keyed by (order, sku): unique per order, unlike a possibly repeated line id
    ch = changed.select(c("i.order_id").alias("_co"), c("i.product_sku_id").alias("_cs"), c("d.quantity").alias("_q"))
    rm = removed.select(c("i.order_id").alias("_ro"), c("i.product_sku_id").alias("_rs"))
    kept = (items.join(rm, (c("order_id") == c("_ro")) & (c("product_sku_id") == c("_rs")), "left_anti")
            .join(ch, (c("order_id") == c("_co")) & (c("product_sku_id") == c("_cs")), "left")
            .withColumn("quantity", F.coalesce(c("_q").cast("long"), c("quantity"))).drop("_co", "_cs", "_q"))
    uid = F.lit(user_id).cast("long")

    def audit() -> DataFrame:
        rows = (changed.select(c("i.id").alias("record_id"), F.lit("quantity").alias("field_name"),
                               c("i.quantity").cast("string").alias("old_value"),
                               c("d.quantity").cast("string").alias("new_value"), F.lit("Sales order updated").alias("reason"))
                .unionByName(new_items().select(c("id").alias("record_id"), F.lit("quantity").alias("field_name"),
                                                F.lit("None").alias("old_value"),
                                                c("quantity").cast("string").alias("new_value"),
                                                F.lit("Product item added to order").alias("reason")))
                .unionByName(removed.select(c("i.id").alias("record_id"), F.lit("Deleted").alias("field_name"),
                                            c("i.quantity").cast("string").alias("old_value"), F.lit("Yes").alias("new_value"),
                                            F.lit("Removed from order").alias("reason"))))
        rows = rows.select(F.lit("order_items").alias("table_name"), "record_id", "field_name", "old_value", "new_value",
                           "reason", uid.alias("changed_by"), F.lit(as_of).cast("timestamp_ntz").alias("changed_at"))
        return C.assign_ids(rows, ["record_id", "field_name", "old_value", "new_value"], C.next_id(db.audit_log),
                            "id").select(*AUDIT_COLUMNS)

    return Outputs(order_items=lambda: kept.select(*ITEM_COLUMNS).unionByName(new_items()), audit_log=audit)


def line_diff_commands(db) -> DataFrame:
    """Command table for K16 update: every processing order changes its even-sku lines by +1, drops sku 3,
    and asks for two units of sku 7."""
    o = db.orders.where(c("status") == "Processing").select(c("id").alias("_o"))
    lines = (db.order_items.join(o, c("order_id") == c("_o"))
             .where(~c("product_sku_id").isin(3, 7))
             .select("order_id", "product_sku_id",
                     (c("quantity") + F.when(c("product_sku_id") % 2 == 0, 1).otherwise(0)).cast("long").alias("quantity")))
    extra = o.select(c("_o").alias("order_id"), F.lit(7).cast("long").alias("product_sku_id"),
                     F.lit(2).cast("long").alias("quantity"))
    return lines.unionByName(extra)


def apply_recreate_orders(db, source_orders: DataFrame, user_id: int, as_of: str) -> Outputs:
    """K16 (re-create): canceled orders (order_id) -> new Processing orders for the same customer with the
    old order as parent and a note prefix, carrying over the positive lines."""
    now = F.lit(as_of).cast("timestamp_ntz")
    old = db.orders.join(source_orders.select(c("order_id").alias("_src")), c("id") == c("_src"))
    heads = once(lambda: C.assign_ids(
        old.select(c("id").alias("parent_order_id"), "customer_id", c("notes").alias("_old_notes")),
        ["parent_order_id"], C.next_id(db.orders), "id"))

    def orders() -> DataFrame:
        return heads().select(
            "id", "parent_order_id", "customer_id", now.alias("order_date"),
            F.lit(user_id).cast("long").alias("order_creator_id"), F.lit("Processing").alias("status"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit(user_id).cast("long").alias("updated_by"),
            F.concat(F.lit("Re-created from #"), c("parent_order_id").cast("string"),
                     F.when(c("_old_notes").isNotNull(), F.concat(F.lit(": "), c("_old_notes")))
                     .otherwise(F.lit(""))).alias("notes"))

    def lines() -> DataFrame:
        rows = (db.order_items.where(c("quantity") > 0)
                .join(heads().select(c("id").alias("_new"), c("parent_order_id").alias("_p")), c("order_id") == c("_p"))
                .select(c("_new").alias("order_id"), "product_sku_id", "quantity"))
        return C.assign_ids(rows, ["order_id", "product_sku_id"], C.next_id(db.order_items), "id").select(*ITEM_COLUMNS)

    return Outputs(orders=orders, order_items=lines)


def recreate_commands(db) -> DataFrame:
    """Command table for K16 re-create: every re-creatable canceled order."""
    from spooltrace.plans.sales import canceled_orders
    return canceled_orders(db).select("order_id")


SHIPMENT_COLUMNS = ["id", "customer_id", "order_id", "creator_id", "created_date", "ship_date", "delivery_date", "status",
                    "updated_at", "updated_by", "tracking_number", "carrier", "notes"]


def apply_shipment(db, as_of: str, user_id: int = 1) -> Outputs:
    """Every open order whose picking lines are all fully allocated by FIFO gets a Pending shipment with
    its allocated units and per-sku quantities (H13); the units move to PendingShipment and the order is
    Completed with three audit rows."""
    from spooltrace.plans import sales as H
    uid = F.lit(user_id).cast("long")
    now = F.lit(as_of).cast("timestamp_ntz")
    picked = once(lambda: H.fifo_allocate(db, as_of))

    @once
    def ship_orders() -> DataFrame:
        short = picked()[1].where(c("is_short")).select(c("order_id").alias("_s")).distinct()
        return (db.orders.where(c("status") == "Processing").select(c("id").alias("order_id"), "customer_id")
                .join(short, c("order_id") == c("_s"), "left_anti"))

    heads = once(lambda: C.assign_ids(ship_orders(), ["order_id"], C.next_id(db.shipments), "shipment_id"))
    allocated = once(lambda: picked()[0].join(ship_orders().select("order_id"), "order_id", "left_semi").select(
        "order_id", c("product_id").alias("product_tracking_id")))

    def shipments() -> DataFrame:
        none_ts, none_text = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")
        return heads().select(
            c("shipment_id").alias("id"), "customer_id", "order_id", uid.alias("creator_id"), now.alias("created_date"),
            none_ts.alias("ship_date"), none_ts.alias("delivery_date"), F.lit("Pending").alias("status"),
            none_ts.alias("updated_at"), uid.alias("updated_by"), none_text.alias("tracking_number"),
            none_text.alias("carrier"), F.lit("").alias("notes"))

    def units() -> DataFrame:
        rows = allocated().join(heads().select("order_id", "shipment_id"), "order_id").drop("order_id")
        return C.assign_ids(rows, ["product_tracking_id"], C.next_id(db.shipment_unit_items), "id").select(
            "id", "shipment_id", "product_tracking_id")

    def sku_items() -> DataFrame:
        rows = (H.shipment_sku_items(db, as_of).join(heads().select("order_id", "shipment_id"), "order_id")
                .select("shipment_id", "product_sku_id", "quantity"))
        return C.assign_ids(rows, ["shipment_id", "product_sku_id"], C.next_id(db.shipment_sku_items), "id").select(
            "id", "shipment_id", "product_sku_id", "quantity")

    @once
    def moved() -> Outputs:
        cmd = (allocated().withColumn("_k", F.lit(1)).join(F.broadcast(_stage_id(db, "PendingShipment")), "_k")
               .select("product_tracking_id", c("_stage").alias("new_stage_id"),
                       F.lit("Marked for Shipment").alias("reason"), uid.alias("user_id")))
        return apply_stage_change(db.product_tracking, cmd, as_of)

    def orders() -> DataFrame:
        o = db.orders.join(ship_orders().select(c("order_id").alias("_oid")), c("id") == c("_oid"), "left")
        hit = c("_oid").isNotNull()
        return o.select(*[F.when(hit, "Completed").otherwise(c(x)).alias(x) if x == "status" else
                          F.when(hit, now).otherwise(c(x)).alias(x) if x == "updated_at" else
                          F.when(hit, uid).otherwise(c(x)).alias(x) if x == "updated_by" else c(x) for x in ORDER_COLUMNS])

    return Outputs(
        shipments=shipments, shipment_unit_items=units, shipment_sku_items=sku_items, orders=orders,
        product_tracking=lambda: moved()["product_tracking"],
        product_status_history=lambda: moved()["product_status_history"],
        audit_log=lambda: _header_audit(db.orders, ship_orders().select("order_id", uid.alias("user_id")), "Completed",
                                        "Shipment created", as_of, C.next_id(db.audit_log)))


# ---------------------------------------------------------------------------
# K19 mounts, K21 reasons, K22 users, K23 materials
# ---------------------------------------------------------------------------

MOUNT_COLUMNS = ["id", "filament_tracking_id", "printer_id", "mounted_by", "mounted_at", "unmounted_at", "unmounted_by",
                 "remaining_weight", "status"]


def apply_mount(db, commands: DataFrame, as_of: str) -> DataFrame:
    """K19 (mount): rows (filament_tracking_id, printer_id, mounted_by, weight_grams) -> new 'In Use' mounts."""
    rows = commands.select("filament_tracking_id", "printer_id", "mounted_by",
                           F.lit(as_of).cast("timestamp_ntz").alias("mounted_at"),
                           F.lit(None).cast("timestamp_ntz").alias("unmounted_at"),
                           F.lit(None).cast("long").alias("unmounted_by"),
                           c("weight_grams").cast("decimal(10,2)").alias("remaining_weight"), F.lit("In Use").alias("status"))
    return C.assign_ids(rows, ["filament_tracking_id", "printer_id"], C.next_id(db.filament_mounting), "id").select(
        *MOUNT_COLUMNS)


def mount_commands(db) -> DataFrame:
    """Command table for K19 mount: every mountable spool goes on a printer chosen from its id."""
    from spooltrace.plans.materials import mountable_filaments
    m = mountable_filaments(db).groupBy("id").agg(F.max("weight_grams").alias("weight_grams"))
    return m.select(c("id").alias("filament_tracking_id"), (F.lit(1) + c("id") % 7).alias("printer_id"),
                    (F.lit(1) + c("id") % 10).alias("mounted_by"), "weight_grams")


def apply_unmount(mounting: DataFrame, commands: DataFrame, as_of: str) -> DataFrame:
    """K19 (unmount): rows (mount_id, user_id) -> mounts set Unmounted with time and user."""
    cm = commands.select(c("mount_id").alias("_m"), c("user_id").alias("_u"))
    j = mounting.join(cm, c("id") == c("_m"), "left")
    hit = c("_m").isNotNull()
    return j.select(*[F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(c(x)).alias(x) if x == "unmounted_at" else
                      F.when(hit, c("_u")).otherwise(c(x)).alias(x) if x == "unmounted_by" else
                      F.when(hit, "Unmounted").otherwise(c(x)).alias(x) if x == "status" else c(x)
                      for x in MOUNT_COLUMNS])


def unmount_commands(db) -> DataFrame:
    """Command table for K19 unmount: every open mount."""
    return db.filament_mounting.where(c("unmounted_at").isNull()).select(
        c("id").alias("mount_id"), (F.lit(1) + c("id") % 10).alias("user_id"))


def apply_weight_update(db, commands: DataFrame, as_of: str) -> Outputs:
    """K19 (weight): rows (filament_pk, new_weight, reason, user_id) -> the 'In Use' mount's remaining weight
    when the spool has one, else the spool's weight; audited (numeric compare, unchanged skipped)."""
    C.check_unique(commands, ["filament_pk"])
    fm = db.filament_mounting.where(c("status") == "In Use").select(c("id").alias("_mid"), c("filament_tracking_id").alias("_f"),
                                                                     c("remaining_weight").alias("_rw"))
    routed = commands.join(fm, c("filament_pk") == c("_f"), "left")
    to_mount = routed.where(c("_mid").isNotNull()).select(
        c("_mid").alias("record_id"), F.lit("remaining_weight").alias("field_name"), c("_rw").cast("string").alias("old_value"),
        c("new_weight").cast("string").alias("new_value"), "reason", c("user_id").alias("changed_by"))
    f = db.filaments.select(c("id").alias("_fid"), c("weight_grams").alias("_w"))
    to_spool = (routed.where(c("_mid").isNull()).join(f, c("filament_pk") == c("_fid"))
                .select(c("_fid").alias("record_id"), F.lit("weight_grams").alias("field_name"),
                        c("_w").cast("string").alias("old_value"), c("new_weight").cast("string").alias("new_value"),
                        "reason", c("user_id").alias("changed_by")))
    m = apply_field_changes(db.filament_mounting, "filament_mounting", to_mount, as_of, _next_audit(db))
    s = apply_field_changes(db.filaments, "filaments", to_spool, as_of,
                            lambda: C.next_id(db.audit_log) + m["audit_log"].count())  # after the mounts' rows
    return m.only("filament_mounting") | s.only("filaments") | Outputs(
        audit_log=lambda: m["audit_log"].unionByName(s["audit_log"]))


def weight_commands(db) -> DataFrame:
    """Command table for K19 weight: every spool is re-weighed (value from its id)."""
    return db.filaments.select(
        c("id").alias("filament_pk"), ((c("id") * 7) % 1000 + F.lit(0.5)).cast("decimal(10,2)").alias("new_weight"),
        F.lit("reweigh").alias("reason"), F.lit(1).cast("long").alias("user_id"))


REASON_COLUMNS = ["id", "reason_code", "reason_label", "category", "default_outcome", "severity", "is_active"]


def apply_reasons(db, upserts: DataFrame, contexts: DataFrame) -> Outputs:
    """Upserts (reason_id or NULL, reason_code, reason_label, category, default_outcome, severity,
    is_active) update by id or insert; contexts (reason_code, context_id) replace the context set of every
    reason they name (duplicates dropped)."""
    r = db.issue_reasons
    upd = upserts.where(c("reason_id").isNotNull())
    C.check_unique(upd, ["reason_id"])
    u = upd.select(c("reason_id").alias("_id"), *[c(x).alias(f"_n_{x}") for x in REASON_COLUMNS if x != "id"])
    j = r.join(u, c("id") == c("_id"), "left")
    hit = c("_id").isNotNull()
    updated = j.select(*[c(x) if x == "id" else F.when(hit, c(f"_n_{x}")).otherwise(c(x)).alias(x) for x in REASON_COLUMNS])
    new = upserts.where(c("reason_id").isNull()).drop("reason_id")
    reasons = once(lambda: updated.unionByName(C.assign_ids(new, ["reason_code"], C.next_id(r), "id").select(*REASON_COLUMNS)))

    def context_links() -> DataFrame:
        ids = reasons().select(c("id").alias("reason_id"), c("reason_code").alias("_code"))
        wanted = contexts.join(ids, c("reason_code") == c("_code")).select("reason_id", "context_id").distinct()
        touched = wanted.select(c("reason_id").alias("_r")).distinct()
        kept = db.issue_reason_contexts.join(touched, c("reason_id") == c("_r"), "left_anti")
        added = C.assign_ids(wanted, ["reason_id", "context_id"], C.next_id(db.issue_reason_contexts), "id").select(
            "id", "reason_id", "context_id")
        return kept.unionByName(added)

    return Outputs(issue_reasons=reasons, issue_reason_contexts=context_links)


def reason_commands(db) -> tuple[DataFrame, DataFrame]:
    """Command tables for K21: relabel and deactivate the visual reasons, add one reason per event type seen
    in the events table, and set their contexts (AdHoc only for new reasons, Quarantine+AdHoc for relabelled)."""
    vis = db.issue_reasons.where(c("category") == "Visual").select(
        c("id").alias("reason_id"), "reason_code", F.concat(c("reason_label"), F.lit(" (rev)")).alias("reason_label"),
        "category", "default_outcome", "severity", (c("id") % 2 == 0).alias("is_active"))
    ev = db.src("events").select(F.upper(c("event_type")).alias("t")).where(c("t").isNotNull()).distinct()
    new = ev.select(F.lit(None).cast("long").alias("reason_id"), F.concat(F.lit("EVT_"), c("t")).alias("reason_code"),
                    F.concat(F.lit("Event "), F.lower(c("t"))).alias("reason_label"), F.lit("General").alias("category"),
                    F.lit(None).cast("string").alias("default_outcome"), F.lit(None).cast("long").alias("severity"),
                    F.lit(True).alias("is_active"))
    ups = vis.unionByName(new)
    ctx = (vis.select("reason_code", F.explode(F.array(F.lit(3).cast("long"), F.lit(4).cast("long"),
                                                       F.lit(4).cast("long"))).alias("context_id"))
           .unionByName(new.select("reason_code", F.lit(4).cast("long").alias("context_id"))))
    return ups, ctx


USER_COLUMNS = ["id", "display_name", "department_id", "is_active", "azure_ad_object_id", "user_principal_name"]


def apply_users(db, users: DataFrame, logins: DataFrame) -> DataFrame:
    """Sign-ins (oid, upn, display_name) -> users upserted by directory id; the display name becomes the
    initials form (F18) of the display name, else the principal name, else 'User'; new users go to department
    GEN, else the first active department."""
    C.check_unique(logins, ["oid"])
    src = logins.select(c("oid").alias("_oid"), F.nullif(c("upn"), F.lit("")).alias("_upn"),
                        X.name_initials(F.coalesce(F.nullif(c("display_name"), F.lit("")), F.nullif(c("upn"), F.lit("")),
                                                   F.lit("User"))).alias("_name"))
    j = users.join(src, c("azure_ad_object_id") == c("_oid"), "left")
    hit = c("_oid").isNotNull()
    updated = j.select(*[F.when(hit, c("_name")).otherwise(c(x)).alias(x) if x == "display_name" else
                         F.when(hit, c("_upn")).otherwise(c(x)).alias(x) if x == "user_principal_name" else
                         F.when(hit, F.lit(True)).otherwise(c(x)).alias(x) if x == "is_active" else c(x)
                         for x in USER_COLUMNS])
    dept = db.departments.agg(F.coalesce(F.min(F.when(c("department_code") == "GEN", c("id"))),
                                         F.min(F.when(c("is_active"), c("id")))).alias("_dept")).withColumn("_k", F.lit(1))
    new = (src.join(users.select(c("azure_ad_object_id").alias("_e")), c("_oid") == c("_e"), "left_anti")
           .withColumn("_k", F.lit(1)).join(F.broadcast(dept), "_k"))
    new = C.assign_ids(new, ["_oid"], C.next_id(users), "id").select(
        "id", c("_name").alias("display_name"), c("_dept").cast("long").alias("department_id"), F.lit(True).alias("is_active"),
        c("_oid").alias("azure_ad_object_id"), c("_upn").alias("user_principal_name"))
    return updated.unionByName(new)


def login_commands(db, round_no: int) -> DataFrame:
    """Sign-in table for K22: one sign-in per supplier; in round 2 each signs in again with a changed name."""
    s = db.src("supplier")
    name = F.concat(F.lit("Anna Maria "), c("s_name")) if round_no == 2 else c("s_name")
    return s.select(F.concat(F.lit("oid-"), c("s_suppkey").cast("string")).alias("oid"),
                    F.concat(F.lit("user"), c("s_suppkey").cast("string"), F.lit("@plant.example")).alias("upn"),
                    F.when(c("s_suppkey") % 5 == 0, F.lit(None)).otherwise(name).alias("display_name"))


def apply_new_lids(db, commands: DataFrame, as_of: str) -> Outputs:
    """K23 (lids): rows (serial_number, quantity, location_id, received_by, qc_result) -> new lid batches with a
    trimmed serial; serials already present (or repeated in the input) are rejected into a report."""
    cm = commands.withColumn("serial_number", F.trim(c("serial_number")))
    dup_in = cm.groupBy("serial_number").count().where(c("count") > 1).select("serial_number")
    existing = db.lids.select("serial_number")
    rejected = (cm.join(existing, "serial_number", "left_semi").select("serial_number", F.lit("exists").alias("why"))
                .unionByName(dup_in.select("serial_number", F.lit("repeated").alias("why"))))
    ok = cm.join(existing, "serial_number", "left_anti").join(dup_in, "serial_number", "left_anti")
    rows = ok.select("serial_number", c("quantity").cast("long"), c("location_id").cast("long"),
                     F.lit(as_of).cast("timestamp_ntz").alias("received_at"), c("received_by").cast("long"), "qc_result")
    return Outputs(lids=lambda: C.assign_ids(rows, ["serial_number"], C.next_id(db.lids), "id").select(*db.lids.columns),
                   rejected=lambda: rejected)


def lid_commands(db) -> DataFrame:
    """Command table for K23: a delivery per part brand; some serials clash with existing lids."""
    p = db.src("part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"), F.count(F.lit(1)).alias("n"))
    return p.select(F.concat(F.lit(" LID"), (c("k") % 150).cast("string"), F.lit(" ")).alias("serial_number"),
                    (F.lit(100) + c("n")).alias("quantity"), (F.lit(1) + c("k") % 25).alias("location_id"),
                    F.lit(1).alias("received_by"), F.lit("PASS").alias("qc_result"))


def apply_new_customers(db, names: DataFrame) -> Outputs:
    """K23 (customers): names -> new customers (trimmed, non-blank); existing or repeated names rejected."""
    n = names.select(F.trim(c("customer_name")).alias("customer_name")).where(c("customer_name") != "")
    dup_in = n.groupBy("customer_name").count().where(c("count") > 1).select("customer_name")
    existing = db.customers.select("customer_name")
    ok = n.join(existing, "customer_name", "left_anti").join(dup_in, "customer_name", "left_anti")
    rejected = (n.join(existing, "customer_name", "left_semi").select("customer_name", F.lit("exists").alias("why"))
                .unionByName(dup_in.select("customer_name", F.lit("repeated").alias("why"))))
    return Outputs(customers=lambda: C.assign_ids(ok, ["customer_name"], C.next_id(db.customers), "id").select(
        "id", "customer_name"), rejected=lambda: rejected)


def customer_commands(db) -> DataFrame:
    """Command table for K23 customers: one new account per nation and market segment, plus every name sent again."""
    c1 = (db.src("customer").select("c_nationkey", "c_mktsegment").distinct()
          .select(F.concat(F.lit(" Account "), c("c_mktsegment"), F.lit(" "), c("c_nationkey").cast("string")).alias(
              "customer_name")))
    c2 = db.src("customer").select(c("c_name").alias("customer_name"))
    return c1.unionByName(c2)


# ---------------------------------------------------------------------------
# K7 QC edits, K20 print specs
# ---------------------------------------------------------------------------

def apply_qc_edit(db, edits: DataFrame, as_of: str, table: str = "product_quality_control",
                  result_field: str = "inspection_result", source: str = "Harvest QC", other_status: str = "A-Ware",
                  move_reason: str = "QC edit: moved to Quarantine") -> Outputs:
    """K7: edit rows (qc_id, product_tracking_id, field_name, old_value, new_value, reason, user_id) ->
    audited QC field changes; a changed inspection result re-maps the unit's status (default A-Ware) and a
    new 'Quarantine' result adds a 'Harvest QC' quarantine row (from the current stage) and moves the unit
    to stage Quarantine. The post-treatment form edits ``post_treatment_inspections`` the same way."""
    changes = edits.select(c("qc_id").alias("record_id"), "field_name", "old_value", "new_value", "reason",
                           c("user_id").alias("changed_by"))
    res = apply_field_changes(getattr(db, table), table, changes, as_of, _next_audit(db))
    # an edit that sets what is there already is no hit
    hits = edits.where((c("field_name") == result_field) & (_py_str(c("old_value")) != _py_str(c("new_value")))).select(
        "product_tracking_id", c("new_value").alias("result"), "reason", "user_id")
    C.check_unique(hits, ["product_tracking_id"])
    q = hits.where(c("result") == "Quarantine")
    now = F.lit(as_of).cast("timestamp_ntz")
    stage = _stage_id(db, "Quarantine")
    cmd = (q.withColumn("_k", F.lit(1)).join(F.broadcast(stage), "_k")
           .select("product_tracking_id", c("_stage").alias("new_stage_id"),
                   F.lit(move_reason).alias("reason"), "user_id"))
    status = hits.select("product_tracking_id", X.business_status(c("result"), other_status).alias("status_name"))
    moved = apply_stage_change(db.product_tracking, cmd, as_of)

    def quarantines() -> DataFrame:
        t = db.product_tracking.select(c("id").alias("_tid"), c("current_stage_id").alias("from_stage_id"))
        return _numbered_quarantines(db, q.join(t, c("product_tracking_id") == c("_tid")).select(
            "product_tracking_id", "from_stage_id", F.lit(source).alias("source"),
            F.lit(None).cast("long").alias("location_id"), now.alias("quarantine_date"),
            c("user_id").alias("quarantined_by"), F.nullif(c("reason"), F.lit("")).alias("quarantine_reason"),
            F.lit("Active").alias("quarantine_status"), F.lit(None).cast("string").alias("result"),
            F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit(None).cast("long").alias("resolved_by")))

    return res | moved | Outputs(
        quarantined_products=quarantines,
        product_tracking=lambda: apply_status_change(moved["product_tracking"], db.product_statuses, status, as_of))


RESULT_CYCLE = [("Passed", "B-Ware"), ("B-Ware", "Quarantine"), ("Quarantine", "Waste"), ("Waste", "Passed")]


def qc_edit_commands(db) -> DataFrame:
    """Command table for K7: every QC row gets the next result in a fixed cycle and a note."""
    nxt = None
    for a, b in RESULT_CYCLE:
        nxt = F.when(c("inspection_result") == a, b) if nxt is None else nxt.when(c("inspection_result") == a, b)
    qc = db.product_quality_control
    res = qc.select(c("id").alias("qc_id"), "product_tracking_id",
                                             F.lit("inspection_result").alias("field_name"),
                                             c("inspection_result").alias("old_value"), nxt.alias("new_value"))
    notes = qc.select(c("id").alias("qc_id"), "product_tracking_id",
                                               F.lit("notes").alias("field_name"), c("notes").alias("old_value"),
                                               F.lit("rechecked").alias("new_value"))
    return res.unionByName(notes).select("*", F.lit("QC correction").alias("reason"),
                                         (F.lit(1) + c("qc_id") % 10).alias("user_id"))


SPEC_FIELDS = ["height_mm", "diameter_mm", "average_weight_g", "weight_buffer_g"]


class SpecError(ValueError):
    pass


def apply_print_specs(db, specs: DataFrame, as_of: str) -> Outputs:
    """K20 (specs): rows (sku_id, height_mm, diameter_mm, average_weight_g, weight_buffer_g, reason, changed_by)
    -> specs upserted by sku; every field audited (old 'None' on create, unchanged fields skipped).
    Sizes must be > 0, the buffer >= 0 and a reason given (checked before anything is written)."""
    bad = specs.where((c("height_mm") <= 0) | (c("diameter_mm") <= 0) | (c("average_weight_g") <= 0)
                      | (c("weight_buffer_g") < 0) | c("reason").isNull() | (F.trim(c("reason")) == "")
                      | c("changed_by").isNull()).limit(1).collect()
    if bad:
        raise SpecError(f"invalid print spec row: {bad[0].asDict()}")
    target = db.product_print_specs
    src = specs.select("sku_id", *[c(f).cast(target.schema[f].dataType).alias(f) for f in SPEC_FIELDS])
    old = target.select(c("sku_id").alias("_s"), *[c(f).alias(f"_o_{f}") for f in SPEC_FIELDS])
    j = specs.join(old, c("sku_id") == c("_s"), "left")
    changes = j.select(c("sku_id").alias("record_id"), "reason", "changed_by", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field_name"), c(f"_o_{f}").cast("string").alias("old_value"),
                 c(f).cast(target.schema[f].dataType).cast("string").alias("new_value"), F.lit(i).alias("seq"))
        for i, f in enumerate(SPEC_FIELDS)])).alias("ch")).select("record_id", "reason", "changed_by", "ch.*")
    audit = apply_field_changes(target, "product_print_specs", changes, as_of, _next_audit(db), update=False)
    return audit | Outputs(product_print_specs=lambda: C.merge_upsert(
        target, src, ["sku_id"], set_cols=SPEC_FIELDS, id_col=None)[0])


def spec_commands(db) -> DataFrame:
    """Command table for K20: each sku's average weight is re-calibrated to the mean measured QC weight of
    its units (sizes kept; skus without a spec get 100 x 50 mm and a 5 g buffer)."""
    meas = (db.product_quality_control.alias("q")
            .join(db.product_tracking.alias("t"), c("q.product_tracking_id") == c("t.id"))
            .groupBy(c("t.sku_id").alias("sku_id"))
            .agg(F.round(F.avg(c("q.weight_grams").cast("double")), 2).alias("avg_w")))
    sp = db.product_print_specs
    return (meas.join(sp, "sku_id", "left")
            .select("sku_id", F.coalesce(c("height_mm"), F.lit(100).cast("decimal(7,2)")).alias("height_mm"),
                    F.coalesce(c("diameter_mm"), F.lit(50).cast("decimal(7,2)")).alias("diameter_mm"),
                    c("avg_w").cast("decimal(7,2)").alias("average_weight_g"),
                    F.coalesce(c("weight_buffer_g"), F.lit(5).cast("decimal(4,2)")).alias("weight_buffer_g"),
                    F.lit("recalibrated from QC weights").alias("reason"), F.lit(1).cast("long").alias("changed_by")))


# ---------------------------------------------------------------------------
# Undo paths: K5 harvest undo, K8 remove from batch, K19 acclimatization and restore
# ---------------------------------------------------------------------------

def apply_harvest_undo(db, commands: DataFrame, as_of: str) -> Outputs:
    """K5 (undo): rows (harvest_id, user_id, reason) -> the harvest and its unit removed, the request back to
    Pending (audited, unchanged statuses skipped)."""
    C.check_unique(commands, ["harvest_id"])
    h = db.product_harvest.join(commands.select(c("harvest_id").alias("_h")), c("id") == c("_h"), "left_anti")
    t = db.product_tracking.join(commands.select(c("harvest_id").alias("_h")), c("harvest_id") == c("_h"), "left_anti")
    req = (commands.join(db.product_harvest.select(c("id").alias("_hid"), "request_id"), c("harvest_id") == c("_hid"))
           .join(db.product_requests.select(c("id").alias("_rid"), c("status").alias("_st")), c("request_id") == c("_rid")))
    changes = req.select(c("request_id").alias("record_id"), F.lit("status").alias("field_name"),
                         c("_st").alias("old_value"), F.lit("Pending").alias("new_value"), "reason",
                         c("user_id").alias("changed_by"))
    return apply_field_changes(db.product_requests, "product_requests", changes, as_of, _next_audit(db)) | Outputs(
        product_harvest=lambda: h, product_tracking=lambda: t)


def harvest_undo_commands(db) -> DataFrame:
    """Command table for K5 undo: the harvest of every unit that is still in the first stage is undone."""
    return db.product_tracking.where(c("current_stage_id") == 1).select("harvest_id").distinct().select(
        "harvest_id", F.lit(1).cast("long").alias("user_id"), F.lit("printed in error").alias("reason"))


def apply_remove_from_batch(db, commands: DataFrame, as_of: str) -> Outputs:
    """K8 (remove): rows (batch_product_id, product_tracking_id, user_id, reason) -> the batch link deleted with
    an audit row (DELETED No -> Yes) and the unit back to QMTreatmentApproval."""
    C.check_unique(commands, ["batch_product_id"])
    links = db.treatment_batch_products.join(commands.select(c("batch_product_id").alias("_b")), c("id") == c("_b"),
                                             "left_anti")
    audit = commands.select(F.lit("treatment_batch_products").alias("table_name"),
                            c("batch_product_id").alias("record_id"), F.lit("DELETED").alias("field_name"),
                            F.lit("No").alias("old_value"), F.lit("Yes").alias("new_value"), "reason",
                            c("user_id").alias("changed_by"), F.lit(as_of).cast("timestamp_ntz").alias("changed_at"))
    stage = _stage_id(db, "QMTreatmentApproval")
    cmd = (commands.withColumn("_k", F.lit(1)).join(F.broadcast(stage), "_k")
           .select("product_tracking_id", c("_stage").alias("new_stage_id"),
                   F.lit("Removed from treatment batch").alias("reason"), "user_id"))
    return apply_stage_change(db.product_tracking, cmd, as_of) | Outputs(
        treatment_batch_products=lambda: links,
        audit_log=lambda: C.assign_ids(audit, ["record_id"], C.next_id(db.audit_log), "id").select(*AUDIT_COLUMNS))


def remove_from_batch_commands(db) -> DataFrame:
    """Command table for K8 remove: every link of a batch still out for treatment."""
    tb = db.treatment_batches.where(c("status") == "Shipped").select(c("id").alias("_b"))
    return (db.treatment_batch_products.join(tb, c("batch_id") == c("_b"))
            .select(c("id").alias("batch_product_id"), "product_tracking_id", F.lit(1).cast("long").alias("user_id"),
                    F.lit("wrong batch").alias("reason")))


ACCL_COLUMNS = ["id", "filament_tracking_id", "moved_by", "moved_at", "ready_at", "status"]


def apply_acclimatize(db, commands: DataFrame, as_of: str) -> DataFrame:
    """K19 (acclimatize): rows (filament_tracking_id, user_id) -> new 'Acclimatizing' records (ready 2 days later)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = commands.select("filament_tracking_id", c("user_id").alias("moved_by"), now.alias("moved_at"),
                           X.ready_at(now).alias("ready_at"), F.lit("Acclimatizing").alias("status"))
    return C.assign_ids(rows, ["filament_tracking_id"], C.next_id(db.filament_acclimatization), "id").select(
        *ACCL_COLUMNS)


def acclimatize_commands(db) -> DataFrame:
    """Command table for K19 acclimatize: every PASS spool in storage."""
    from spooltrace.plans.materials import filaments_in_storage
    return filaments_in_storage(db).select(
        c("id").alias("filament_tracking_id"), F.lit(1).cast("long").alias("user_id")).distinct()


def apply_delete_acclimatization(db, commands: DataFrame, as_of: str) -> Outputs:
    """K19 (delete): rows (acclimatization_id, user_id, reason) -> the record deleted with three audit rows
    (status, moved_at, moved_by -> DELETED)."""
    a = db.filament_acclimatization
    j = a.join(commands, c("id") == c("acclimatization_id"))
    audit = j.select(c("id").alias("record_id"), "reason", c("user_id").alias("changed_by"), F.explode(F.array(
        F.struct(F.lit("status").alias("field_name"), _py_str(c("status")).alias("old_value"), F.lit(0).alias("seq")),
        F.struct(F.lit("moved_at").alias("field_name"), F.coalesce(_ts_text(c("moved_at")), F.lit("None")).alias("old_value"),
                 F.lit(1).alias("seq")),
        F.struct(F.lit("moved_by").alias("field_name"), _py_str(c("moved_by")).alias("old_value"), F.lit(2).alias("seq"))))
        .alias("ch")).select("record_id", "ch.field_name", "ch.old_value", F.lit("DELETED").alias("new_value"), "reason",
                             "changed_by", "ch.seq")
    res = apply_field_changes(a, "filament_acclimatization", audit, as_of, _next_audit(db), update=False)
    kept = a.join(commands.select(c("acclimatization_id").alias("_d")), c("id") == c("_d"), "left_anti")
    return res | Outputs(filament_acclimatization=lambda: kept)


def delete_acclimatization_commands(db) -> DataFrame:
    """Command table for K19 delete: every acclimatization that is not complete."""
    return db.filament_acclimatization.where(c("status") == "Acclimatizing").select(
        c("id").alias("acclimatization_id"), F.lit(1).cast("long").alias("user_id"), F.lit("entered twice").alias("reason"))


def apply_restore_mount(db, commands: DataFrame, as_of: str) -> Outputs:
    """K19 (restore): rows (mount_id, user_id, reason) -> the mount is 'In Use' again with its unmount fields
    cleared; each field that changes is audited."""
    m = db.filament_mounting.join(commands, c("id") == c("mount_id"))
    ch = m.select(c("id").alias("record_id"), "reason", c("user_id").alias("changed_by"), F.explode(F.array(
        F.struct(F.lit("unmounted_at").alias("field_name"), _ts_text(c("unmounted_at")).alias("old_value"),
                 F.lit(None).cast("string").alias("new_value"), F.lit(0).alias("seq")),
        F.struct(F.lit("unmounted_by").alias("field_name"), c("unmounted_by").cast("string").alias("old_value"),
                 F.lit(None).cast("string").alias("new_value"), F.lit(1).alias("seq")),
        F.struct(F.lit("status").alias("field_name"), c("status").alias("old_value"), F.lit("In Use").alias("new_value"),
                 F.lit(2).alias("seq")))).alias("x")).select("record_id", "reason", "changed_by", "x.*")
    return apply_field_changes(db.filament_mounting, "filament_mounting", ch, as_of, _next_audit(db))


def restore_mount_commands(db) -> DataFrame:
    """Command table for K19 restore: every unmounted mount."""
    return db.filament_mounting.where(c("unmounted_at").isNotNull()).select(
        c("id").alias("mount_id"), F.lit(1).cast("long").alias("user_id"), F.lit("unmounted by mistake").alias("reason"))


SKU_COLUMNS = ["id", "product_type_id", "sku", "name", "is_serialized", "is_bundle", "pack_qty", "is_active"]


def apply_sku_create(db, rows: DataFrame) -> Outputs:
    """K20 (create): rows (sku, name, product_type_id, is_serialized, is_bundle, pack_qty) -> new active skus with
    trimmed code and name, pack quantity 1 unless a bundle; blank code/name, non-positive pack quantity,
    existing or repeated codes are rejected into a report."""
    r = rows.withColumn("sku", F.trim(c("sku"))).withColumn("name", F.trim(c("name")))
    why = (F.when(_blank_col(c("sku")) | _blank_col(c("name")), F.lit("SKU and name are required."))
           .when(c("pack_qty") <= 0, F.lit("pack_qty must be > 0.")))
    checked = r.withColumn("why", why)
    dup = checked.where(c("why").isNull()).groupBy("sku").count().where(c("count") > 1).select("sku")
    existing = db.product_skus.select("sku")
    checked = (checked.join(existing.withColumn("_exists", F.lit(True)), "sku", "left")
               .join(dup.withColumn("_dup", F.lit(True)), "sku", "left")
               .withColumn("why", F.coalesce(c("why"), F.when(c("_exists"), F.concat(F.lit("SKU '"), c("sku"),
                                                                                       F.lit("' already exists.")))
                                             .when(c("_dup"), F.lit("SKU repeated in the request.")))))
    ok = checked.where(c("why").isNull()).select(
        "product_type_id", "sku", "name", "is_serialized", "is_bundle",
        F.when(c("is_bundle"), c("pack_qty")).otherwise(F.lit(1)).cast("long").alias("pack_qty"),
        F.lit(True).alias("is_active"))
    new = once(lambda: C.assign_ids(ok, ["sku"], C.next_id(db.product_skus), "id").select(*SKU_COLUMNS))
    return Outputs(product_skus=lambda: db.product_skus.unionByName(new()), new_skus=new,
                   rejected=lambda: checked.where(c("why").isNotNull()).select("sku", "why"))


def _blank_col(col):
    return col.isNull() | (col == "")


def sku_create_commands(db) -> DataFrame:
    """Command table for K20 create: one sku per part brand (bundles for every third brand), plus a re-sent
    existing code and a row without a name."""
    b = db.src("part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    brands = b.select(F.concat(F.lit(" NEW-"), F.regexp_replace(c("p_brand"), "[^A-Za-z0-9]", ""), F.lit(" ")).alias("sku"),
                      F.concat(F.lit("Line "), c("p_brand")).alias("name"),
                      (F.lit(1) + c("k") % 4).cast("long").alias("product_type_id"), F.lit(True).alias("is_serialized"),
                      (c("k") % 3 == 0).alias("is_bundle"), (F.lit(1) + c("k") % 5).cast("long").alias("pack_qty"))
    extra = db.spark.createDataFrame(
        [(" GEB-CSmTD ", "TriDock again", 4, False, False, 1), ("NEW-NONAME", "  ", 1, True, False, 1)],
        "sku STRING, name STRING, product_type_id BIGINT, is_serialized BOOLEAN, is_bundle BOOLEAN, pack_qty BIGINT")
    return brands.unionByName(extra)


def apply_sku_update(db, changes: DataFrame, as_of: str) -> Outputs:
    """K20 (update): audited field changes on skus (K3 rules)."""
    return apply_field_changes(db.product_skus, "product_skus", changes, as_of, _next_audit(db))


def sku_activity_changes(db) -> DataFrame:
    """Command table for K20 update: a sku is active exactly when it has pending requests."""
    pending = (db.product_requests.where(c("status") == "Pending").groupBy("sku_id").count()
               .select(c("sku_id").alias("_s"), (c("count") > 0).alias("_act")))
    s = db.product_skus.join(pending, c("id") == c("_s"), "left")
    return s.select(c("id").alias("record_id"), F.lit("is_active").alias("field_name"),
                    c("is_active").cast("string").alias("old_value"),
                    F.coalesce(c("_act"), F.lit(False)).cast("string").alias("new_value"),
                    F.lit("activity review").alias("reason"), F.lit(1).cast("long").alias("changed_by"))
