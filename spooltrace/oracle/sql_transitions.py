"""Oracle SQL (DuckDB) for K1, K2, K15, X1, A7."""

from spooltrace.oracle.prelude import AS_OF_SQL

TRACK_COLS = ["id", "harvest_id", "product_id", "product_type_id", "sku_id", "current_status_id", "previous_stage_id",
              "current_stage_id", "location_id", "last_updated_at", "product_code", "was_tech_transfer"]


def _stage_change(cmd_sql: str) -> tuple[str, str]:
    cte = f", cmd AS ({cmd_sql})"
    sel = []
    for x in TRACK_COLS:
        if x == "previous_stage_id":
            sel.append("CASE WHEN c.product_tracking_id IS NOT NULL THEN t.current_stage_id ELSE t.previous_stage_id END AS previous_stage_id")
        elif x == "current_stage_id":
            sel.append("CASE WHEN c.product_tracking_id IS NOT NULL THEN c.new_stage_id ELSE t.current_stage_id END AS current_stage_id")
        elif x == "location_id":
            sel.append("CASE WHEN c.product_tracking_id IS NOT NULL AND c.location_id IS NOT NULL THEN c.location_id ELSE t.location_id END AS location_id")
        elif x == "last_updated_at":
            sel.append(f"CASE WHEN c.product_tracking_id IS NOT NULL THEN {AS_OF_SQL} ELSE t.last_updated_at END AS last_updated_at")
        else:
            sel.append(f"t.{x}")
    tracking = cte + f" SELECT {', '.join(sel)} FROM x_product_tracking t LEFT JOIN cmd c ON c.product_tracking_id = t.id"
    history = cte + f""" SELECT CAST(ROW_NUMBER() OVER (ORDER BY t.id) AS BIGINT) AS id, t.id AS product_tracking_id,
  t.current_stage_id AS from_stage_id, c.new_stage_id AS to_stage_id, c.reason, c.user_id AS changed_by, {AS_OF_SQL} AS changed_at
FROM x_product_tracking t JOIN cmd c ON c.product_tracking_id = t.id"""
    return tracking, history


# several moves a unit: a step starts where the one before it ended
K1_BASE = """
, cmd AS (SELECT t.id AS unit, n.seq, 1 + (t.id + 5 * n.seq) % 14 AS to_stage, 'bulk move ' || CAST(n.seq AS VARCHAR) AS reason,
   1 + (t.id + n.seq) % 10 AS who, CASE WHEN (t.id + n.seq) % 2 = 0 THEN 1 + (t.id + n.seq) % 25 END AS place, t.current_stage_id AS at_first
   FROM x_product_tracking t JOIN (VALUES (1), (2), (3)) n(seq) ON n.seq <= 1 + t.id % 3),
walk AS (SELECT *, COALESCE(lag(to_stage) OVER (PARTITION BY unit ORDER BY seq), at_first) AS from_stage,
   row_number() OVER (PARTITION BY unit ORDER BY seq DESC) AS from_end FROM cmd),
places AS (SELECT unit, arg_max(place, seq) AS place FROM cmd WHERE place IS NOT NULL GROUP BY unit)
"""
K1_TRACK = K1_BASE + f"""
SELECT t.* REPLACE (w.from_stage AS previous_stage_id, w.to_stage AS current_stage_id, COALESCE(p.place, t.location_id) AS location_id,
  {AS_OF_SQL} AS last_updated_at)
FROM x_product_tracking t JOIN walk w ON w.unit = t.id AND w.from_end = 1 LEFT JOIN places p ON p.unit = t.id"""
K1_HIST = K1_BASE + f"""
SELECT CAST(row_number() OVER (ORDER BY unit, seq) AS BIGINT) AS id, unit AS product_tracking_id, from_stage AS from_stage_id,
  to_stage AS to_stage_id, reason, who AS changed_by, {AS_OF_SQL} AS changed_at FROM walk"""
EXPIRY_CMD = f"""SELECT pt.id AS product_tracking_id, (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'Expired') AS new_stage_id,
  'Auto-expired after 1 year' AS reason, CAST(1 AS BIGINT) AS user_id, CAST(NULL AS BIGINT) AS location_id
FROM x_product_tracking pt JOIN x_product_harvest ph ON pt.harvest_id = ph.id JOIN x_lifecycle_stages ls ON pt.current_stage_id = ls.id
WHERE ls.stage_code <> 'Expired' AND ph.print_date < {AS_OF_SQL} - INTERVAL 1 YEAR"""

_ex_t, _ex_h = _stage_change(EXPIRY_CMD)

STATUS = f"""
, cmd AS (SELECT t.id AS unit, n.seq, ['Pending', 'A-Ware', 'B-Ware', 'In Quarantine', 'Waste'][(t.id + n.seq) % 5 + 1] AS status_name
   FROM x_product_tracking t JOIN (VALUES (1), (2)) n(seq) ON n.seq <= 1 + t.id % 2),
final AS (SELECT unit, arg_max(status_name, seq) AS status_name FROM cmd GROUP BY unit),
ids AS (SELECT status_name, min(id) AS sid FROM x_product_statuses GROUP BY status_name)
SELECT t.* REPLACE (i.sid AS current_status_id, {AS_OF_SQL} AS last_updated_at)
FROM x_product_tracking t JOIN final f ON f.unit = t.id JOIN ids i ON i.status_name = f.status_name"""


STG_COLS = ["product_id", "filament_id", "printer", "operator_harvest", "date_harvest", "product", "storage",
            "status_quality_check", "second_rate_goods", "prozess_step", "operater_quality_check", "date_of_quality_check",
            "weight_check_g", "pressure_drop_check_mbar", "visual_check", "comment", "transfer_id",
            "operator_visual_check_incoming_goods", "date_of_visual_check_incoming_goods", "visual_check_1",
            "surface_treatment", "sterilization"]
PROFILE = ("SELECT column_name, null_count, (SELECT CAST(count(*) AS BIGINT) FROM x_stg_excel_data) AS row_count, "
           f"CAST({len(STG_COLS)} AS BIGINT) AS column_count FROM ("
           + " UNION ALL ".join(f"SELECT '{x}' AS column_name, CAST(count(*) - count({x}) AS BIGINT) AS null_count "
                                f"FROM x_stg_excel_data" for x in STG_COLS)
           + ") z ORDER BY null_count DESC, column_name LIMIT 20")

SQL = {
    "apply_stage_change": K1_TRACK,
    "apply_stage_change_history": K1_HIST,
    "apply_status_change": STATUS,
    "apply_expiry": _ex_t,
    "apply_expiry_history": _ex_h,
    "staging_profile": PROFILE,
}


def _tracking_select(stage_expr: str, status_expr: str, touched: str) -> str:
    sel = []
    for x in TRACK_COLS:
        if x == "previous_stage_id":
            sel.append(f"CASE WHEN {touched} THEN t.current_stage_id ELSE t.previous_stage_id END AS previous_stage_id")
        elif x == "current_stage_id":
            sel.append(f"{stage_expr} AS current_stage_id")
        elif x == "current_status_id":
            sel.append(f"{status_expr} AS current_status_id")
        elif x == "last_updated_at":
            sel.append(f"CASE WHEN {touched} THEN {AS_OF_SQL} ELSE t.last_updated_at END AS last_updated_at")
        else:
            sel.append(f"t.{x}")
    return ", ".join(sel)


K3_CMD = """
, cmd AS (SELECT f.id AS record_id, e.seq, e.field_name, 1 + f.id % 10 AS changed_by,
   CASE e.field_name WHEN 'weight_grams' THEN CAST(f.weight_grams AS VARCHAR) WHEN 'qc_result' THEN f.qc_result
     ELSE CAST(f.location_id AS VARCHAR) END AS at_first,
   CASE e.seq WHEN 4 THEN CASE WHEN f.qc_result = 'PASS' THEN 'FAIL' ELSE 'PASS' END
     WHEN 5 THEN CAST(1 + (f.id + 3) % 25 AS VARCHAR)
     ELSE CAST(CAST(f.weight_grams + 5.5 - CASE WHEN e.seq = 3 THEN f.id % 4 ELSE 0 END AS DECIMAL(10,2)) AS VARCHAR) END AS new_value
   FROM x_filaments f, (VALUES (1, 'weight_grams'), (2, 'weight_grams'), (3, 'weight_grams'), (4, 'qc_result'), (5, 'location_id'))
     e(seq, field_name)),
walk AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN at_first ELSE lag(new_value) OVER w END AS old_value
   FROM cmd WINDOW w AS (PARTITION BY record_id, field_name ORDER BY seq)),
steps AS (SELECT *, 'inventory correction' AS reason FROM walk WHERE NOT (CASE WHEN field_name = 'weight_grams'
   THEN round(TRY_CAST(old_value AS DOUBLE), 5) IS NOT DISTINCT FROM round(TRY_CAST(new_value AS DOUBLE), 5)
   ELSE COALESCE(old_value, 'None') = COALESCE(new_value, 'None') END)),
eff AS (SELECT record_id, field_name, arg_max(new_value, seq) AS new_value FROM steps GROUP BY record_id, field_name)
"""

K3_TARGET = K3_CMD + """
SELECT f.id, f.filament_id, f.serial_number, f.lot_number,
  CASE WHEN el.record_id IS NOT NULL THEN CAST(el.new_value AS BIGINT) ELSE f.location_id END AS location_id,
  CASE WHEN ew.record_id IS NOT NULL THEN CAST(ew.new_value AS DECIMAL(10,2)) ELSE f.weight_grams END AS weight_grams,
  f.received_at, f.received_by,
  CASE WHEN eq.record_id IS NOT NULL THEN eq.new_value ELSE f.qc_result END AS qc_result
FROM x_filaments f
LEFT JOIN eff ew ON ew.record_id = f.id AND ew.field_name = 'weight_grams'
LEFT JOIN eff eq ON eq.record_id = f.id AND eq.field_name = 'qc_result'
LEFT JOIN eff el ON el.record_id = f.id AND el.field_name = 'location_id'"""

K3_AUDIT = K3_CMD + f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY record_id, field_name, seq) AS BIGINT) AS id, 'filaments' AS table_name, record_id, field_name,
  COALESCE(old_value, 'None') AS old_value, COALESCE(new_value, 'None') AS new_value, reason, changed_by, {AS_OF_SQL} AS changed_at
FROM steps"""


def _b36(n: str) -> str:
    d = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"

    def dig(x: str) -> str:
        return f"substr({d}, CAST({x} AS INTEGER) + 1, 1)"
    return (f"(CASE WHEN {n} < 36 THEN {dig(n)} WHEN {n} < 1296 THEN {dig(f'{n} // 36')} || {dig(f'{n} % 36')} "
            f"WHEN {n} < 46656 THEN {dig(f'{n} // 1296')} || {dig(f'({n} // 36) % 36')} || {dig(f'{n} % 36')} "
            f"ELSE {dig(f'{n} // 46656')} || {dig(f'({n} // 1296) % 36')} || {dig(f'({n} // 36) % 36')} || {dig(f'{n} % 36')} END)")


K4 = f"""
, cmd AS (SELECT CAST(o_orderkey AS BIGINT) AS command_id, CAST(1 + o_custkey % 10 AS BIGINT) AS requested_by,
   CAST(1 + o_custkey % 7 AS BIGINT) AS sku_id, CAST(1 + o_orderkey % 4 AS INTEGER) AS quantity, o_orderkey % 19 = 0 AS is_tech_transfer,
   ROW_NUMBER() OVER (ORDER BY o_orderkey) AS batch_number FROM orders),
cmd2 AS (SELECT *, lpad(CAST(year({AS_OF_SQL}) % 100 AS VARCHAR), 2, '0') ||
   CASE WHEN length({_b36('batch_number')}) < 2 THEN lpad({_b36('batch_number')}, 2, '0') ELSE {_b36('batch_number')} END AS lot_number
   FROM cmd),
rows AS (SELECT c.*, n FROM cmd2 c, range(1, c.quantity + 1) r(n))
SELECT CAST((SELECT max(id) FROM x_product_requests) + ROW_NUMBER() OVER (ORDER BY command_id, n) AS BIGINT) AS id,
  requested_by, sku_id, lot_number, 'Pending' AS status, {AS_OF_SQL} AS requested_at, CAST(NULL AS VARCHAR) AS notes, is_tech_transfer
FROM rows"""

from spooltrace.oracle.sql_operations import SQL as _G  # noqa: E402

K12_CMD = f"""
, elig AS ({_G['qm_bulk_eligible'].strip()}),
dec AS (SELECT pid, result, CASE WHEN pid % 13 = 0 THEN 'decline' WHEN approval_type = 'Post-Harvest Approval' THEN 'treatment'
   ELSE 'sales' END AS decision, CASE WHEN pid % 2 = 0 THEN 'batch review' ELSE '' END AS reason FROM elig),
cmd AS (SELECT pid AS product_tracking_id,
   CASE decision WHEN 'treatment' THEN (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'QMTreatmentApproval')
     WHEN 'sales' THEN CASE WHEN result = 'Passed' THEN (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'QMSalesApproval')
       ELSE (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'Internal Use') END
     ELSE (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'Disposed') END AS new_stage_id,
   CASE decision WHEN 'treatment' THEN 'QM Approved for Treatment'
     WHEN 'sales' THEN CASE WHEN result = 'Passed' THEN 'QM Approved for Sales' ELSE 'QM Approved for Internal Use' END
     ELSE 'Declined by QM: failed review' END
   || CASE WHEN decision <> 'decline' AND trim(reason) <> '' THEN ': ' || trim(reason) ELSE '' END AS reason,
   CAST(1 AS BIGINT) AS user_id, decision FROM dec)
"""

K12_TRACK = K12_CMD + f"""
SELECT {_tracking_select('CASE WHEN c.product_tracking_id IS NOT NULL THEN c.new_stage_id ELSE t.current_stage_id END',
                         "CASE WHEN c.decision = 'decline' THEN (SELECT min(id) FROM x_product_statuses WHERE status_name = 'Waste') ELSE t.current_status_id END",
                         'c.product_tracking_id IS NOT NULL')}
FROM x_product_tracking t LEFT JOIN cmd c ON c.product_tracking_id = t.id"""

K12_HIST = K12_CMD + f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY t.id) AS BIGINT) AS id, t.id AS product_tracking_id, t.current_stage_id AS from_stage_id,
  c.new_stage_id AS to_stage_id, c.reason, c.user_id AS changed_by, {AS_OF_SQL} AS changed_at
FROM x_product_tracking t JOIN cmd c ON c.product_tracking_id = t.id"""

K13 = f"""
SELECT CAST((SELECT max(id) FROM x_product_investigations) + ROW_NUMBER() OVER (ORDER BY product_tracking_id, 'DEV-Q' || CAST(id AS VARCHAR)) AS BIGINT) AS id,
  product_tracking_id, 'Under Investigation' AS status, 'DEV-Q' || CAST(id AS VARCHAR) AS deviation_number,
  'escalated from quarantine' AS comment, quarantined_by AS created_by, {AS_OF_SQL} AS created_at,
  CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS BIGINT) AS resolved_by
FROM x_quarantined_products WHERE quarantine_status = 'Active'"""

K10_CMD = f"""
, cmd AS (SELECT id AS product_tracking_id, current_stage_id AS from_stage_id, 'Ad-Hoc' AS source, 1 + id % 10 AS quarantined_by,
   'suspect lot ' || CAST(id % 97 AS VARCHAR) AS reason, [1 + id % 19, 1 + id % 19, 1 + id % 5] AS reason_ids
   FROM x_product_tracking WHERE id NOT IN (SELECT product_tracking_id FROM x_quarantined_products WHERE quarantine_status = 'Active')),
newq AS (SELECT CAST((SELECT max(id) FROM x_quarantined_products) + ROW_NUMBER() OVER (ORDER BY product_tracking_id) AS BIGINT) AS id, *
   FROM cmd)
"""

K10_ROWS = K10_CMD + f"""
SELECT id, product_tracking_id, from_stage_id, source, CAST(NULL AS BIGINT) AS location_id, {AS_OF_SQL} AS quarantine_date,
  quarantined_by, nullif(reason, '') AS quarantine_reason, 'Active' AS quarantine_status, CAST(NULL AS VARCHAR) AS result,
  CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS BIGINT) AS resolved_by FROM newq"""

K10_LINKS = K10_CMD + """
, links AS (SELECT DISTINCT id AS quarantine_id, unnest(reason_ids) AS reason_id FROM newq)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY quarantine_id, reason_id) AS BIGINT) AS id, quarantine_id, reason_id FROM links"""



def _history(base: str, rows: str, stage: str, reason: str, who: str) -> str:
    """One history row per unit of ``rows`` (product_tracking_id): from the unit's stage to ``stage``."""
    return base + f"""
SELECT CAST(row_number() OVER (ORDER BY t.id) AS BIGINT) AS id, t.id AS product_tracking_id, t.current_stage_id AS from_stage_id,
  {stage} AS to_stage_id, {reason} AS reason, CAST({who} AS BIGINT) AS changed_by, {AS_OF_SQL} AS changed_at
FROM x_product_tracking t JOIN {rows} z ON z.product_tracking_id = t.id"""


def _stage(code: str) -> str:
    return f"(SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = '{code}')"


K10_HIST = _history(K10_CMD, "cmd", _stage("Quarantine"), "'Ad-Hoc Quarantine: ' || z.reason", "z.quarantined_by")
K10_TRACK = K10_CMD + f"""
SELECT {_tracking_select("CASE WHEN c.product_tracking_id IS NOT NULL THEN (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'Quarantine') ELSE t.current_stage_id END",
                         "CASE WHEN c.product_tracking_id IS NOT NULL THEN (SELECT min(id) FROM x_product_statuses WHERE status_name = 'In Quarantine') ELSE t.current_status_id END",
                         'c.product_tracking_id IS NOT NULL')}
FROM x_product_tracking t LEFT JOIN cmd c ON c.product_tracking_id = t.id"""

K11_CMD = f"""
, cmd AS (SELECT product_tracking_id, ['Passed', 'B-Ware', 'Waste'][product_tracking_id % 3 + 1] AS resolution,
   CASE WHEN product_tracking_id % 2 = 0 THEN 'checked' END AS comment, 1 + product_tracking_id % 10 AS resolved_by
   FROM (SELECT DISTINCT product_tracking_id FROM x_product_investigations WHERE status = 'Under Investigation')),
cmd2 AS (SELECT *, CASE resolution WHEN 'Passed' THEN 'Cleared A-Ware' WHEN 'B-Ware' THEN 'Cleared B-Ware' ELSE 'Disposed' END AS inv_status,
   '[Resolution ' || strftime({AS_OF_SQL}, '%Y-%m-%d %H:%M') || ']: ' || resolution ||
   CASE WHEN comment IS NOT NULL AND comment <> '' THEN ' — ' || comment ELSE '' END AS note FROM cmd)
"""

K11_INV = K11_CMD + f"""
SELECT i.id, i.product_tracking_id, CASE WHEN c.product_tracking_id IS NOT NULL THEN c.inv_status ELSE i.status END AS status,
  i.deviation_number,
  CASE WHEN c.product_tracking_id IS NOT NULL THEN CASE WHEN i.comment IS NULL OR i.comment = '' THEN c.note
       ELSE i.comment || chr(13) || c.note END ELSE i.comment END AS comment,
  i.created_by, i.created_at, CASE WHEN c.product_tracking_id IS NOT NULL THEN {AS_OF_SQL} ELSE i.resolved_at END AS resolved_at,
  CASE WHEN c.product_tracking_id IS NOT NULL THEN c.resolved_by ELSE i.resolved_by END AS resolved_by
FROM x_product_investigations i LEFT JOIN cmd2 c ON c.product_tracking_id = i.product_tracking_id AND i.status = 'Under Investigation'"""

K11_Q = K11_CMD + f"""
SELECT q.id, q.product_tracking_id, q.from_stage_id, q.source, q.location_id, q.quarantine_date, q.quarantined_by, q.quarantine_reason,
  CASE WHEN c.product_tracking_id IS NOT NULL THEN CASE WHEN c.inv_status = 'Disposed' THEN 'Disposed' ELSE 'Released' END
       ELSE q.quarantine_status END AS quarantine_status,
  CASE WHEN c.product_tracking_id IS NOT NULL THEN c.resolution ELSE q.result END AS result,
  CASE WHEN c.product_tracking_id IS NOT NULL THEN {AS_OF_SQL} ELSE q.resolved_at END AS resolved_at,
  CASE WHEN c.product_tracking_id IS NOT NULL THEN c.resolved_by ELSE q.resolved_by END AS resolved_by
FROM x_quarantined_products q LEFT JOIN cmd2 c ON c.product_tracking_id = q.product_tracking_id AND q.quarantine_status = 'Active'"""

K11_MOVES = K11_CMD + """
, moves AS (SELECT c.product_tracking_id, c.resolution, ns.id AS new_stage_id FROM cmd c
   JOIN x_product_tracking t ON t.id = c.product_tracking_id LEFT JOIN x_lifecycle_stages cs ON cs.id = t.current_stage_id
   JOIN (SELECT stage_name, min(id) AS id FROM x_lifecycle_stages GROUP BY stage_name) ns ON ns.stage_name =
     CASE WHEN c.resolution = 'Waste' THEN 'Discarded Product'
          WHEN cs.stage_name = 'Harvest QC Complete; Pending Storage' THEN 'QM Approved for Treatment; Pending Treatment'
          WHEN c.resolution = 'B-Ware' AND cs.stage_name = 'Returned / Post-Treatment QC; Pending Storage' THEN 'Internal Use/Client'
          WHEN cs.stage_name = 'Returned / Post-Treatment QC; Pending Storage' THEN 'QM Approved For Sales; Pending Sales'
          ELSE cs.stage_name END)
"""

K11_HIST = _history(K11_MOVES, "(SELECT m.*, c.resolved_by FROM moves m JOIN cmd c ON c.product_tracking_id = m.product_tracking_id)",
                    "z.new_stage_id", "'QM resolution: ' || z.resolution", "z.resolved_by")

K11_TRACK = K11_MOVES + f"""
, st AS (SELECT c.product_tracking_id, s.id AS sid FROM cmd c JOIN x_product_statuses s ON s.status_name =
   CASE c.resolution WHEN 'Passed' THEN 'A-Ware' WHEN 'B-Ware' THEN 'B-Ware' WHEN 'Quarantine' THEN 'In Quarantine'
        WHEN 'In Quarantine' THEN 'In Quarantine' WHEN 'Waste' THEN 'Waste' ELSE 'Pending' END)
SELECT {_tracking_select('CASE WHEN m.product_tracking_id IS NOT NULL THEN m.new_stage_id ELSE t.current_stage_id END',
                         'CASE WHEN s.product_tracking_id IS NOT NULL THEN s.sid ELSE t.current_status_id END',
                         'm.product_tracking_id IS NOT NULL')}
FROM x_product_tracking t LEFT JOIN moves m ON m.product_tracking_id = t.id LEFT JOIN st s ON s.product_tracking_id = t.id"""

SQL.update({
    "apply_field_changes": K3_TARGET,
    "apply_field_changes_audit": K3_AUDIT,
    "apply_requests": K4,
    "apply_qm_decision": K12_TRACK,
    "apply_qm_decision_history": K12_HIST,
    "apply_investigation": K13,
    "apply_quarantine": K10_ROWS,
    "apply_quarantine_reasons": K10_LINKS,
    "apply_quarantine_tracking": K10_TRACK,
    "apply_quarantine_history": K10_HIST,
    "apply_quarantine_resolution_history": K11_HIST,
    "apply_quarantine_resolution": K11_INV,
    "apply_quarantine_resolution_quarantine": K11_Q,
    "apply_quarantine_resolution_tracking": K11_TRACK,
})

from spooltrace.oracle.sql_materials import SQL as _M  # noqa: E402

# request_mount_candidates is itself a CTE chain (", req AS (...), cand AS (...) SELECT ..."); wrap its final select
_rmc = _M["request_mount_candidates"].strip()
_rmc_ctes, _rmc_select = _rmc.rsplit("SELECT r.id AS request_id", 1)
K5_BASE = _rmc_ctes.replace("cand AS (", "cand0 AS (").replace("FROM cand WHERE cand.request_id", "FROM cand0 WHERE cand0.request_id").replace(
    "LEFT JOIN cand b ON", "LEFT JOIN cand0 b ON") + ", rmc AS (SELECT r.id AS request_id" + _rmc_select.replace(
    "FROM cand WHERE cand.request_id", "FROM cand0 WHERE cand0.request_id").replace("LEFT JOIN cand b ON", "LEFT JOIN cand0 b ON") + f"""),
cmd AS (SELECT m.request_id, m.best_mount_id AS filament_mount_id, pr.requested_by AS printed_by,
   (SELECT min(id) FROM x_lids WHERE qc_result = 'PASS' AND serial_number <> 'LEGACY_LID') AS lid_id,
   (SELECT min(id) FROM x_seals WHERE qc_result = 'PASS' AND serial_number <> 'LEGACY_SEAL') AS seal_id,
   pr.sku_id, pr.lot_number, pr.is_tech_transfer
   FROM rmc m JOIN x_product_requests pr ON pr.id = m.request_id WHERE m.best_mount_id IS NOT NULL),
seq0 AS (SELECT q.lot_number AS lot, max(TRY_CAST(substr(t.product_code, length(q.lot_number) + 1) AS BIGINT)) AS mx
   FROM x_product_requests q JOIN x_product_harvest h ON h.request_id = q.id JOIN x_product_tracking t ON t.harvest_id = h.id
   WHERE starts_with(t.product_code, q.lot_number) GROUP BY 1),
units AS (SELECT c.*,
   CAST((SELECT max(id) FROM x_product_harvest) + ROW_NUMBER() OVER (ORDER BY c.request_id) AS BIGINT) AS harvest_id,
   CAST((SELECT max(id) FROM x_product_tracking) + ROW_NUMBER() OVER (ORDER BY c.request_id) AS BIGINT) AS id,
   CAST(COALESCE((SELECT max(product_id) FROM x_product_tracking) + 1, 1000000) + ROW_NUMBER() OVER (ORDER BY c.request_id) - 1 AS BIGINT) AS product_id,
   c.lot_number || printf('%04d', COALESCE(s.mx, 0) + ROW_NUMBER() OVER (PARTITION BY c.lot_number ORDER BY c.request_id)) AS product_code
   FROM cmd c LEFT JOIN seq0 s ON s.lot = c.lot_number)
"""

K5_TRACK = K5_BASE + f"""
SELECT u.id, u.harvest_id, u.product_id, sk.product_type_id, u.sku_id,
  (SELECT min(id) FROM x_product_statuses WHERE status_name = 'Pending') AS current_status_id, CAST(NULL AS BIGINT) AS previous_stage_id,
  CAST(1 AS BIGINT) AS current_stage_id, CAST(NULL AS BIGINT) AS location_id, {AS_OF_SQL} AS last_updated_at, u.product_code,
  u.is_tech_transfer AS was_tech_transfer
FROM units u LEFT JOIN x_product_skus sk ON sk.id = u.sku_id"""

K5_USAGE = K5_BASE + f"""
, m AS (SELECT u.id AS product_tracking_id, u.harvest_id, 'Lid' AS material_type, l.serial_number AS lot_number, u.printed_by
   FROM units u JOIN x_lids l ON l.id = u.lid_id JOIN x_seals s ON s.id = u.seal_id
   UNION ALL SELECT u.id, u.harvest_id, 'Seal', s.serial_number, u.printed_by
   FROM units u JOIN x_lids l ON l.id = u.lid_id JOIN x_seals s ON s.id = u.seal_id)
SELECT CAST((SELECT max(id) FROM x_material_usage) + ROW_NUMBER() OVER (ORDER BY product_tracking_id, material_type) AS BIGINT) AS id,
  product_tracking_id, harvest_id, material_type, lot_number, CAST(1 AS DECIMAL(10,2)) AS used_quantity, {AS_OF_SQL} AS used_at,
  printed_by AS used_by, CAST(NULL AS VARCHAR) AS reason FROM m"""

K5_REQ = K5_BASE + """
SELECT r.id, r.requested_by, r.sku_id, r.lot_number, CASE WHEN c.request_id IS NOT NULL THEN 'Fulfilled' ELSE r.status END AS status,
  r.requested_at, r.notes, r.is_tech_transfer FROM x_product_requests r LEFT JOIN cmd c ON c.request_id = r.id"""

C7 = K5_BASE + """
, mx AS (SELECT lot, max(mx) AS mx FROM (SELECT lot, mx FROM seq0 UNION ALL
   SELECT lot_number, TRY_CAST(substr(product_code, length(lot_number) + 1) AS BIGINT) FROM units) GROUP BY lot)
SELECT l.lot_number, CAST(COALESCE(mx.mx, 0) + 1 AS BIGINT) AS next_seq
FROM (SELECT DISTINCT lot_number FROM x_product_requests WHERE status = 'Pending') l LEFT JOIN mx ON mx.lot = l.lot_number"""

_G4 = _G["printed_pending_qc"]
K6_BASE = f"""
, g4 AS ({_G4}),
cmd AS (SELECT DISTINCT id AS product_tracking_id, 1 + id % 10 AS inspected_by, CAST(500 + (id * 31) % 600 AS DECIMAL(6,2)) AS weight_grams,
   CAST((id * 13) % 9 AS DECIMAL(6,3)) AS pressure_drop, id % 8 <> 0 AS visual_pass,
   CASE WHEN id % 11 = 0 THEN 'Quarantine'
        WHEN CAST((id * 13) % 9 AS DOUBLE) >= 6 THEN 'Waste'
        WHEN CAST(500 + (id * 31) % 600 AS DOUBLE) > 0 AND (CAST(500 + (id * 31) % 600 AS DOUBLE) < COALESCE(CAST(average_weight_g AS DOUBLE), 0) - COALESCE(CAST(weight_buffer_g AS DOUBLE), 0)
          OR CAST(500 + (id * 31) % 600 AS DOUBLE) > COALESCE(CAST(average_weight_g AS DOUBLE), 0) + COALESCE(CAST(weight_buffer_g AS DOUBLE), 0)) THEN 'B-Ware'
        ELSE 'Passed' END AS inspection_result,
   CASE WHEN id % 11 = 0 THEN 'held for review' END AS notes, [1 + id % 19, 1 + id % 19] AS reason_ids FROM g4),
qc AS (SELECT CAST((SELECT max(id) FROM x_product_quality_control) + ROW_NUMBER() OVER (ORDER BY product_tracking_id) AS BIGINT) AS id, *
   FROM cmd),
unit AS (SELECT t.id AS tid, t.harvest_id, h.filament_mounting_id AS mount_id, f.lot_number
   FROM x_product_tracking t JOIN x_product_harvest h ON h.id = t.harvest_id JOIN x_filament_mounting fm ON fm.id = h.filament_mounting_id
   JOIN x_filaments f ON f.id = fm.filament_tracking_id),
used AS (SELECT q.*, u.harvest_id, u.mount_id, u.lot_number FROM qc q JOIN unit u ON u.tid = q.product_tracking_id)
"""

K6_QC = K6_BASE + f"""
SELECT id, product_tracking_id, inspected_by, {AS_OF_SQL} AS inspected_at, weight_grams, pressure_drop, visual_pass, inspection_result, notes
FROM qc"""

K6_REASONS = K6_BASE + """
, l AS (SELECT DISTINCT id AS qc_id, unnest(reason_ids) AS reason_id FROM qc)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY qc_id, reason_id) AS BIGINT) AS id, qc_id, reason_id FROM l"""

K6_USAGE = K6_BASE + f"""
SELECT CAST((SELECT max(id) FROM x_material_usage) + ROW_NUMBER() OVER (ORDER BY product_tracking_id) AS BIGINT) AS id,
  product_tracking_id, harvest_id, 'Filament' AS material_type, lot_number, CAST(weight_grams AS DECIMAL(10,2)) AS used_quantity,
  {AS_OF_SQL} AS used_at, inspected_by AS used_by, CAST(NULL AS VARCHAR) AS reason FROM used"""

K6_TRACK = K6_BASE + f"""
, st AS (SELECT c.product_tracking_id, s.id AS sid FROM cmd c JOIN x_product_statuses s ON s.status_name =
   CASE c.inspection_result WHEN 'Passed' THEN 'A-Ware' WHEN 'B-Ware' THEN 'B-Ware' WHEN 'Quarantine' THEN 'In Quarantine'
        WHEN 'In Quarantine' THEN 'In Quarantine' WHEN 'Waste' THEN 'Waste' ELSE 'Pending' END)
SELECT {_tracking_select("CASE WHEN c.product_tracking_id IS NOT NULL THEN (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'HarvestQCComplete') ELSE t.current_stage_id END",
                         'CASE WHEN s.product_tracking_id IS NOT NULL THEN s.sid ELSE t.current_status_id END',
                         'c.product_tracking_id IS NOT NULL')}
FROM x_product_tracking t LEFT JOIN cmd c ON c.product_tracking_id = t.id LEFT JOIN st s ON s.product_tracking_id = t.id"""

K6_QUAR = K6_BASE + f"""
SELECT CAST((SELECT max(id) FROM x_quarantined_products) + ROW_NUMBER() OVER (ORDER BY product_tracking_id) AS BIGINT) AS id,
  product_tracking_id, (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'HarvestQCComplete') AS from_stage_id,
  'Harvest QC' AS source, CAST(NULL AS BIGINT) AS location_id, {AS_OF_SQL} AS quarantine_date, inspected_by AS quarantined_by,
  nullif(notes, '') AS quarantine_reason, 'Active' AS quarantine_status, CAST(NULL AS VARCHAR) AS result,
  CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS BIGINT) AS resolved_by
FROM cmd WHERE inspection_result = 'Quarantine'"""

K6_MOUNTS = K6_BASE + """
, pm AS (SELECT mount_id, sum(weight_grams) AS w FROM used GROUP BY mount_id)
SELECT fm.id, fm.filament_tracking_id, fm.printer_id, fm.mounted_by, fm.mounted_at, fm.unmounted_at, fm.unmounted_by,
  CASE WHEN pm.w IS NOT NULL THEN CAST(fm.remaining_weight - pm.w AS DECIMAL(10,2)) ELSE fm.remaining_weight END AS remaining_weight,
  fm.status
FROM x_filament_mounting fm LEFT JOIN pm ON pm.mount_id = fm.id"""

K5_HARVEST = K5_BASE + f"""
SELECT harvest_id AS id, request_id, lid_id, seal_id, filament_mount_id AS filament_mounting_id, printed_by, {AS_OF_SQL} AS print_date
FROM units"""

K6_HIST = _history(K6_BASE, "cmd", _stage("HarvestQCComplete"), "'Harvest QC Complete'", "z.inspected_by")

SQL.update({
    "apply_harvest_records": K5_HARVEST, "apply_qc_history": K6_HIST,
    "apply_harvest": K5_TRACK, "apply_harvest_usage": K5_USAGE, "apply_harvest_requests": K5_REQ, "next_seq_for_lot": C7,
    "apply_qc": K6_QC, "apply_qc_reasons": K6_REASONS, "apply_qc_usage": K6_USAGE, "apply_qc_tracking": K6_TRACK,
    "apply_qc_quarantine": K6_QUAR, "apply_qc_mounts": K6_MOUNTS,
})

K8_BASE = f"""
, cand AS (SELECT DISTINCT id, sku FROM ({_G['treatment_candidates']}) g
   WHERE id NOT IN (SELECT product_tracking_id FROM x_treatment_batch_products)),
heads AS (SELECT sku AS batch_key, CAST((SELECT max(id) FROM x_treatment_batches) + ROW_NUMBER() OVER (ORDER BY sku) AS BIGINT) AS batch_id
   FROM (SELECT DISTINCT sku FROM cand)),
cmd AS (SELECT c.id AS product_tracking_id, h.batch_id, c.id % 4 <> 0 AS surface_treat, TRUE AS sterilize, c.sku
   FROM cand c JOIN heads h ON h.batch_key = c.sku)
"""

K8_BATCHES = K8_BASE + f"""
SELECT batch_id AS id, CAST(1 AS BIGINT) AS sent_by, {AS_OF_SQL} AS sent_at, CAST(NULL AS TIMESTAMP) AS received_at,
  'batch ' || batch_key AS notes, 'Shipped' AS status FROM heads"""

K8_LINKS = K8_BASE + """
SELECT CAST((SELECT max(id) FROM x_treatment_batch_products) + ROW_NUMBER() OVER (ORDER BY product_tracking_id) AS BIGINT) AS id,
  batch_id, product_tracking_id, surface_treat, sterilize FROM cmd"""

K8_TRACK = K8_BASE + f"""
SELECT {', '.join(
    "CASE WHEN c.product_tracking_id IS NOT NULL THEN t.current_stage_id ELSE t.previous_stage_id END AS previous_stage_id" if x == 'previous_stage_id' else
    "CASE WHEN c.product_tracking_id IS NOT NULL THEN (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'InTreatment') ELSE t.current_stage_id END AS current_stage_id" if x == 'current_stage_id' else
    "CASE WHEN c.product_tracking_id IS NOT NULL THEN (SELECT min(id) FROM x_storage_locations WHERE location_name = 'Offsite') ELSE t.location_id END AS location_id" if x == 'location_id' else
    f"CASE WHEN c.product_tracking_id IS NOT NULL THEN {AS_OF_SQL} ELSE t.last_updated_at END AS last_updated_at" if x == 'last_updated_at' else
    't.' + x for x in TRACK_COLS)}
FROM x_product_tracking t LEFT JOIN cmd c ON c.product_tracking_id = t.id"""

K9_BASE = f"""
, units AS (SELECT pt.id, tbp.batch_id, tbp.surface_treat, tbp.sterilize, st.status_name, pt.current_stage_id,
   pt.id % 6 <> 3 AS vis, pt.id % 17 = 0 AS quar
   FROM x_treatment_batch_products tbp JOIN x_treatment_batches tb ON tbp.batch_id = tb.id AND tb.status = 'Shipped'
   JOIN x_product_tracking pt ON tbp.product_tracking_id = pt.id LEFT JOIN x_product_statuses st ON pt.current_status_id = st.id),
cmd AS (SELECT id AS product_tracking_id, batch_id, surface_treat, sterilize, current_stage_id,
   CASE WHEN quar THEN TRUE ELSE vis END AS visual_pass,
   CASE WHEN NOT COALESCE(sterilize, FALSE) OR NOT COALESCE(vis, FALSE) THEN 'Waste'
        WHEN COALESCE(surface_treat, FALSE) AND NOT COALESCE(surface_treat, FALSE) THEN 'Waste'
        WHEN COALESCE(quar, FALSE) THEN 'Quarantine'
        WHEN status_name = 'A-Ware' AND COALESCE(surface_treat, FALSE) AND COALESCE(sterilize, FALSE) AND COALESCE(vis, FALSE) THEN 'Passed'
        ELSE 'B-Ware' END AS qc_result FROM units)
"""

K9_INS = K9_BASE + f"""
SELECT CAST((SELECT max(id) FROM x_post_treatment_inspections) + ROW_NUMBER() OVER (ORDER BY product_tracking_id) AS BIGINT) AS id,
  product_tracking_id, CAST(1 AS BIGINT) AS inspected_by, {AS_OF_SQL} AS inspected_at, visual_pass, surface_treat AS surface_treated,
  sterilize AS sterilized, qc_result, CAST(NULL AS VARCHAR) AS notes FROM cmd"""

K9_QUAR = K9_BASE + f"""
SELECT CAST((SELECT max(id) FROM x_quarantined_products) + ROW_NUMBER() OVER (ORDER BY product_tracking_id) AS BIGINT) AS id,
  product_tracking_id, current_stage_id AS from_stage_id, 'Post-Treatment QC' AS source, CAST(NULL AS BIGINT) AS location_id,
  {AS_OF_SQL} AS quarantine_date, CAST(1 AS BIGINT) AS quarantined_by, 'held after treatment' AS quarantine_reason,
  'Active' AS quarantine_status, CAST(NULL AS VARCHAR) AS result, CAST(NULL AS TIMESTAMP) AS resolved_at,
  CAST(NULL AS BIGINT) AS resolved_by FROM cmd WHERE qc_result = 'Quarantine'"""

K9_TRACK = K9_BASE + f"""
, st AS (SELECT c.product_tracking_id, s.id AS sid FROM cmd c JOIN x_product_statuses s ON s.status_name =
   CASE c.qc_result WHEN 'Passed' THEN 'A-Ware' WHEN 'B-Ware' THEN 'B-Ware' WHEN 'Quarantine' THEN 'In Quarantine'
        WHEN 'In Quarantine' THEN 'In Quarantine' WHEN 'Waste' THEN 'Waste' ELSE 'Pending' END)
SELECT {_tracking_select("CASE WHEN c.product_tracking_id IS NOT NULL THEN (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'PostTreatmentQC') ELSE t.current_stage_id END",
                         'CASE WHEN s.product_tracking_id IS NOT NULL THEN s.sid ELSE t.current_status_id END',
                         'c.product_tracking_id IS NOT NULL')}
FROM x_product_tracking t LEFT JOIN cmd c ON c.product_tracking_id = t.id LEFT JOIN st s ON s.product_tracking_id = t.id"""

K9_BATCHES = K9_BASE + f"""
SELECT b.id, b.sent_by, b.sent_at,
  CASE WHEN b.id IN (SELECT batch_id FROM cmd) THEN {AS_OF_SQL} ELSE b.received_at END AS received_at, b.notes,
  CASE WHEN b.id IN (SELECT batch_id FROM cmd) THEN 'Inspected' ELSE b.status END AS status
FROM x_treatment_batches b"""

K14_BASE = f"""
, opts AS ({_G['shelf_options']}),
ranked AS (SELECT id, location_id, next_stage_code, row_number() OVER (PARTITION BY id ORDER BY location_id, next_stage_code) AS first_rank,
   row_number() OVER (PARTITION BY id ORDER BY location_id DESC, next_stage_code DESC) AS last_rank
   FROM (SELECT DISTINCT id, location_id, next_stage_code FROM opts)),
held AS (SELECT DISTINCT product_tracking_id AS unit FROM x_quarantined_products WHERE quarantine_status = 'Active'
   AND product_tracking_id NOT IN (SELECT id FROM opts)),
asg AS (SELECT id AS unit, 1 AS seq, location_id, next_stage_code AS stage_code FROM ranked WHERE first_rank = 1
   UNION ALL SELECT id, 2, location_id, next_stage_code FROM ranked WHERE last_rank = 1 AND first_rank > 1
   UNION ALL SELECT unit, 1, 1 + unit % 25, 'Quarantine' FROM held),
cmd AS (SELECT a.*, s.id AS to_stage, CASE a.stage_code WHEN 'Quarantine' THEN 'Moved to Quarantine' WHEN 'Disposed' THEN 'Disposed'
   ELSE 'Storage assignment' END AS reason FROM asg a JOIN x_lifecycle_stages s ON s.stage_code = a.stage_code),
walk AS (SELECT c.*, COALESCE(lag(c.to_stage) OVER (PARTITION BY c.unit ORDER BY c.seq), t.current_stage_id) AS from_stage,
   row_number() OVER (PARTITION BY c.unit ORDER BY c.seq DESC) AS from_end FROM cmd c JOIN x_product_tracking t ON t.id = c.unit)
"""

K14_TRACK = K14_BASE + f"""
SELECT t.* REPLACE (COALESCE(w.from_stage, t.previous_stage_id) AS previous_stage_id, COALESCE(w.to_stage, t.current_stage_id) AS current_stage_id,
  COALESCE(w.location_id, t.location_id) AS location_id,
  CASE WHEN w.unit IS NOT NULL THEN {AS_OF_SQL} ELSE t.last_updated_at END AS last_updated_at)
FROM x_product_tracking t LEFT JOIN walk w ON w.unit = t.id AND w.from_end = 1"""

K14_HIST = K14_BASE + f"""
SELECT CAST(row_number() OVER (ORDER BY unit, seq) AS BIGINT) AS id, unit AS product_tracking_id, from_stage AS from_stage_id,
  to_stage AS to_stage_id, reason, CAST(1 AS BIGINT) AS changed_by, {AS_OF_SQL} AS changed_at FROM walk"""

K14_QUAR = K14_BASE + """
, sent AS (SELECT unit, arg_max(location_id, seq) AS place FROM asg WHERE stage_code = 'Quarantine' GROUP BY unit)
SELECT q.* REPLACE (CASE WHEN q.quarantine_status = 'Active' THEN COALESCE(s.place, q.location_id) ELSE q.location_id END AS location_id)
FROM x_quarantined_products q LEFT JOIN sent s ON s.unit = q.product_tracking_id"""

K18_BASE = """
, cmd AS (SELECT id AS shipment_id, 'shipped' AS action, CASE WHEN id % 2 = 0 THEN 'UPS' ELSE 'DHL' END AS carrier,
   'TRK' || CAST(id AS VARCHAR) AS tracking_number FROM x_shipments WHERE status = 'Pending'
   UNION ALL SELECT id, 'delivered', NULL, NULL FROM x_shipments WHERE status = 'Shipped'),
units AS (SELECT si.product_tracking_id FROM x_shipment_unit_items si JOIN cmd c ON c.shipment_id = si.shipment_id AND c.action = 'shipped')
"""

K18_SHIP = K18_BASE + f"""
SELECT s.id, s.customer_id, s.order_id, s.creator_id, s.created_date,
  CASE WHEN c.action = 'shipped' THEN {AS_OF_SQL} ELSE s.ship_date END AS ship_date,
  CASE WHEN c.action = 'delivered' THEN {AS_OF_SQL} ELSE s.delivery_date END AS delivery_date,
  CASE c.action WHEN 'shipped' THEN 'Shipped' WHEN 'delivered' THEN 'Delivered' ELSE s.status END AS status,
  CASE WHEN c.action IS NOT NULL THEN {AS_OF_SQL} ELSE s.updated_at END AS updated_at, s.updated_by,
  CASE WHEN c.action = 'shipped' THEN c.tracking_number ELSE s.tracking_number END AS tracking_number,
  CASE WHEN c.action = 'shipped' THEN c.carrier ELSE s.carrier END AS carrier, s.notes
FROM x_shipments s LEFT JOIN cmd c ON c.shipment_id = s.id"""

K18_TRACK = K18_BASE + f"""
SELECT {', '.join(
    "CASE WHEN u.product_tracking_id IS NOT NULL THEN t.current_stage_id ELSE t.previous_stage_id END AS previous_stage_id" if x == 'previous_stage_id' else
    "CASE WHEN u.product_tracking_id IS NOT NULL THEN (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'Shipped') ELSE t.current_stage_id END AS current_stage_id" if x == 'current_stage_id' else
    "CASE WHEN u.product_tracking_id IS NOT NULL THEN (SELECT min(id) FROM x_storage_locations WHERE location_name = 'Offsite') ELSE t.location_id END AS location_id" if x == 'location_id' else
    f"CASE WHEN u.product_tracking_id IS NOT NULL THEN {AS_OF_SQL} ELSE t.last_updated_at END AS last_updated_at" if x == 'last_updated_at' else
    't.' + x for x in TRACK_COLS)}
FROM x_product_tracking t LEFT JOIN units u ON u.product_tracking_id = t.id"""

SQL.update({
    "apply_treatment_batch": K8_BATCHES, "apply_treatment_batch_links": K8_LINKS, "apply_treatment_batch_tracking": K8_TRACK,
    "apply_post_treatment_qc": K9_INS, "apply_post_treatment_qc_tracking": K9_TRACK,
    "apply_post_treatment_qc_quarantine": K9_QUAR, "apply_post_treatment_qc_batches": K9_BATCHES,
    "apply_storage": K14_TRACK, "apply_storage_history": K14_HIST, "apply_storage_quarantine": K14_QUAR,
    "apply_treatment_batch_history": _history(K8_BASE, "cmd", _stage("InTreatment"), "'Sent for Treatment (batch creation)'", "1"),
    "apply_post_treatment_qc_history": _history(K9_BASE, "cmd", _stage("PostTreatmentQC"), "'Post-Treatment QC Complete'", "1"),
    "apply_post_treatment_qc_reasons": K9_BASE + """
, ins AS (SELECT (SELECT max(id) FROM x_post_treatment_inspections) + row_number() OVER (ORDER BY product_tracking_id) AS inspection_id,
   1 + product_tracking_id % 19 AS reason_id FROM cmd)
SELECT CAST(row_number() OVER (ORDER BY inspection_id, reason_id) AS BIGINT) AS id, CAST(inspection_id AS BIGINT) AS inspection_id, reason_id
FROM ins""",
    "apply_shipment_status_history": _history(K18_BASE, "units", _stage("Shipped"), "'Shipment sent'", "1"),
    "apply_shipment_status": K18_SHIP, "apply_shipment_status_tracking": K18_TRACK,
})

from spooltrace.oracle import sql_sales as _H  # noqa: E402

_AUDIT_START = "(SELECT max(id) FROM x_audit_log)"


def _header_audit_sql(cmd: str, new_status: str, reason: str) -> str:
    """Three audit rows per order (status, updated_by, updated_at), skipping unchanged text values."""
    return f"""
, hch AS (SELECT o.id AS record_id, 'status' AS field_name, o.status AS old_value, '{new_status}' AS new_value, 0 AS seq, c.user_id
   FROM x_orders o JOIN ({cmd}) c ON c.order_id = o.id
   UNION ALL SELECT o.id, 'updated_by', CAST(o.updated_by AS VARCHAR), CAST(c.user_id AS VARCHAR), 1, c.user_id
   FROM x_orders o JOIN ({cmd}) c ON c.order_id = o.id
   UNION ALL SELECT o.id, 'updated_at', strftime(o.updated_at, '%Y-%m-%d %H:%M:%S'), strftime({AS_OF_SQL}, '%Y-%m-%d %H:%M:%S'), 2, c.user_id
   FROM x_orders o JOIN ({cmd}) c ON c.order_id = o.id),
haudit AS (SELECT CAST({_AUDIT_START} + ROW_NUMBER() OVER (ORDER BY record_id, field_name, seq) AS BIGINT) AS id, 'orders' AS table_name,
   record_id, field_name, COALESCE(old_value, 'None') AS old_value, COALESCE(new_value, 'None') AS new_value,
   '{reason}' AS reason, CAST(user_id AS BIGINT) AS changed_by, {AS_OF_SQL} AS changed_at
   FROM hch WHERE COALESCE(old_value, 'None') <> COALESCE(new_value, 'None'))
"""


CANCEL_CMD = ("SELECT id AS order_id, 1 + customer_id % 10 AS user_id, 'customer request' AS notes FROM x_orders "
              "WHERE status = 'Processing'")

K16_CANCEL = f"""
, cmd AS ({CANCEL_CMD})
SELECT o.id, o.parent_order_id, o.customer_id, o.order_date, o.order_creator_id,
  CASE WHEN c.order_id IS NOT NULL THEN 'Canceled' ELSE o.status END AS status,
  CASE WHEN c.order_id IS NOT NULL THEN {AS_OF_SQL} ELSE o.updated_at END AS updated_at,
  CASE WHEN c.order_id IS NOT NULL THEN CAST(c.user_id AS BIGINT) ELSE o.updated_by END AS updated_by,
  CASE WHEN c.order_id IS NOT NULL THEN c.notes ELSE o.notes END AS notes
FROM x_orders o LEFT JOIN cmd c ON c.order_id = o.id"""

K16_CANCEL_AUDIT = _header_audit_sql(CANCEL_CMD, "Canceled", "Order request canceled") + " SELECT * FROM haudit"

K16_DIFF_BASE = """
, o AS (SELECT id FROM x_orders WHERE status = 'Processing'),
d AS (SELECT i.order_id, i.product_sku_id, CAST(i.quantity + CASE WHEN i.product_sku_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS quantity
   FROM x_order_items i JOIN o ON o.id = i.order_id WHERE i.product_sku_id NOT IN (3, 7)
   UNION ALL SELECT id, CAST(7 AS BIGINT), CAST(2 AS BIGINT) FROM o),
mine AS (SELECT i.* FROM x_order_items i WHERE i.order_id IN (SELECT id FROM o)),
changed AS (SELECT m.id, m.order_id, m.product_sku_id, m.quantity AS old_q, d.quantity AS new_q FROM mine m JOIN d ON d.order_id = m.order_id
   AND d.product_sku_id = m.product_sku_id WHERE m.quantity <> d.quantity),
added AS (SELECT d.* FROM d WHERE d.quantity > 0 AND NOT EXISTS (SELECT 1 FROM mine m WHERE m.order_id = d.order_id
   AND m.product_sku_id = d.product_sku_id)),
removed AS (SELECT m.* FROM mine m WHERE m.quantity <> 0 AND NOT EXISTS (SELECT 1 FROM d WHERE d.order_id = m.order_id
   AND d.product_sku_id = m.product_sku_id)),
new_items AS (SELECT CAST((SELECT max(id) FROM x_order_items) + ROW_NUMBER() OVER (ORDER BY order_id, product_sku_id) AS BIGINT) AS id,
   order_id, product_sku_id, quantity FROM added)
"""

K16_DIFF = K16_DIFF_BASE + """
SELECT i.id, i.order_id, i.product_sku_id, COALESCE(CAST(ch.new_q AS BIGINT), i.quantity) AS quantity
FROM x_order_items i LEFT JOIN changed ch ON ch.order_id = i.order_id AND ch.product_sku_id = i.product_sku_id
WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.order_id = i.order_id AND r.product_sku_id = i.product_sku_id)
UNION ALL SELECT * FROM new_items"""

K16_DIFF_AUDIT = K16_DIFF_BASE + f"""
, a AS (SELECT id AS record_id, 'quantity' AS field_name, CAST(old_q AS VARCHAR) AS old_value, CAST(new_q AS VARCHAR) AS new_value,
   'Sales order updated' AS reason FROM changed
   UNION ALL SELECT id, 'quantity', 'None', CAST(quantity AS VARCHAR), 'Product item added to order' FROM new_items
   UNION ALL SELECT id, 'Deleted', CAST(quantity AS VARCHAR), 'Yes', 'Removed from order' FROM removed)
SELECT CAST({_AUDIT_START} + ROW_NUMBER() OVER (ORDER BY record_id, field_name, old_value, new_value) AS BIGINT) AS id,
  'order_items' AS table_name,
  record_id, field_name, old_value, new_value, reason, CAST(1 AS BIGINT) AS changed_by, {AS_OF_SQL} AS changed_at FROM a"""

K16_RECREATE_BASE = f"""
, src AS (SELECT order_id FROM ({_H.CANCELED}) h),
heads AS (SELECT CAST((SELECT max(id) FROM x_orders) + ROW_NUMBER() OVER (ORDER BY o.id) AS BIGINT) AS id, o.id AS parent_order_id,
   o.customer_id, o.notes AS old_notes FROM x_orders o JOIN src ON src.order_id = o.id)
"""

K16_RECREATE = K16_RECREATE_BASE + f"""
SELECT id, parent_order_id, customer_id, {AS_OF_SQL} AS order_date, CAST(1 AS BIGINT) AS order_creator_id, 'Processing' AS status,
  CAST(NULL AS TIMESTAMP) AS updated_at, CAST(1 AS BIGINT) AS updated_by,
  'Re-created from #' || CAST(parent_order_id AS VARCHAR) || CASE WHEN old_notes IS NOT NULL THEN ': ' || old_notes ELSE '' END AS notes
FROM heads"""

K16_RECREATE_ITEMS = K16_RECREATE_BASE + """
SELECT CAST((SELECT max(id) FROM x_order_items) + ROW_NUMBER() OVER (ORDER BY h.id, i.product_sku_id) AS BIGINT) AS id, h.id AS order_id,
  i.product_sku_id, i.quantity FROM x_order_items i JOIN heads h ON h.parent_order_id = i.order_id WHERE i.quantity > 0"""

_FIFO = _H.FIFO
K17_BASE = _FIFO + """
, alloc AS (SELECT l.order_id, u.product_id FROM units u JOIN lines2 l ON l.sku_id = u.sku_id AND u.fifo_rank > l.run_start
   AND u.fifo_rank <= l.run_end),
short AS (SELECT DISTINCT order_id FROM lines2 WHERE greatest(least(run_end, n) - run_start, 0) < required_units),
heads AS (SELECT CAST((SELECT max(id) FROM x_shipments) + ROW_NUMBER() OVER (ORDER BY o.id) AS BIGINT) AS shipment_id, o.id AS order_id,
   o.customer_id FROM x_orders o WHERE o.status = 'Processing' AND o.id NOT IN (SELECT order_id FROM short))
"""

K17_SHIP = K17_BASE + f"""
SELECT shipment_id AS id, customer_id, order_id, CAST(1 AS BIGINT) AS creator_id, {AS_OF_SQL} AS created_date,
  CAST(NULL AS TIMESTAMP) AS ship_date, CAST(NULL AS TIMESTAMP) AS delivery_date, 'Pending' AS status, CAST(NULL AS TIMESTAMP) AS updated_at,
  CAST(1 AS BIGINT) AS updated_by, CAST(NULL AS VARCHAR) AS tracking_number, CAST(NULL AS VARCHAR) AS carrier, '' AS notes FROM heads"""

K17_UNITS = K17_BASE + """
SELECT CAST((SELECT max(id) FROM x_shipment_unit_items) + ROW_NUMBER() OVER (ORDER BY a.product_id) AS BIGINT) AS id, h.shipment_id,
  a.product_id AS product_tracking_id FROM alloc a JOIN heads h ON h.order_id = a.order_id"""

_sku_body = _H.SQL["shipment_sku_items"].split("SELECT * FROM (SELECT * FROM ser UNION ALL SELECT * FROM ns) WHERE quantity > 0")[0]
K17_SKU = _sku_body + """
, heads AS (SELECT CAST((SELECT max(id) FROM x_shipments) + ROW_NUMBER() OVER (ORDER BY o.id) AS BIGINT) AS shipment_id, o.id AS order_id
   FROM x_orders o WHERE o.status = 'Processing' AND o.id NOT IN (SELECT DISTINCT order_id FROM lines2
     WHERE greatest(least(run_end, n) - run_start, 0) < required_units)),
si AS (SELECT h.shipment_id, x.product_sku_id, x.quantity FROM (SELECT * FROM ser UNION ALL SELECT * FROM ns) x
   JOIN heads h ON h.order_id = x.order_id WHERE x.quantity > 0)
SELECT CAST(COALESCE((SELECT max(id) FROM x_shipment_sku_items), 0) + ROW_NUMBER() OVER (ORDER BY shipment_id, product_sku_id) AS BIGINT) AS id,
  shipment_id, product_sku_id, quantity FROM si"""

K17_AUDIT = K17_BASE + _header_audit_sql("SELECT order_id, 1 AS user_id FROM heads", "Completed", "Shipment created") + \
    " SELECT * FROM haudit"

_K17_ALLOC = "(SELECT a.product_id AS product_tracking_id FROM alloc a JOIN heads h ON h.order_id = a.order_id)"
K17_TRACK = K17_BASE + f"""
SELECT t.* REPLACE (CASE WHEN z.product_tracking_id IS NULL THEN t.previous_stage_id ELSE t.current_stage_id END AS previous_stage_id,
  CASE WHEN z.product_tracking_id IS NULL THEN t.current_stage_id ELSE {_stage('PendingShipment')} END AS current_stage_id,
  CASE WHEN z.product_tracking_id IS NULL THEN t.last_updated_at ELSE {AS_OF_SQL} END AS last_updated_at)
FROM x_product_tracking t LEFT JOIN {_K17_ALLOC} z ON z.product_tracking_id = t.id"""
K17_ORDERS = K17_BASE + f"""
SELECT o.* REPLACE (CASE WHEN h.order_id IS NULL THEN o.status ELSE 'Completed' END AS status,
  CASE WHEN h.order_id IS NULL THEN o.updated_at ELSE {AS_OF_SQL} END AS updated_at,
  CASE WHEN h.order_id IS NULL THEN o.updated_by ELSE 1 END AS updated_by)
FROM x_orders o LEFT JOIN heads h ON h.order_id = o.id"""

SQL.update({
    "apply_shipment_tracking": K17_TRACK, "apply_shipment_orders": K17_ORDERS,
    "apply_shipment_history": _history(K17_BASE, _K17_ALLOC, _stage("PendingShipment"), "'Marked for Shipment'", "1"),
    "apply_order_cancel": K16_CANCEL, "apply_order_cancel_audit": K16_CANCEL_AUDIT,
    "apply_order_line_diff": K16_DIFF, "apply_order_line_diff_audit": K16_DIFF_AUDIT,
    "apply_recreate_orders": K16_RECREATE, "apply_recreate_order_items": K16_RECREATE_ITEMS,
    "apply_shipment": K17_SHIP, "apply_shipment_units": K17_UNITS, "apply_shipment_sku_items": K17_SKU,
    "apply_shipment_orders_audit": K17_AUDIT,
})

_M2 = _M["mountable_filaments"]
K19_MOUNT = f"""
, m AS (SELECT id, max(weight_grams) AS weight_grams FROM ({_M2}) x GROUP BY id)
SELECT CAST((SELECT max(id) FROM x_filament_mounting) + ROW_NUMBER() OVER (ORDER BY id, 1 + id % 7) AS BIGINT) AS id,
  id AS filament_tracking_id, 1 + id % 7 AS printer_id, 1 + id % 10 AS mounted_by, {AS_OF_SQL} AS mounted_at,
  CAST(NULL AS TIMESTAMP) AS unmounted_at, CAST(NULL AS BIGINT) AS unmounted_by, CAST(weight_grams AS DECIMAL(10,2)) AS remaining_weight,
  'In Use' AS status FROM m"""

K19_UNMOUNT = f"""
SELECT id, filament_tracking_id, printer_id, mounted_by, mounted_at,
  CASE WHEN unmounted_at IS NULL THEN {AS_OF_SQL} ELSE unmounted_at END AS unmounted_at,
  CASE WHEN unmounted_at IS NULL THEN 1 + id % 10 ELSE unmounted_by END AS unmounted_by,
  remaining_weight, CASE WHEN unmounted_at IS NULL THEN 'Unmounted' ELSE status END AS status
FROM x_filament_mounting"""

K19_W_BASE = """
, cmd AS (SELECT id AS filament_pk, CAST((id * 7) % 1000 + 0.5 AS DECIMAL(10,2)) AS new_weight FROM x_filaments),
r AS (SELECT c.*, fm.id AS mid, fm.remaining_weight AS rw, f.weight_grams AS w FROM cmd c
   LEFT JOIN x_filament_mounting fm ON fm.filament_tracking_id = c.filament_pk AND fm.status = 'In Use'
   LEFT JOIN x_filaments f ON f.id = c.filament_pk),
em AS (SELECT mid AS record_id, CAST(rw AS VARCHAR) AS old_value, CAST(new_weight AS VARCHAR) AS new_value FROM r
   WHERE mid IS NOT NULL AND round(CAST(rw AS DOUBLE), 5) IS DISTINCT FROM round(CAST(new_weight AS DOUBLE), 5)),
es AS (SELECT filament_pk AS record_id, CAST(w AS VARCHAR) AS old_value, CAST(new_weight AS VARCHAR) AS new_value FROM r
   WHERE mid IS NULL AND w IS NOT NULL AND round(CAST(w AS DOUBLE), 5) IS DISTINCT FROM round(CAST(new_weight AS DOUBLE), 5))
"""

K19_W_AUDIT = K19_W_BASE + f"""
SELECT CAST((SELECT max(id) FROM x_audit_log) + ROW_NUMBER() OVER (ORDER BY record_id) AS BIGINT) AS id, 'filament_mounting' AS table_name,
  record_id, 'remaining_weight' AS field_name, old_value, new_value, 'reweigh' AS reason, CAST(1 AS BIGINT) AS changed_by,
  {AS_OF_SQL} AS changed_at FROM em
UNION ALL
SELECT CAST((SELECT max(id) FROM x_audit_log) + (SELECT count(*) FROM em) + ROW_NUMBER() OVER (ORDER BY record_id) AS BIGINT),
  'filaments', record_id, 'weight_grams', old_value, new_value, 'reweigh', CAST(1 AS BIGINT), {AS_OF_SQL} FROM es"""

K19_W_MOUNTS = K19_W_BASE + """
SELECT fm.id, fm.filament_tracking_id, fm.printer_id, fm.mounted_by, fm.mounted_at, fm.unmounted_at, fm.unmounted_by,
  COALESCE(CAST(em.new_value AS DECIMAL(10,2)), fm.remaining_weight) AS remaining_weight, fm.status
FROM x_filament_mounting fm LEFT JOIN em ON em.record_id = fm.id"""

K19_W_SPOOLS = K19_W_BASE + """
SELECT f.id, f.filament_id, f.serial_number, f.lot_number, f.location_id,
  COALESCE(CAST(es.new_value AS DECIMAL(10,2)), f.weight_grams) AS weight_grams, f.received_at, f.received_by, f.qc_result
FROM x_filaments f LEFT JOIN es ON es.record_id = f.id"""

K21_BASE = """
, vis AS (SELECT id AS reason_id, reason_code, reason_label || ' (rev)' AS reason_label, category, default_outcome, severity,
   id % 2 = 0 AS is_active FROM x_issue_reasons WHERE category = 'Visual'),
ev AS (SELECT DISTINCT upper(event_type) AS t FROM events WHERE event_type IS NOT NULL),
newr AS (SELECT CAST((SELECT max(id) FROM x_issue_reasons) + ROW_NUMBER() OVER (ORDER BY 'EVT_' || t) AS BIGINT) AS id,
   'EVT_' || t AS reason_code, 'Event ' || lower(t) AS reason_label, 'General' AS category, CAST(NULL AS VARCHAR) AS default_outcome,
   CAST(NULL AS BIGINT) AS severity, TRUE AS is_active FROM ev),
reasons AS (SELECT r.id, COALESCE(v.reason_code, r.reason_code) AS reason_code,
   CASE WHEN v.reason_id IS NOT NULL THEN v.reason_label ELSE r.reason_label END AS reason_label,
   CASE WHEN v.reason_id IS NOT NULL THEN v.category ELSE r.category END AS category,
   CASE WHEN v.reason_id IS NOT NULL THEN v.default_outcome ELSE r.default_outcome END AS default_outcome,
   CASE WHEN v.reason_id IS NOT NULL THEN v.severity ELSE r.severity END AS severity,
   CASE WHEN v.reason_id IS NOT NULL THEN v.is_active ELSE r.is_active END AS is_active
   FROM x_issue_reasons r LEFT JOIN vis v ON v.reason_id = r.id
   UNION ALL SELECT * FROM newr),
wanted AS (SELECT DISTINCT v.reason_id, CAST(x.cid AS BIGINT) AS context_id FROM vis v, (VALUES (3), (4)) x(cid)
   UNION SELECT id, CAST(4 AS BIGINT) FROM newr)
"""

K21_REASONS = K21_BASE + " SELECT * FROM reasons"
K21_CTX = K21_BASE + """
SELECT * FROM x_issue_reason_contexts WHERE reason_id NOT IN (SELECT reason_id FROM wanted)
UNION ALL SELECT CAST((SELECT max(id) FROM x_issue_reason_contexts) + ROW_NUMBER() OVER (ORDER BY reason_id, context_id) AS BIGINT),
  reason_id, context_id FROM wanted"""


def _initials_sql(x: str) -> str:
    """F18 in DuckDB: first two letters of the first and last word, 'Xx' form."""
    def part(w: str) -> str:
        letters = f"regexp_replace({w}, '[^\\p{{L}}]', '', 'g')"
        raw = f"CASE WHEN length({letters}) = 1 THEN {letters} || {letters} ELSE left({letters}, 2) END"
        return (f"CASE WHEN length({letters}) = 0 THEN 'Xx' ELSE upper(substr({raw}, 1, 1)) || lower(substr({raw}, 2, 1)) END")
    parts = f"regexp_split_to_array(trim({x}), '\\s+')"
    return (f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN 'XxXx' ELSE {part(f'{parts}[1]')} || {part(f'{parts}[-1]')} END")


def _login(round_no: int) -> str:
    name = "'Anna Maria ' || s_name" if round_no == 2 else "s_name"
    return (f"SELECT 'oid-' || CAST(s_suppkey AS VARCHAR) AS oid, 'user' || CAST(s_suppkey AS VARCHAR) || '@plant.example' AS upn, "
            f"CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE {name} END AS display_name FROM supplier")


def _users_round(prev: str, login: str, name: str) -> str:
    nm = _initials_sql("COALESCE(nullif(display_name, ''), nullif(upn, ''), 'User')")
    src = f"(SELECT oid, nullif(upn, '') AS upn, {nm} AS nm FROM ({login}) l)"
    return f"""
{name} AS (SELECT u.id, CASE WHEN s.oid IS NOT NULL THEN s.nm ELSE u.display_name END AS display_name, u.department_id,
   CASE WHEN s.oid IS NOT NULL THEN TRUE ELSE u.is_active END AS is_active, u.azure_ad_object_id,
   CASE WHEN s.oid IS NOT NULL THEN s.upn ELSE u.user_principal_name END AS user_principal_name
   FROM {prev} u LEFT JOIN {src} s ON s.oid = u.azure_ad_object_id
   UNION ALL SELECT CAST((SELECT max(id) FROM {prev}) + ROW_NUMBER() OVER (ORDER BY s.oid) AS BIGINT), s.nm,
     CAST(COALESCE((SELECT min(id) FROM x_departments WHERE department_code = 'GEN'), (SELECT min(id) FROM x_departments WHERE is_active)) AS BIGINT),
     TRUE, s.oid, s.upn FROM {src} s WHERE s.oid NOT IN (SELECT azure_ad_object_id FROM {prev} WHERE azure_ad_object_id IS NOT NULL))"""


K22 = ", " + _users_round("x_users", _login(1), "u1") + ", " + _users_round("u1", _login(2), "u2") + " SELECT * FROM u2"

K23_LIDS_BASE = """
, cmd AS (SELECT trim(' LID' || CAST(min(p_partkey) % 150 AS VARCHAR) || ' ') AS serial_number, 100 + count(*) AS quantity,
   1 + min(p_partkey) % 25 AS location_id FROM part GROUP BY p_brand),
dup AS (SELECT serial_number FROM cmd GROUP BY serial_number HAVING count(*) > 1)
"""
K23_LIDS = K23_LIDS_BASE + f"""
SELECT CAST((SELECT max(id) FROM x_lids) + ROW_NUMBER() OVER (ORDER BY serial_number) AS BIGINT) AS id, serial_number,
  CAST(quantity AS BIGINT) AS quantity, CAST(location_id AS BIGINT) AS location_id, {AS_OF_SQL} AS received_at,
  CAST(1 AS BIGINT) AS received_by, 'PASS' AS qc_result
FROM cmd WHERE serial_number NOT IN (SELECT serial_number FROM x_lids) AND serial_number NOT IN (SELECT serial_number FROM dup)"""
K23_LIDS_REJ = K23_LIDS_BASE + """
SELECT serial_number, 'exists' AS why FROM cmd WHERE serial_number IN (SELECT serial_number FROM x_lids)
UNION ALL SELECT serial_number, 'repeated' FROM dup"""

K23_CUST_BASE = """
, n AS (SELECT trim(' Account ' || c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR)) AS customer_name
   FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
   UNION ALL SELECT trim(c_name) FROM customer),
n2 AS (SELECT * FROM n WHERE customer_name <> ''),
dup AS (SELECT customer_name FROM n2 GROUP BY customer_name HAVING count(*) > 1)
"""
K23_CUST = K23_CUST_BASE + """
SELECT CAST((SELECT max(id) FROM x_customers) + ROW_NUMBER() OVER (ORDER BY customer_name) AS BIGINT) AS id, customer_name FROM n2
WHERE customer_name NOT IN (SELECT customer_name FROM x_customers) AND customer_name NOT IN (SELECT customer_name FROM dup)"""
K23_CUST_REJ = K23_CUST_BASE + """
SELECT customer_name, 'exists' AS why FROM n2 WHERE customer_name IN (SELECT customer_name FROM x_customers)
UNION ALL SELECT customer_name, 'repeated' FROM dup"""

SQL.update({
    "apply_mount": K19_MOUNT, "apply_unmount": K19_UNMOUNT, "apply_weight_update": K19_W_AUDIT,
    "apply_weight_update_mounts": K19_W_MOUNTS, "apply_weight_update_spools": K19_W_SPOOLS,
    "apply_reasons": K21_REASONS, "apply_reason_contexts": K21_CTX, "apply_users": K22,
    "apply_new_lids": K23_LIDS, "apply_new_lids_rejected": K23_LIDS_REJ,
    "apply_new_customers": K23_CUST, "apply_new_customers_rejected": K23_CUST_REJ,
})

K7_BASE = f"""
, ed AS (SELECT id AS qc_id, product_tracking_id, 'inspection_result' AS field_name, inspection_result AS old_value,
   CASE inspection_result WHEN 'Passed' THEN 'B-Ware' WHEN 'B-Ware' THEN 'Quarantine' WHEN 'Quarantine' THEN 'Waste'
     WHEN 'Waste' THEN 'Passed' END AS new_value FROM x_product_quality_control
   UNION ALL SELECT id, product_tracking_id, 'notes', notes, 'rechecked' FROM x_product_quality_control),
ed2 AS (SELECT *, 'QC correction' AS reason, 1 + qc_id % 10 AS user_id FROM ed),
eff AS (SELECT * FROM ed2 WHERE COALESCE(old_value, 'None') <> COALESCE(new_value, 'None')),
hits AS (SELECT product_tracking_id, new_value AS result, reason, user_id FROM eff WHERE field_name = 'inspection_result'),
st AS (SELECT h.product_tracking_id, s.id AS sid FROM hits h JOIN x_product_statuses s ON s.status_name =
   CASE h.result WHEN 'Passed' THEN 'A-Ware' WHEN 'B-Ware' THEN 'B-Ware' WHEN 'Quarantine' THEN 'In Quarantine'
     WHEN 'In Quarantine' THEN 'In Quarantine' WHEN 'Waste' THEN 'Waste' ELSE 'A-Ware' END),
q AS (SELECT * FROM hits WHERE result = 'Quarantine')
"""

K7_QC = K7_BASE + """
SELECT qc.id, qc.product_tracking_id, qc.inspected_by, qc.inspected_at, qc.weight_grams, qc.pressure_drop, qc.visual_pass,
  COALESCE(er.new_value, qc.inspection_result) AS inspection_result,
  CASE WHEN en.qc_id IS NOT NULL THEN en.new_value ELSE qc.notes END AS notes
FROM x_product_quality_control qc
LEFT JOIN eff er ON er.qc_id = qc.id AND er.field_name = 'inspection_result'
LEFT JOIN eff en ON en.qc_id = qc.id AND en.field_name = 'notes'"""

K7_AUDIT = K7_BASE + f"""
SELECT CAST((SELECT max(id) FROM x_audit_log) + ROW_NUMBER() OVER (ORDER BY qc_id, field_name) AS BIGINT) AS id,
  'product_quality_control' AS table_name, qc_id AS record_id, field_name, COALESCE(old_value, 'None') AS old_value,
  COALESCE(new_value, 'None') AS new_value, reason, CAST(user_id AS BIGINT) AS changed_by, {AS_OF_SQL} AS changed_at FROM eff"""

K7_TRACK = K7_BASE + f"""
SELECT {', '.join(
    "CASE WHEN q.product_tracking_id IS NOT NULL THEN t.current_stage_id ELSE t.previous_stage_id END AS previous_stage_id" if x == 'previous_stage_id' else
    "CASE WHEN q.product_tracking_id IS NOT NULL THEN (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'Quarantine') ELSE t.current_stage_id END AS current_stage_id" if x == 'current_stage_id' else
    "CASE WHEN s.product_tracking_id IS NOT NULL THEN s.sid ELSE t.current_status_id END AS current_status_id" if x == 'current_status_id' else
    f"CASE WHEN s.product_tracking_id IS NOT NULL OR q.product_tracking_id IS NOT NULL THEN {AS_OF_SQL} ELSE t.last_updated_at END AS last_updated_at" if x == 'last_updated_at' else
    't.' + x for x in TRACK_COLS)}
FROM x_product_tracking t LEFT JOIN st s ON s.product_tracking_id = t.id LEFT JOIN q ON q.product_tracking_id = t.id"""

K7_QUAR = K7_BASE + f"""
SELECT CAST((SELECT max(id) FROM x_quarantined_products) + ROW_NUMBER() OVER (ORDER BY q.product_tracking_id) AS BIGINT) AS id,
  q.product_tracking_id, t.current_stage_id AS from_stage_id, 'Harvest QC' AS source, CAST(NULL AS BIGINT) AS location_id,
  {AS_OF_SQL} AS quarantine_date, CAST(q.user_id AS BIGINT) AS quarantined_by, nullif(q.reason, '') AS quarantine_reason,
  'Active' AS quarantine_status, CAST(NULL AS VARCHAR) AS result, CAST(NULL AS TIMESTAMP) AS resolved_at,
  CAST(NULL AS BIGINT) AS resolved_by
FROM q JOIN x_product_tracking t ON t.id = q.product_tracking_id"""

K20_BASE = """
, meas AS (SELECT t.sku_id, round(avg(CAST(q.weight_grams AS DOUBLE)), 2) AS avg_w FROM x_product_quality_control q
   JOIN x_product_tracking t ON q.product_tracking_id = t.id GROUP BY t.sku_id),
cmd AS (SELECT m.sku_id, COALESCE(sp.height_mm, CAST(100 AS DECIMAL(7,2))) AS height_mm,
   COALESCE(sp.diameter_mm, CAST(50 AS DECIMAL(7,2))) AS diameter_mm, CAST(m.avg_w AS DECIMAL(7,2)) AS average_weight_g,
   COALESCE(sp.weight_buffer_g, CAST(5 AS DECIMAL(4,2))) AS weight_buffer_g FROM meas m LEFT JOIN x_product_print_specs sp ON sp.sku_id = m.sku_id)
"""

K20_SPECS = K20_BASE + """
SELECT sp.sku_id, COALESCE(c.height_mm, sp.height_mm) AS height_mm, COALESCE(c.diameter_mm, sp.diameter_mm) AS diameter_mm,
  COALESCE(c.average_weight_g, sp.average_weight_g) AS average_weight_g, COALESCE(c.weight_buffer_g, sp.weight_buffer_g) AS weight_buffer_g
FROM x_product_print_specs sp LEFT JOIN cmd c ON c.sku_id = sp.sku_id
UNION ALL SELECT c.sku_id, c.height_mm, c.diameter_mm, c.average_weight_g, c.weight_buffer_g FROM cmd c
WHERE c.sku_id NOT IN (SELECT sku_id FROM x_product_print_specs)"""

K20_AUDIT = K20_BASE + f"""
, ch AS (SELECT c.sku_id AS record_id, f.field_name, f.seq,
   CASE f.field_name WHEN 'height_mm' THEN CAST(sp.height_mm AS VARCHAR) WHEN 'diameter_mm' THEN CAST(sp.diameter_mm AS VARCHAR)
     WHEN 'average_weight_g' THEN CAST(sp.average_weight_g AS VARCHAR) ELSE CAST(sp.weight_buffer_g AS VARCHAR) END AS old_value,
   CASE f.field_name WHEN 'height_mm' THEN CAST(c.height_mm AS VARCHAR) WHEN 'diameter_mm' THEN CAST(c.diameter_mm AS VARCHAR)
     WHEN 'average_weight_g' THEN CAST(c.average_weight_g AS VARCHAR) ELSE CAST(c.weight_buffer_g AS VARCHAR) END AS new_value
   FROM cmd c LEFT JOIN x_product_print_specs sp ON sp.sku_id = c.sku_id,
   (VALUES ('height_mm', 0), ('diameter_mm', 1), ('average_weight_g', 2), ('weight_buffer_g', 3)) f(field_name, seq)),
eff AS (SELECT * FROM ch WHERE round(TRY_CAST(old_value AS DOUBLE), 5) IS DISTINCT FROM round(TRY_CAST(new_value AS DOUBLE), 5))
SELECT CAST((SELECT max(id) FROM x_audit_log) + ROW_NUMBER() OVER (ORDER BY record_id, field_name, seq) AS BIGINT) AS id,
  'product_print_specs' AS table_name, record_id, field_name, COALESCE(old_value, 'None') AS old_value,
  COALESCE(new_value, 'None') AS new_value, 'recalibrated from QC weights' AS reason, CAST(1 AS BIGINT) AS changed_by,
  {AS_OF_SQL} AS changed_at FROM eff"""

SQL.update({
    "apply_qc_edit": K7_QC, "apply_qc_edit_audit": K7_AUDIT, "apply_qc_edit_tracking": K7_TRACK,
    "apply_qc_edit_history": _history(K7_BASE, "q", _stage("Quarantine"), "'QC edit: moved to Quarantine'", "z.user_id"),
    "apply_qc_edit_quarantine": K7_QUAR, "apply_print_specs": K20_SPECS, "apply_print_specs_audit": K20_AUDIT,
})

SQL["stage_region"] = "SELECT * FROM x_stg_excel_data"

_K6_CMD = K6_BASE  # defines g4, cmd (harvest QC commands)
CMD_REPORT = _K6_CMD.replace("cmd AS (", "qcmd AS (").replace("FROM cmd", "FROM qcmd").replace("qc AS (SELECT CAST(", "qcx AS (SELECT CAST(") + """
, pcmd AS (SELECT pt.id AS product_tracking_id,
   CASE WHEN pt.id % 17 = 0 THEN TRUE ELSE pt.id % 6 <> 3 END AS visual_pass,
   CASE WHEN NOT COALESCE(tbp.sterilize, FALSE) OR NOT COALESCE(pt.id % 6 <> 3, FALSE) THEN 'Waste'
        WHEN COALESCE(tbp.surface_treat, FALSE) AND NOT COALESCE(tbp.surface_treat, FALSE) THEN 'Waste'
        WHEN pt.id % 17 = 0 THEN 'Quarantine'
        WHEN st.status_name = 'A-Ware' AND COALESCE(tbp.surface_treat, FALSE) AND COALESCE(tbp.sterilize, FALSE)
             AND COALESCE(pt.id % 6 <> 3, FALSE) THEN 'Passed'
        ELSE 'B-Ware' END AS qc_result
   FROM x_treatment_batch_products tbp JOIN x_treatment_batches tb ON tbp.batch_id = tb.id AND tb.status = 'Shipped'
   JOIN x_product_tracking pt ON tbp.product_tracking_id = pt.id LEFT JOIN x_product_statuses st ON pt.current_status_id = st.id),
names AS (SELECT trim(' Account ' || c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR)) AS name
   FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
   UNION ALL SELECT trim(c_name) FROM customer),
ncount AS (SELECT name, count(*) AS n FROM names GROUP BY name)
SELECT 'harvest_qc' AS command, CAST(product_tracking_id AS VARCHAR) AS command_key, 'weight and pressure are required' AS problem
FROM qcmd WHERE COALESCE(weight_grams, 0) = 0 OR COALESCE(pressure_drop, 0) = 0
UNION ALL SELECT 'harvest_qc', CAST(product_tracking_id AS VARCHAR), 'notes are required for B-Ware on a visual fail'
FROM qcmd WHERE NOT visual_pass AND inspection_result = 'B-Ware' AND (notes IS NULL OR trim(notes) = '')
UNION ALL SELECT 'post_treatment_qc', CAST(product_tracking_id AS VARCHAR), 'notes are required for B-Ware on a visual fail'
FROM pcmd WHERE visual_pass = FALSE AND qc_result = 'B-Ware'
UNION ALL SELECT 'customer', n.name, 'customer name repeated' FROM names n JOIN ncount c ON c.name = n.name WHERE c.n > 1
UNION ALL SELECT 'customer', name, 'customer name cannot be empty' FROM names WHERE name IS NULL OR trim(name) = ''
"""

from spooltrace.oracle.sql_etl import SQL as _E  # noqa: E402

_e1_ctes, _e1_select = _E["etl_filaments"].split("\nSELECT f.id, f.filament_id,", 1)
_fields = [("serial_number", "{}.serial_number"), ("lot_number", "{}.lot_number"),
           ("location_id", "CAST({}.location_id AS VARCHAR)"), ("weight_grams", "CAST({}.weight_grams AS VARCHAR)"),
           ("received_at", "strftime({}.received_at, '%Y-%m-%d')"), ("received_by", "CAST({}.received_by AS VARCHAR)"),
           ("qc_result", "{}.qc_result")]
FIELD_DIFF = _e1_ctes + ", newf AS (SELECT f.id, f.filament_id," + _e1_select + ")\n" + " UNION ALL ".join(
    f"SELECT o.id AS record_id, '{name}' AS field, {expr.format('o')} AS old_value, {expr.format('n')} AS new_value "
    f"FROM x_filaments o JOIN newf n ON n.id = o.id WHERE {expr.format('o')} IS DISTINCT FROM {expr.format('n')}"
    for name, expr in _fields)

SQL.update({"command_report": CMD_REPORT, "field_diff": FIELD_DIFF})

SQL["seed_group_rights"] = """
, src AS (SELECT 'REGION_' || r.r_name AS group_oid, a.id AS area_id, v.lvl AS access_level FROM region r,
   (VALUES ('Production', 'Read'), ('Logistics', 'Write')) v(area_name, lvl) JOIN x_application_areas a ON a.area_name = v.area_name
   UNION ALL SELECT 'NATION_0', id, 'Admin' FROM x_application_areas)
SELECT g.id, g.group_oid, g.area_id,
  CASE WHEN s.group_oid IS NOT NULL AND s.access_level <> g.access_level THEN s.access_level ELSE g.access_level END AS access_level
FROM x_group_area_rights g LEFT JOIN src s ON s.group_oid = g.group_oid AND s.area_id = g.area_id
UNION ALL SELECT CAST((SELECT max(id) FROM x_group_area_rights) + ROW_NUMBER() OVER (ORDER BY s.group_oid, s.area_id) AS BIGINT),
  s.group_oid, s.area_id, s.access_level FROM src s
WHERE NOT EXISTS (SELECT 1 FROM x_group_area_rights g WHERE g.group_oid = s.group_oid AND g.area_id = s.area_id)"""

UNDO_BASE = """
, cmd AS (SELECT id AS harvest_id, request_id FROM x_product_harvest
   WHERE id IN (SELECT harvest_id FROM x_product_tracking WHERE current_stage_id = 1)),
ch AS (SELECT r.id AS record_id, r.status AS old_value FROM x_product_requests r JOIN cmd c ON c.request_id = r.id
   WHERE COALESCE(r.status, 'None') <> 'Pending')
"""
UNDO_REQ = UNDO_BASE + """
SELECT r.id, r.requested_by, r.sku_id, r.lot_number, CASE WHEN ch.record_id IS NOT NULL THEN 'Pending' ELSE r.status END AS status,
  r.requested_at, r.notes, r.is_tech_transfer FROM x_product_requests r LEFT JOIN ch ON ch.record_id = r.id"""
UNDO_AUDIT = UNDO_BASE + f"""
SELECT CAST((SELECT max(id) FROM x_audit_log) + ROW_NUMBER() OVER (ORDER BY record_id) AS BIGINT) AS id, 'product_requests' AS table_name,
  record_id, 'status' AS field_name, COALESCE(old_value, 'None') AS old_value, 'Pending' AS new_value, 'printed in error' AS reason,
  CAST(1 AS BIGINT) AS changed_by, {AS_OF_SQL} AS changed_at FROM ch"""
UNDO_TRACK = UNDO_BASE + " SELECT * FROM x_product_tracking WHERE harvest_id NOT IN (SELECT harvest_id FROM cmd)"

RM_BASE = """
, cmd AS (SELECT tbp.id AS batch_product_id, tbp.product_tracking_id FROM x_treatment_batch_products tbp
   JOIN x_treatment_batches tb ON tb.id = tbp.batch_id AND tb.status = 'Shipped')
"""
RM_LINKS = RM_BASE + " SELECT * FROM x_treatment_batch_products WHERE id NOT IN (SELECT batch_product_id FROM cmd)"
RM_AUDIT = RM_BASE + f"""
SELECT CAST((SELECT max(id) FROM x_audit_log) + ROW_NUMBER() OVER (ORDER BY batch_product_id) AS BIGINT) AS id,
  'treatment_batch_products' AS table_name, batch_product_id AS record_id, 'DELETED' AS field_name, 'No' AS old_value,
  'Yes' AS new_value, 'wrong batch' AS reason, CAST(1 AS BIGINT) AS changed_by, {AS_OF_SQL} AS changed_at FROM cmd"""
RM_TRACK = RM_BASE + f"""
SELECT {_tracking_select("CASE WHEN c.product_tracking_id IS NOT NULL THEN (SELECT min(id) FROM x_lifecycle_stages WHERE stage_code = 'QMTreatmentApproval') ELSE t.current_stage_id END",
                         't.current_status_id', 'c.product_tracking_id IS NOT NULL')}
FROM x_product_tracking t LEFT JOIN cmd c ON c.product_tracking_id = t.id"""

_M1 = _M["filaments_in_storage"]
ACCL = f"""
, cmd AS (SELECT DISTINCT id AS filament_tracking_id FROM ({_M1}) x)
SELECT CAST((SELECT max(id) FROM x_filament_acclimatization) + ROW_NUMBER() OVER (ORDER BY filament_tracking_id) AS BIGINT) AS id,
  filament_tracking_id, CAST(1 AS BIGINT) AS moved_by, {AS_OF_SQL} AS moved_at, {AS_OF_SQL} + INTERVAL 2 DAY AS ready_at,
  'Acclimatizing' AS status FROM cmd"""

DEL_ACCL = f"""
, ch AS (SELECT id AS record_id, 'status' AS field_name, COALESCE(status, 'None') AS old_value, 0 AS seq
   FROM x_filament_acclimatization WHERE status = 'Acclimatizing'
   UNION ALL SELECT id, 'moved_at', COALESCE(strftime(moved_at, '%Y-%m-%d %H:%M:%S'), 'None'), 1 FROM x_filament_acclimatization WHERE status = 'Acclimatizing'
   UNION ALL SELECT id, 'moved_by', COALESCE(CAST(moved_by AS VARCHAR), 'None'), 2 FROM x_filament_acclimatization WHERE status = 'Acclimatizing')
SELECT CAST((SELECT max(id) FROM x_audit_log) + ROW_NUMBER() OVER (ORDER BY record_id, field_name, seq) AS BIGINT) AS id,
  'filament_acclimatization' AS table_name, record_id, field_name, old_value, 'DELETED' AS new_value, 'entered twice' AS reason,
  CAST(1 AS BIGINT) AS changed_by, {AS_OF_SQL} AS changed_at FROM ch WHERE old_value <> 'DELETED'"""

RESTORE_BASE = """
, ch AS (SELECT id AS record_id, 'unmounted_at' AS field_name, strftime(unmounted_at, '%Y-%m-%d %H:%M:%S') AS old_value,
   CAST(NULL AS VARCHAR) AS new_value, 0 AS seq FROM x_filament_mounting WHERE unmounted_at IS NOT NULL
   UNION ALL SELECT id, 'unmounted_by', CAST(unmounted_by AS VARCHAR), NULL, 1 FROM x_filament_mounting WHERE unmounted_at IS NOT NULL
   UNION ALL SELECT id, 'status', status, 'In Use', 2 FROM x_filament_mounting WHERE unmounted_at IS NOT NULL),
eff AS (SELECT * FROM ch WHERE COALESCE(old_value, 'None') <> COALESCE(new_value, 'None'))
"""
RESTORE = RESTORE_BASE + """
SELECT m.id, m.filament_tracking_id, m.printer_id, m.mounted_by, m.mounted_at,
  CASE WHEN a.record_id IS NOT NULL THEN NULL ELSE m.unmounted_at END AS unmounted_at,
  CASE WHEN b.record_id IS NOT NULL THEN NULL ELSE m.unmounted_by END AS unmounted_by, m.remaining_weight,
  CASE WHEN s.record_id IS NOT NULL THEN s.new_value ELSE m.status END AS status
FROM x_filament_mounting m LEFT JOIN eff a ON a.record_id = m.id AND a.field_name = 'unmounted_at'
LEFT JOIN eff b ON b.record_id = m.id AND b.field_name = 'unmounted_by' LEFT JOIN eff s ON s.record_id = m.id AND s.field_name = 'status'"""
RESTORE_AUDIT = RESTORE_BASE + f"""
SELECT CAST((SELECT max(id) FROM x_audit_log) + ROW_NUMBER() OVER (ORDER BY record_id, field_name, seq) AS BIGINT) AS id,
  'filament_mounting' AS table_name, record_id, field_name, COALESCE(old_value, 'None') AS old_value,
  COALESCE(new_value, 'None') AS new_value, 'unmounted by mistake' AS reason, CAST(1 AS BIGINT) AS changed_by,
  {AS_OF_SQL} AS changed_at FROM eff"""

SQL.update({
    "apply_harvest_undo": UNDO_REQ, "apply_harvest_undo_audit": UNDO_AUDIT, "apply_harvest_undo_tracking": UNDO_TRACK,
    "apply_harvest_undo_records": UNDO_BASE + " SELECT * FROM x_product_harvest WHERE id NOT IN (SELECT harvest_id FROM cmd)",
    "apply_remove_from_batch_history": _history(RM_BASE, "cmd", _stage("QMTreatmentApproval"), "'Removed from treatment batch'", "1"),
    "apply_delete_acclimatization_table": "SELECT * FROM x_filament_acclimatization WHERE status IS DISTINCT FROM 'Acclimatizing'",
    "apply_remove_from_batch": RM_LINKS, "apply_remove_from_batch_tracking": RM_TRACK,
    "apply_remove_from_batch_audit": RM_AUDIT, "apply_acclimatize": ACCL, "apply_delete_acclimatization": DEL_ACCL,
    "apply_restore_mount": RESTORE, "apply_restore_mount_audit": RESTORE_AUDIT,
})

SKU_BASE = """
, rows AS (SELECT trim(' NEW-' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || ' ') AS sku, trim('Line ' || p_brand) AS name,
   CAST(1 + min(p_partkey) % 4 AS BIGINT) AS product_type_id, TRUE AS is_serialized, min(p_partkey) % 3 = 0 AS is_bundle,
   CAST(1 + min(p_partkey) % 5 AS BIGINT) AS pack_qty FROM part GROUP BY p_brand
   UNION ALL SELECT 'GEB-CSmTD', 'TriDock again', 4, FALSE, FALSE, 1
   UNION ALL SELECT 'NEW-NONAME', '', 1, TRUE, FALSE, 1),
chk AS (SELECT *, CASE WHEN sku IS NULL OR sku = '' OR name IS NULL OR name = '' THEN 'SKU and name are required.'
   WHEN pack_qty <= 0 THEN 'pack_qty must be > 0.' END AS why0 FROM rows),
dup AS (SELECT sku FROM chk WHERE why0 IS NULL GROUP BY sku HAVING count(*) > 1),
chk2 AS (SELECT *, COALESCE(why0, CASE WHEN sku IN (SELECT sku FROM x_product_skus) THEN 'SKU ' || chr(39) || sku || chr(39) || ' already exists.'
   WHEN sku IN (SELECT sku FROM dup) THEN 'SKU repeated in the request.' END) AS why FROM chk)
"""
SQL["apply_sku_create"] = SKU_BASE + """
SELECT CAST((SELECT max(id) FROM x_product_skus) + ROW_NUMBER() OVER (ORDER BY sku) AS BIGINT) AS id, product_type_id, sku, name,
  is_serialized, is_bundle, CAST(CASE WHEN is_bundle THEN pack_qty ELSE 1 END AS BIGINT) AS pack_qty, TRUE AS is_active
FROM chk2 WHERE why IS NULL"""
SQL["apply_sku_create_rejected"] = SKU_BASE + " SELECT sku, why FROM chk2 WHERE why IS NOT NULL"

SKU_UPD_BASE = """
, pend AS (SELECT sku_id, count(*) > 0 AS act FROM x_product_requests WHERE status = 'Pending' GROUP BY sku_id),
ch AS (SELECT s.id AS record_id, CASE WHEN s.is_active THEN 'true' ELSE 'false' END AS old_value,
   CASE WHEN COALESCE(p.act, FALSE) THEN 'true' ELSE 'false' END AS new_value
   FROM x_product_skus s LEFT JOIN pend p ON p.sku_id = s.id),
eff AS (SELECT * FROM ch WHERE old_value <> new_value)
"""
SQL["apply_sku_update"] = SKU_UPD_BASE + """
SELECT s.id, s.product_type_id, s.sku, s.name, s.is_serialized, s.is_bundle, s.pack_qty,
  CASE WHEN e.record_id IS NOT NULL THEN e.new_value = 'true' ELSE s.is_active END AS is_active
FROM x_product_skus s LEFT JOIN eff e ON e.record_id = s.id"""
SQL["apply_sku_update_audit"] = SKU_UPD_BASE + """
SELECT CAST((SELECT max(id) FROM x_audit_log) + ROW_NUMBER() OVER (ORDER BY record_id) AS BIGINT) AS id, 'product_skus' AS table_name,
  record_id, 'is_active' AS field_name, old_value, new_value, 'activity review' AS reason, CAST(1 AS BIGINT) AS changed_by,
  TIMESTAMP '2000-06-30 00:00:00' AS changed_at FROM eff"""

# the shelves of units that the ad-hoc quarantine above has just taken in
from spooltrace.oracle.sql_operations import _shelves  # noqa: E402

_AFTER = _G["needs_storage_adhoc"].replace("x_product_tracking", "units_after").replace("x_quarantined_products", "held_after")
SQL["shelf_options_adhoc"] = K10_CMD + f"""
, units_after AS ({K10_TRACK[len(K10_CMD):]}),
held_after AS (SELECT * FROM x_quarantined_products UNION ALL ({K10_ROWS[len(K10_CMD):]}))
""" + _shelves(_AFTER, "AdHoc Quarantine")
