"""Oracle SQL (DuckDB) for order creation, request cancel, storage edits, new spools and seals, seal edits."""

from spooltrace.oracle.prelude import AS_OF_SQL
from spooltrace.oracle.sql_materials import SQL as _M

_ORDERS = f"""
, again AS (SELECT w.customer_id, i.product_sku_id, sum(i.quantity) - 20 AS qty
   FROM x_orders w JOIN x_order_items i ON i.order_id = w.id WHERE w.status = 'Canceled' GROUP BY ALL),
buyers AS (SELECT DISTINCT customer_id FROM x_orders WHERE status = 'Canceled'),
made AS (SELECT CAST((SELECT max(id) FROM x_orders) + ROW_NUMBER() OVER (ORDER BY customer_id) AS BIGINT) AS id, customer_id FROM buyers)
"""

_EDIT = f"""
, hit AS (SELECT t.id, t.location_id, s.stage_name, t.current_stage_id FROM x_product_tracking t
   JOIN x_lifecycle_stages s ON s.id = t.current_stage_id AND s.stage_code = 'InInterimStorage'),
target AS (SELECT min(id) AS sid FROM x_lifecycle_stages WHERE stage_name = 'Stored; Pending QM Approval')
"""

_SPOOL_NO = "CAST(s_suppkey * 7 + CASE WHEN s_suppkey % 2 = 0 THEN 5000 ELSE 9000000 END AS BIGINT)"
_SPOOLS = f"""
, n AS (SELECT {_SPOOL_NO} AS no, s_suppkey, s_nationkey FROM supplier),
fine AS (SELECT * FROM n WHERE no NOT IN (SELECT filament_id FROM x_filaments WHERE filament_id IS NOT NULL)
   AND no IN (SELECT no FROM n GROUP BY no HAVING count(*) = 1))
"""

_SEALS = """
, n AS (SELECT 'SEAL' || (min(p_partkey) % 150) AS sn, min(p_partkey) AS k, count(*) AS parts FROM part GROUP BY p_brand),
fine AS (SELECT * FROM n WHERE sn NOT IN (SELECT serial_number FROM x_seals) AND sn IN (SELECT sn FROM n GROUP BY sn HAVING count(*) = 1))
"""


def _rejected(key: str, name: str, table: str, column: str) -> str:
    return f""" SELECT {key} AS {name}, 'exists' AS why FROM n WHERE {key} IN (SELECT {column} FROM {table})
UNION ALL SELECT {key}, 'repeated' FROM n GROUP BY {key} HAVING count(*) > 1"""


def _nested(sql: str) -> str:
    sql = sql.strip()
    return f"WITH z0 AS (SELECT 1) {sql}" if sql.startswith(",") else sql


_RECOUNT = f"""
, rest AS ({_nested(_M['seal_remaining'])}),
ch AS (SELECT s.id, s.quantity AS was, r.remaining_units AS new FROM x_seals s JOIN rest r ON r.serial_number = s.serial_number
   WHERE r.remaining_units <> s.quantity)
"""

_SECOND = """
, look AS (SELECT id, product_tracking_id AS unit, qc_result AS was,
   ['B-Ware', 'Quarantine', 'Waste', 'Passed'][list_position(['Passed', 'B-Ware', 'Quarantine', 'Waste'], qc_result)] AS new
   FROM x_post_treatment_inspections),
eff AS (SELECT * FROM look WHERE COALESCE(was, 'None') <> COALESCE(new, 'None')),
names AS (SELECT * FROM (VALUES ('Passed', 'A-Ware'), ('B-Ware', 'B-Ware'), ('Quarantine', 'In Quarantine'), ('Waste', 'Waste')) v(r, n)),
sts AS (SELECT e.unit, min(s.id) AS sid FROM eff e LEFT JOIN names ON r = e.new JOIN x_product_statuses s
   ON s.status_name = COALESCE(n, 'Pending') GROUP BY e.unit),
held AS (SELECT e.unit, t.current_stage_id AS stage FROM eff e JOIN x_product_tracking t ON t.id = e.unit WHERE e.new = 'Quarantine'),
qs AS (SELECT min(id) AS sid FROM x_lifecycle_stages WHERE stage_code = 'Quarantine')
"""

SQL = {
    "apply_post_treatment_edit": _SECOND + """SELECT p.* REPLACE (COALESCE(e.new, p.qc_result) AS qc_result)
FROM x_post_treatment_inspections p LEFT JOIN eff e USING (id)""",
    "apply_post_treatment_edit_audit": _SECOND + f"""SELECT CAST((SELECT max(id) FROM x_audit_log) + ROW_NUMBER() OVER (ORDER BY id) AS BIGINT) AS id,
  'post_treatment_inspections' AS table_name, id AS record_id, 'qc_result' AS field_name, COALESCE(was, 'None') AS old_value,
  COALESCE(new, 'None') AS new_value, 'second look' AS reason, CAST(3 AS BIGINT) AS changed_by, {AS_OF_SQL} AS changed_at FROM eff""",
    "apply_post_treatment_edit_tracking": _SECOND + f"""SELECT t.* REPLACE (
  if(h.unit IS NULL, t.previous_stage_id, t.current_stage_id) AS previous_stage_id,
  if(h.unit IS NULL, t.current_stage_id, (SELECT sid FROM qs)) AS current_stage_id, COALESCE(s.sid, t.current_status_id) AS current_status_id,
  if(s.unit IS NULL AND h.unit IS NULL, t.last_updated_at, {AS_OF_SQL}) AS last_updated_at)
FROM x_product_tracking t LEFT JOIN sts s ON s.unit = t.id LEFT JOIN held h ON h.unit = t.id""",
    "apply_post_treatment_edit_history": _SECOND + f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY unit) AS BIGINT) AS id, unit AS product_tracking_id,
  stage AS from_stage_id, (SELECT sid FROM qs) AS to_stage_id, 'Moved to quarantine' AS reason, CAST(3 AS BIGINT) AS changed_by,
  {AS_OF_SQL} AS changed_at FROM held""",
    "apply_post_treatment_edit_quarantine": _SECOND + f"""SELECT CAST((SELECT max(id) FROM x_quarantined_products)
  + ROW_NUMBER() OVER (ORDER BY unit) AS BIGINT) AS id, unit AS product_tracking_id, stage AS from_stage_id, 'Post-Treatment QC' AS source,
  CAST(NULL AS BIGINT) AS location_id, {AS_OF_SQL} AS quarantine_date, CAST(3 AS BIGINT) AS quarantined_by,
  'second look' AS quarantine_reason, 'Active' AS quarantine_status, CAST(NULL AS VARCHAR) AS result,
  CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS BIGINT) AS resolved_by FROM held""",
    "apply_order_create": _ORDERS + f"""SELECT id, CAST(NULL AS BIGINT) AS parent_order_id, customer_id, {AS_OF_SQL} AS order_date,
  CAST(1 AS BIGINT) AS order_creator_id, 'Processing' AS status, CAST(NULL AS TIMESTAMP) AS updated_at,
  CAST(1 AS BIGINT) AS updated_by, 'ordered again' AS notes FROM made""",
    "apply_order_create_items": _ORDERS + """SELECT CAST((SELECT max(id) FROM x_order_items)
  + ROW_NUMBER() OVER (ORDER BY made.id, product_sku_id) AS BIGINT) AS id, made.id AS order_id, product_sku_id,
  CAST(qty AS BIGINT) AS quantity FROM again JOIN made USING (customer_id) WHERE qty > 0""",
    "apply_request_cancel": """SELECT * REPLACE (if(status = 'Pending' AND is_tech_transfer, 'Cancelled', status) AS status)
FROM x_product_requests""",
    "apply_storage_edit": _EDIT + f"""SELECT t.* REPLACE (if(t.id IN (SELECT id FROM hit), 3, t.location_id)::BIGINT AS location_id,
  if(t.id IN (SELECT id FROM hit), (SELECT sid FROM target), t.current_stage_id) AS current_stage_id,
  if(t.id IN (SELECT id FROM hit), {AS_OF_SQL}, t.last_updated_at) AS last_updated_at) FROM x_product_tracking t""",
    "apply_storage_edit_history": _EDIT + f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY id) AS BIGINT) AS id, id AS product_tracking_id,
  current_stage_id AS from_stage_id, (SELECT sid FROM target) AS to_stage_id, 'Update from storage location edit.' AS reason,
  CAST(2 AS BIGINT) AS changed_by, {AS_OF_SQL} AS changed_at FROM hit""",
    "apply_storage_edit_audit": _EDIT + f""", ch AS (
  SELECT id, 'location_id' AS field, COALESCE(CAST(location_id AS VARCHAR), 'None') AS old, '3' AS new FROM hit
  UNION ALL SELECT id, 'current_status', stage_name, 'Stored; Pending QM Approval' FROM hit)
SELECT CAST((SELECT max(id) FROM x_audit_log) + ROW_NUMBER() OVER (ORDER BY id, field) AS BIGINT) AS id, 'product_tracking' AS table_name,
  id AS record_id, field AS field_name, old AS old_value, new AS new_value, 'shelf check' AS reason, CAST(2 AS INTEGER) AS changed_by,
  {AS_OF_SQL} AS changed_at FROM ch WHERE old <> new""",
    "apply_new_spools": _SPOOLS + f"""SELECT CAST((SELECT max(id) FROM x_filaments) + ROW_NUMBER() OVER (ORDER BY no) AS BIGINT) AS id,
  no AS filament_id, 'N' || no AS serial_number, 'N' || (s_suppkey % 9) AS lot_number, CAST(1 + s_nationkey AS BIGINT) AS location_id,
  CAST(1000 AS DECIMAL(10,2)) AS weight_grams, {AS_OF_SQL} AS received_at, CAST(1 AS BIGINT) AS received_by, 'PASS' AS qc_result
FROM fine""",
    "apply_new_spools_rejected": _SPOOLS + _rejected("no", "filament_id", "x_filaments", "filament_id"),
    "apply_new_seals": _SEALS + f"""SELECT CAST((SELECT max(id) FROM x_seals) + ROW_NUMBER() OVER (ORDER BY sn) AS BIGINT) AS id,
  sn AS serial_number, CAST(50 + parts AS BIGINT) AS quantity, CAST(1 + k % 25 AS BIGINT) AS location_id, {AS_OF_SQL} AS received_at,
  CAST(1 AS BIGINT) AS received_by, 'PASS' AS qc_result FROM fine""",
    "apply_new_seals_rejected": _SEALS + _rejected("sn", "serial_number", "x_seals", "serial_number"),
    "apply_seal_edit": _RECOUNT + "SELECT s.* REPLACE (COALESCE(ch.new, s.quantity) AS quantity) FROM x_seals s LEFT JOIN ch ON ch.id = s.id",
    "apply_seal_edit_audit": _RECOUNT + f"""SELECT CAST((SELECT max(id) FROM x_audit_log) + ROW_NUMBER() OVER (ORDER BY id) AS BIGINT) AS id,
  'seals' AS table_name, id AS record_id, 'quantity' AS field_name, CAST(was AS VARCHAR) AS old_value, CAST(new AS VARCHAR) AS new_value,
  'recount' AS reason, CAST(1 AS INTEGER) AS changed_by, {AS_OF_SQL} AS changed_at FROM ch""",
}
