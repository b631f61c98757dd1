"""Oracle SQL (DuckDB) for the generic operator queries."""

from spooltrace.oracle.sql_etl import LOCS
from spooltrace.oracle.sql_sales import SQL as _H
from spooltrace.oracle.sql_transitions import _login, _users_round
from spooltrace.sources.fixtures import Tables

RESTOCK = """
, restock AS (SELECT u.lot_number AS serial_number, CAST(COALESCE(l.quantity, 0) + u.n AS BIGINT) AS quantity
   FROM (SELECT lot_number, count(*) AS n FROM x_material_usage WHERE material_type = 'Lid' GROUP BY lot_number) u
   LEFT JOIN x_lids l ON l.serial_number = u.lot_number)
"""

# parts whose label is not blank head the columns of their type's sheet, if they are two or more
_HEADERS = """
, labels AS (SELECT p_type AS sheet, p_partkey AS position, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_name || chr(9)
     WHEN 1 THEN replace(p_name, ' ', chr(10)) WHEN 2 THEN upper(replace(p_name, ' ', '   '))
     ELSE replace(p_name, ' ', '-') || ' [' || p_brand || ']' END AS label FROM part WHERE p_size <> 1),
heads AS (SELECT sheet, position, trim(label, chr(9) || chr(10) || ' ') AS raw_header,
   replace(replace(replace(replace(replace(lower(trim(replace(label, chr(10), ' '), chr(9) || ' ')), '  ', ' '), ' ', '_'), '-', '_'), '[', ''), ']', '') AS normalized
   FROM labels WHERE sheet IN (SELECT sheet FROM labels GROUP BY sheet HAVING count(*) > 1))
"""

SQL = {
    "assign_ids": """SELECT _event_id AS event_id, product_id,
  CAST(ROW_NUMBER() OVER (ORDER BY product_id, _event_id) AS BIGINT) AS id FROM x_stg_excel_data_id""",
    "global_row_number": """SELECT id, last_updated_at, CAST(ROW_NUMBER() OVER (ORDER BY last_updated_at, id) AS BIGINT) AS rn
FROM x_product_tracking""",
    "merge_upsert": RESTOCK + """
SELECT l.id, l.serial_number, COALESCE(r.quantity, l.quantity) AS quantity, l.location_id, l.received_at, l.received_by, l.qc_result
FROM x_lids l LEFT JOIN restock r ON r.serial_number = l.serial_number
UNION ALL SELECT CAST((SELECT max(id) FROM x_lids) + ROW_NUMBER() OVER (ORDER BY r.serial_number) AS BIGINT), r.serial_number,
  r.quantity, CAST(1 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), 'PASS'
FROM restock r WHERE r.serial_number NOT IN (SELECT serial_number FROM x_lids)""",
    "merge_outcome": RESTOCK + """
SELECT CASE WHEN r.serial_number IN (SELECT serial_number FROM x_lids) THEN 'UPDATE' ELSE 'INSERT' END AS action,
  CAST(count(*) AS BIGINT) AS n FROM restock r GROUP BY 1""",
    "insert_missing": """
, lots AS (SELECT DISTINCT lot_number AS serial_number FROM x_material_usage WHERE material_type = 'Seal')
SELECT * FROM x_seals UNION ALL
SELECT CAST((SELECT max(id) FROM x_seals) + ROW_NUMBER() OVER (ORDER BY serial_number) AS BIGINT), serial_number, CAST(0 AS BIGINT),
  CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), 'PASS'
FROM lots WHERE serial_number NOT IN (SELECT serial_number FROM x_seals)""",
    "earliest_per_key": """SELECT product_tracking_id, used_at, id, material_type, lot_number, used_quantity FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product_tracking_id ORDER BY used_at, id, material_type, lot_number, used_quantity) AS rk
  FROM x_material_usage) WHERE rk = 1""",
    "next_tracking_id": "SELECT CAST(COALESCE(max(product_id) + 1, 1000000) AS BIGINT) AS next_id FROM x_product_tracking",
    "ensure_default_rows": LOCS + """
, legreq AS (SELECT t.name AS product_name, min(pr.id) AS request_id FROM x_product_requests pr
   JOIN x_product_skus s ON pr.sku_id = s.id JOIN x_product_types t ON s.product_type_id = t.id
   WHERE pr.lot_number = 'LEGACY_LOT' GROUP BY t.name)
SELECT 'storage_locations' AS kind, location_name AS name, id FROM locs WHERE location_name IN ('Unassigned', 'Waste', 'Offsite')
UNION ALL SELECT 'users', 'Legacy Import (System)', COALESCE((SELECT min(id) FROM x_users WHERE user_principal_name = 'legacy-import@system'),
  (SELECT max(id) + 1 FROM x_users))
UNION ALL SELECT 'product_requests', product_name, request_id FROM legreq""",
    "load_staging": "SELECT * FROM x_stg_filament_excel_data",
    "export_csv": "SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(product_type_id AS VARCHAR) AS product_type_id, product_type, "
                  "CAST(quantity AS VARCHAR) AS quantity FROM (" + _H["canceled_order_items"] + ") x",
    "stage_headers": _HEADERS + "SELECT sheet, position, raw_header, normalized FROM heads",
    "stage_dedupe_columns": _HEADERS + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY sheet, normalized ORDER BY position) AS n FROM heads),
named AS (SELECT sheet, position, normalized || CASE WHEN n = 1 THEN '' ELSE '_' || (n - 1) END AS final_name FROM numbered)
SELECT sheet, position, final_name, count(*) OVER (PARTITION BY sheet, final_name) > 1 AS clash FROM named""",
    "user_lookup": ", " + _users_round("x_users", _login(1), "u1") + """
, em AS (SELECT ' USER' || CAST(s_suppkey AS VARCHAR) || '@PLANT.EXAMPLE ' AS email FROM supplier)
SELECT em.email, u.id, u.display_name FROM em JOIN u1 u ON lower(trim(em.email)) = u.user_principal_name""",
}

SQL["xl_staging_schema"] = "SELECT treatment_id, in_treatment, run_date, operator FROM x_stg_treatment_excel_data"
_STG_COLS = ["product_id", "filament_id", "printer", "operator_harvest", "date_harvest", "product", "storage",
             "status_quality_check", "second_rate_goods", "prozess_step", "operater_quality_check", "date_of_quality_check",
             "weight_check_g", "pressure_drop_check_mbar", "visual_check", "comment", "transfer_id",
             "operator_visual_check_incoming_goods", "date_of_visual_check_incoming_goods", "visual_check_1",
             "surface_treatment", "sterilization"]
SQL["stage_drop_empty"] = ("SELECT " + ", ".join(f"{n} AS p{i}" for i, n in enumerate(_STG_COLS)) + " FROM x_stg_excel_data "
                           "WHERE NOT (" + " AND ".join(f"{n} IS NULL" for n in _STG_COLS) + ")")
_CELLS = " || chr(31) || ".join(f"COALESCE('=' || CAST({n} AS VARCHAR), '')" for n in _STG_COLS)
SQL["content_digest"] = f"""
, h AS (SELECT CAST('0x' || left(md5({_CELLS}), 15) AS BIGINT) AS h FROM x_stg_excel_data)
SELECT count(*) AS rows, CAST(COALESCE(sum(CAST(h AS HUGEINT)), 0) AS VARCHAR) AS hash_sum, COALESCE(bit_xor(h), 0) AS hash_xor FROM h"""
