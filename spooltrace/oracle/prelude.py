"""DuckDB prelude: the fixture tables as CTEs (FIXTURES.md), plus literal dims.

``with_prelude(body)`` returns ``WITH <all ctes> <body>``; DuckDB drops the
CTEs a query does not reference. Table names in oracle bodies are ``x_<table>``.
"""

from __future__ import annotations

from spooltrace.sources.dims import DIM_NAMES, dim_sql

AS_OF_SQL = "TIMESTAMP '2000-06-30 00:00:00'"
CUTOFF_SQL = "DATE '2024-01-10'"

FIXTURE_CTES = r"""
x_users AS (
  SELECT CAST(s_suppkey + 1 AS BIGINT) AS id, 'Op ' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS display_name,
         CAST(1 + s_suppkey % 5 AS BIGINT) AS department_id, s_suppkey % 9 <> 0 AS is_active,
         CAST(NULL AS VARCHAR) AS azure_ad_object_id, CAST(NULL AS VARCHAR) AS user_principal_name
  FROM supplier),
x_customers AS (
  SELECT CAST(c_custkey + 1 AS BIGINT) AS id, c_name AS customer_name FROM customer),
x_filaments AS (
  SELECT CAST(p_partkey + 1 AS BIGINT) AS id, CAST(5000 + p_partkey AS BIGINT) AS filament_id,
         'L' || CAST(p_partkey // 4 AS VARCHAR) || '-' || CAST(p_partkey AS VARCHAR) AS serial_number,
         'L' || CAST(p_partkey // 4 AS VARCHAR) AS lot_number, CAST(1 + p_partkey % 25 AS BIGINT) AS location_id,
         CAST(100 + (p_partkey * 37) % 4900 AS DECIMAL(10,2)) AS weight_grams,
         TIMESTAMP '1999-01-01' + to_days(CAST(p_partkey % 500 AS INTEGER)) AS received_at,
         CAST(1 + p_partkey % 10 AS BIGINT) AS received_by,
         CASE WHEN p_partkey % 13 = 0 THEN 'FAIL' ELSE 'PASS' END AS qc_result
  FROM part),
x_filament_mounting AS (
  SELECT CAST(p_partkey + 1 AS BIGINT) AS id, CAST(p_partkey + 1 AS BIGINT) AS filament_tracking_id,
         CAST(1 + p_partkey % 7 AS BIGINT) AS printer_id, CAST(1 + p_partkey % 10 AS BIGINT) AS mounted_by,
         TIMESTAMP '1999-02-01' + to_days(CAST(p_partkey % 500 AS INTEGER)) AS mounted_at,
         CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 6 THEN TIMESTAMP '1999-03-01' + to_days(CAST(p_partkey % 500 AS INTEGER)) END AS unmounted_at,
         CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 6 THEN CAST(1 + p_partkey % 9 AS BIGINT) END AS unmounted_by,
         CAST((p_partkey * 53) % 3500 AS DECIMAL(10,2)) AS remaining_weight,
         CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 6 THEN 'Unmounted' ELSE 'In Use' END AS status
  FROM part WHERE p_partkey % 5 <> 4),
x_filament_acclimatization AS (
  SELECT CAST(p_partkey + 1 AS BIGINT) AS id, CAST(p_partkey + 1 AS BIGINT) AS filament_tracking_id,
         CAST(1 + p_partkey % 10 AS BIGINT) AS moved_by,
         TIMESTAMP '2000-06-01' + to_days(CAST(p_partkey % 40 AS INTEGER)) AS moved_at,
         TIMESTAMP '2000-06-03' + to_days(CAST(p_partkey % 40 AS INTEGER)) AS ready_at,
         CASE WHEN p_partkey % 10 = 9 THEN 'Complete' ELSE 'Acclimatizing' END AS status
  FROM part WHERE p_partkey % 5 = 4 AND p_partkey % 4 <> 0),
x_lids AS (
  SELECT CAST(s_suppkey + 1 AS BIGINT) AS id,
         CASE WHEN s_suppkey = 0 THEN 'LEGACY_LID' ELSE 'LID' || CAST(s_suppkey AS VARCHAR) END AS serial_number,
         CAST(500 + (s_suppkey * 7) % 300 AS BIGINT) AS quantity, CAST(1 + s_suppkey % 25 AS BIGINT) AS location_id,
         TIMESTAMP '1999-01-01' + to_days(CAST(s_suppkey % 300 AS INTEGER)) AS received_at,
         CAST(1 + s_suppkey % 10 AS BIGINT) AS received_by,
         CASE WHEN s_suppkey % 6 = 5 THEN 'FAIL' ELSE 'PASS' END AS qc_result
  FROM supplier),
x_seals AS (
  SELECT id, CASE WHEN id = 1 THEN 'LEGACY_SEAL' ELSE 'SEAL' || CAST(id AS VARCHAR) END AS serial_number,
         quantity + 11 AS quantity, location_id, received_at, received_by, qc_result FROM x_lids),
x_product_requests AS (
  SELECT CAST(o_orderkey + 1 AS BIGINT) AS id, CAST(1 + o_custkey % 10 AS BIGINT) AS requested_by,
         CAST(1 + o_custkey % 7 AS BIGINT) AS sku_id,
         CASE WHEN o_orderkey % 17 = 0 THEN 'LEGACY_LOT' ELSE '00' || lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') END AS lot_number,
         CASE WHEN o_orderkey % 5 = 0 THEN 'Pending' WHEN o_orderkey % 5 = 1 THEN 'Cancelled' ELSE 'Fulfilled' END AS status,
         o_orderdate AS requested_at, CAST(NULL AS VARCHAR) AS notes, o_orderkey % 19 = 0 AS is_tech_transfer
  FROM orders),
x_product_harvest AS (
  SELECT CAST(o.o_orderkey + 1 AS BIGINT) AS id, CAST(o.o_orderkey + 1 AS BIGINT) AS request_id,
         CAST(1 + o.o_orderkey % 10 AS BIGINT) AS lid_id, CAST(1 + o.o_orderkey % 9 AS BIGINT) AS seal_id,
         CAST(1 + 5 * (o.o_orderkey % 40) AS BIGINT) AS filament_mounting_id,
         CAST(1 + o.o_orderkey % 10 AS BIGINT) AS printed_by, o.o_orderdate AS print_date
  FROM orders o WHERE o.o_orderkey % 5 >= 2),
x_product_tracking AS (
  SELECT CAST(o_orderkey + 1 AS BIGINT) AS id, CAST(o_orderkey + 1 AS BIGINT) AS harvest_id,
         CAST(1000000 + o_orderkey AS BIGINT) AS product_id,
         CAST(CASE 1 + o_custkey % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 7 THEN 4 ELSE 3 END AS BIGINT) AS product_type_id,
         CAST(1 + o_custkey % 7 AS BIGINT) AS sku_id,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(1 + (o_orderkey // 3) % 5 AS BIGINT) END AS current_status_id,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(1 + (o_orderkey // 2) % 14 AS BIGINT) END AS previous_stage_id,
         CAST(1 + (o_orderkey // 5) % 14 AS BIGINT) AS current_stage_id,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 25 AS BIGINT) END AS location_id,
         o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS last_updated_at,
         CAST(NULL AS VARCHAR) AS product_code,
         o_orderkey % 19 = 0 AS was_tech_transfer
  FROM orders WHERE o_orderkey % 5 >= 2),
x_product_quality_control AS (
  SELECT t.id AS id, t.id AS product_tracking_id, CAST(1 + t.id % 10 AS BIGINT) AS inspected_by,
         t.last_updated_at AS inspected_at, CAST(500 + (t.id * 31) % 600 AS DECIMAL(6,2)) AS weight_grams,
         CAST((t.id * 13) % 9 AS DECIMAL(6,3)) AS pressure_drop, t.id % 8 <> 0 AS visual_pass,
         CASE t.id % 7 WHEN 0 THEN 'Waste' WHEN 1 THEN 'B-Ware' WHEN 2 THEN 'Quarantine' ELSE 'Passed' END AS inspection_result,
         CAST(NULL AS VARCHAR) AS notes
  FROM x_product_tracking t WHERE t.id % 6 <> 0),
x_material_usage AS (
  SELECT CAST(l.l_orderkey * 8 + l.l_linenumber AS BIGINT) AS id, t.id AS product_tracking_id, t.harvest_id,
         CASE l.l_linenumber % 3 WHEN 0 THEN 'Filament' WHEN 1 THEN 'Lid' ELSE 'Seal' END AS material_type,
         CASE l.l_linenumber % 3 WHEN 0 THEN 'L' || CAST(l.l_partkey // 4 AS VARCHAR)
              WHEN 1 THEN 'LID' || CAST(l.l_suppkey AS VARCHAR) ELSE 'SEAL' || CAST(l.l_suppkey + 1 AS VARCHAR) END AS lot_number,
         CAST(l.l_quantity AS DECIMAL(10,2)) AS used_quantity, l.l_shipdate AS used_at,
         CAST(1 + l.l_suppkey % 10 AS BIGINT) AS used_by, CAST(NULL AS VARCHAR) AS reason
  FROM lineitem l JOIN x_product_tracking t ON t.id = l.l_orderkey + 1),
x_treatment_batches AS (
  SELECT CAST(c_custkey + 1 AS BIGINT) AS id, CAST(1 + c_custkey % 10 AS BIGINT) AS sent_by,
         TIMESTAMP '1999-06-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS sent_at,
         CAST(NULL AS TIMESTAMP) AS received_at, CAST(NULL AS VARCHAR) AS notes,
         CASE WHEN c_custkey % 3 = 0 THEN 'Shipped' ELSE 'Inspected' END AS status
  FROM customer WHERE c_custkey % 10 = 0),
x_treatment_batch_products AS (
  SELECT t.id AS id, b.id AS batch_id, t.id AS product_tracking_id, t.id % 4 <> 0 AS surface_treat, t.id % 5 <> 0 AS sterilize
  FROM x_product_tracking t JOIN orders o ON o.o_orderkey + 1 = t.id
  JOIN x_treatment_batches b ON b.id = o.o_custkey + 1 - o.o_custkey % 10
  WHERE t.id % 3 = 0),
x_post_treatment_inspections AS (
  SELECT p.id AS id, p.product_tracking_id, CAST(1 + p.id % 10 AS BIGINT) AS inspected_by,
         b.sent_at + to_days(30) AS inspected_at, p.id % 6 <> 3 AS visual_pass, p.surface_treat AS surface_treated, p.sterilize AS sterilized,
         CASE p.id % 9 WHEN 0 THEN 'Waste' WHEN 3 THEN 'B-Ware' ELSE 'Passed' END AS qc_result,
         CAST(NULL AS VARCHAR) AS notes
  FROM x_treatment_batch_products p JOIN x_treatment_batches b ON b.id = p.batch_id WHERE b.status = 'Inspected'),
x_quarantined_products AS (
  SELECT t.id AS id, t.id AS product_tracking_id, t.current_stage_id AS from_stage_id,
         CASE t.id % 3 WHEN 0 THEN 'Harvest QC' WHEN 1 THEN 'Post-Treatment QC' ELSE 'Ad-Hoc' END AS source,
         CASE WHEN t.id % 4 = 0 THEN NULL ELSE CAST(16 AS BIGINT) END AS location_id, t.last_updated_at AS quarantine_date,
         CAST(1 + t.id % 10 AS BIGINT) AS quarantined_by, CAST(NULL AS VARCHAR) AS quarantine_reason,
         CASE (t.id // 8) % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Released' ELSE 'Disposed' END AS quarantine_status,
         CAST(NULL AS VARCHAR) AS result, CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS BIGINT) AS resolved_by
  FROM x_product_tracking t WHERE (t.id // 2) % 8 = 0),
x_product_investigations AS (
  SELECT q.id AS id, q.product_tracking_id, CASE WHEN q.id % 2 = 0 THEN 'Under Investigation' ELSE 'Cleared B-Ware' END AS status,
         'DEV-' || CAST(q.id AS VARCHAR) AS deviation_number, CAST(NULL AS VARCHAR) AS comment,
         CAST(1 + q.id % 10 AS BIGINT) AS created_by, q.quarantine_date AS created_at,
         CAST(NULL AS TIMESTAMP) AS resolved_at, CAST(NULL AS BIGINT) AS resolved_by
  FROM x_quarantined_products q WHERE q.id % 5 = 0),
x_orders AS (
  SELECT CAST(o_orderkey + 1 AS BIGINT) AS id,
         CASE WHEN o_orderkey % 10 = 3 THEN CAST(o_orderkey // 2 + 1 AS BIGINT) END AS parent_order_id,
         CAST(o_custkey + 1 AS BIGINT) AS customer_id, o_orderdate AS order_date, CAST(1 + o_custkey % 10 AS BIGINT) AS order_creator_id,
         CASE o_orderstatus WHEN 'O' THEN 'Processing' WHEN 'P' THEN 'Canceled' ELSE 'Completed' END AS status,
         CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS BIGINT) AS updated_by, CAST(NULL AS VARCHAR) AS notes
  FROM orders),
x_order_items AS (
  SELECT min(CAST(l_orderkey * 8 + l_linenumber AS BIGINT)) AS id, CAST(l_orderkey + 1 AS BIGINT) AS order_id,
         CAST(1 + l_partkey % 7 AS BIGINT) AS product_sku_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
  FROM lineitem GROUP BY l_orderkey, l_partkey % 7),
x_shipments AS (
  SELECT o.id AS id, o.customer_id, o.id AS order_id, o.order_creator_id AS creator_id, o.order_date AS created_date,
         CASE WHEN o.id % 3 <> 0 THEN o.order_date + to_days(5) END AS ship_date,
         CASE WHEN o.id % 3 = 2 THEN o.order_date + to_days(9) END AS delivery_date,
         CASE o.id % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Shipped' ELSE 'Delivered' END AS status,
         CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS BIGINT) AS updated_by,
         CAST(NULL AS VARCHAR) AS tracking_number, CAST(NULL AS VARCHAR) AS carrier, CAST(NULL AS VARCHAR) AS notes
  FROM x_orders o WHERE o.status = 'Completed'),
x_shipment_unit_items AS (
  SELECT t.id AS id, s.id AS shipment_id, t.id AS product_tracking_id
  FROM x_product_tracking t JOIN x_shipments s ON s.id = t.id WHERE t.current_stage_id IN (11, 12)),
x_shipment_sku_items AS (
  SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS shipment_id, CAST(NULL AS BIGINT) AS product_sku_id,
         CAST(NULL AS BIGINT) AS quantity WHERE FALSE),
x_sku_bom AS (
  SELECT CAST(parent_sku_id AS BIGINT) AS parent_sku_id, CAST(component_sku_id AS BIGINT) AS component_sku_id,
         CAST(component_qty AS BIGINT) AS component_qty
  FROM (VALUES (4, 1, 2), (4, 6, 3), (5, 4, 2), (6, 7, 4)) v(parent_sku_id, component_sku_id, component_qty)),
x_packages AS (
  SELECT CAST(package_id AS BIGINT) AS package_id, item_kind, CAST(item_id AS BIGINT) AS item_id, CAST(quantity AS BIGINT) AS quantity
  FROM (VALUES (1, 'product', 1, 2), (1, 'supplement', 1, 1), (2, 'product', 2, 3), (2, 'product', 3, 1),
               (3, 'product', 4, 5), (3, 'supplement', 2, 2)) v(package_id, item_kind, item_id, quantity)),
x_audit_log AS (
  SELECT CAST(event_id + 1 AS BIGINT) AS id, CASE event_id % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'filaments' ELSE 'product_tracking' END AS table_name,
         CAST(1 + user_id AS BIGINT) AS record_id, CASE event_id % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'weight_grams' ELSE 'location_id' END AS field_name,
         CAST(event_id % 7 AS VARCHAR) AS old_value, CAST(event_id % 5 AS VARCHAR) AS new_value, event_type AS reason,
         CAST(1 + user_id % 10 AS BIGINT) AS changed_by, ts AS changed_at
  FROM events),
x_group_area_rights AS (
  SELECT CAST(n_nationkey * 5 + a.area_id AS BIGINT) AS id, n_name AS group_oid, CAST(a.area_id AS BIGINT) AS area_id,
         CASE (n_nationkey + a.area_id) % 3 WHEN 0 THEN 'Read' WHEN 1 THEN 'Write' ELSE 'Admin' END AS access_level
  FROM nation CROSS JOIN (VALUES (1), (2), (3), (4), (5)) a(area_id) WHERE (n_nationkey + a.area_id) % 4 <> 0),
x_stg_excel_data AS (
  SELECT CASE event_id % 20 WHEN 7 THEN 'n/a' WHEN 11 THEN CAST(event_id AS VARCHAR) || '.0' ELSE CAST(900000 + event_id AS VARCHAR) END AS product_id,
         CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(5000 + user_id AS VARCHAR) END AS filament_id,
         ' GEB' || CAST(1 + user_id % 7 AS VARCHAR) || ' ' AS printer, ' Op ' || lpad(CAST(user_id % 12 AS VARCHAR), 4, '0') AS operator_harvest,
         strftime(ts, '%Y-%m-%d') AS date_harvest,
         CASE event_id % 4 WHEN 0 THEN '10K' WHEN 1 THEN '6K ' WHEN 2 THEN 'CS MINI' ELSE 'OTHER' END AS product,
         CASE event_id % 3 WHEN 0 THEN '2273' WHEN 1 THEN ' 2276' ELSE 'nowhere' END AS storage,
         CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN NULL ELSE 'Pass ' END AS status_quality_check,
         CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'NO' END AS second_rate_goods,
         CASE event_id % 6 WHEN 0 THEN 'Sold' WHEN 1 THEN 'Sales' WHEN 2 THEN 'in treatment' WHEN 3 THEN 'internal' END AS prozess_step,
         CAST(NULL AS VARCHAR) AS operater_quality_check,
         CASE event_id % 5 WHEN 0 THEN strftime(ts, '%d.%m.%Y') WHEN 1 THEN strftime(ts, '%d-%m-%Y') WHEN 2 THEN strftime(ts, '%m/%d/%Y')
              WHEN 3 THEN CAST(45292 + event_id % 30 AS VARCHAR) ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date_of_quality_check,
         CASE WHEN event_id % 2 = 0 THEN CAST(600 + event_id % 90 AS VARCHAR) || ',5' ELSE CAST(600 + event_id % 90 AS VARCHAR) END AS weight_check_g,
         CAST(event_id % 9 AS VARCHAR) || ',25' AS pressure_drop_check_mbar,
         CASE event_id % 7 WHEN 0 THEN 'FAIL' ELSE 'pass' END AS visual_check,
         CAST(NULL AS VARCHAR) AS comment,
         CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'tr' || chr(160) || CAST(user_id // 3 AS VARCHAR) || chr(9) END AS transfer_id,
         CAST(NULL AS VARCHAR) AS operator_visual_check_incoming_goods,
         CASE WHEN event_id % 6 = 5 THEN NULL ELSE strftime(ts, '%d.%m.%Y') END AS date_of_visual_check_incoming_goods,
         CASE event_id % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN NULL ELSE 'PASS' END AS visual_check_1,
         CASE event_id % 2 WHEN 0 THEN 'Yes' ELSE 'PASS' END AS surface_treatment, CASE event_id % 3 WHEN 0 THEN 'yes' END AS sterilization
  FROM events),
x_stg_filament_excel_data AS (
  SELECT CASE p_partkey % 4 WHEN 0 THEN '5,' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN CAST(5000 + p_partkey AS VARCHAR) || '.0'
              ELSE CAST(5000 + p_partkey AS VARCHAR) END AS filament_id,
         CASE WHEN p_partkey % 29 = 0 THEN ' ' ELSE 'L' || CAST(p_partkey // 4 AS VARCHAR) || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '-' || CAST(p_partkey AS VARCHAR) END END AS filament,
         CASE p_partkey % 6 WHEN 0 THEN ' air lock ' WHEN 1 THEN '' WHEN 2 THEN 'NEW' || CAST(p_partkey % 5 AS VARCHAR) ELSE CAST(2253 + p_partkey % 8 AS VARCHAR) END AS shelf,
         CAST(100 + p_partkey % 900 AS VARCHAR) || ',75' AS weight_fl,
         strftime(TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 28 AS INTEGER)), '%d.%m.%Y') AS vsc_date,
         upper('Op ' || lpad(CAST(p_partkey % 12 AS VARCHAR), 4, '0')) AS vsc_operator,
         CASE p_partkey % 5 WHEN 0 THEN 'nein' WHEN 1 THEN ' Ja' WHEN 2 THEN 'OK' WHEN 3 THEN NULL ELSE '??' END AS vs_check,
         CASE WHEN p_partkey % 2 = 0 THEN 'GEB' || CAST(1 + p_partkey % 7 AS VARCHAR) END AS printer_fi,
         CASE p_partkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS usage
  FROM part),
x_stg_treatment_excel_data AS (
  SELECT 'TR ' || CAST(g AS VARCHAR) AS treatment_id,
         CASE g % 5 WHEN 0 THEN 'at geb' WHEN 1 THEN 'AT BBF ' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' ELSE 'lost' END AS in_treatment,
         CASE g % 2 WHEN 0 THEN '15.01.2024' ELSE '01/20/2024' END AS run_date, CASE WHEN g % 3 = 0 THEN ' ' ELSE 'Op 0001' END AS operator
  FROM (SELECT DISTINCT user_id // 3 AS g FROM events))
""".strip()


_stg_start = FIXTURE_CTES.index("x_stg_excel_data AS (")
_stg_end = FIXTURE_CTES.index("x_stg_filament_excel_data AS (")
STG_ID_CTE = FIXTURE_CTES[_stg_start:_stg_end].rstrip().rstrip(",").replace(
    "x_stg_excel_data AS (\n  SELECT ", "x_stg_excel_data_id AS (\n  SELECT event_id AS _event_id, ", 1)


def _dim_ctes() -> str:
    return ",\n".join(f"x_{n} AS ({dim_sql(n)})" for n in DIM_NAMES)


def with_prelude(body: str) -> str:
    body = body.strip()
    head = "WITH "
    if body.startswith(", RECURSIVE"):
        head, body = "WITH RECURSIVE ", ", " + body[len(", RECURSIVE"):].lstrip()
    return head + FIXTURE_CTES + ",\n" + STG_ID_CTE + ",\n" + _dim_ctes() + "\n" + body
