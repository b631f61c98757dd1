"""Oracle SQL (DuckDB) for the column-level scalar rule queries."""

from spooltrace.oracle.sql_etl import FAIL_WORDS, _clean, sql_bigint_loose
from spooltrace.oracle.sql_views import sql_bigint, sql_date_multi, sql_ts_generic



def _b36(n: str, digits: int = 12) -> str:
    d = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    parts = " || ".join(f"CASE WHEN {n} >= {36 ** k} THEN substr({d}, CAST(({n} // {36 ** k}) % 36 AS INTEGER) + 1, 1) ELSE '' END"
                        for k in range(digits - 1, 0, -1))
    return f"({parts} || substr({d}, CAST({n} % 36 AS INTEGER) + 1, 1))"


def _initials(x: str) -> str:
    def part(w: str) -> str:
        letters = f"regexp_replace({w}, '[^\\p{{L}}]', '', 'g')"
        raw = f"CASE WHEN length({letters}) = 1 THEN {letters} || {letters} ELSE left({letters}, 2) END"
        return f"CASE WHEN length({letters}) = 0 THEN 'Xx' ELSE upper(substr({raw}, 1, 1)) || lower(substr({raw}, 2, 1)) END"
    parts = f"regexp_split_to_array(trim({x}), '\\s+')"
    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN 'XxXx' ELSE {part(f'{parts}[1]')} || {part(f'{parts}[-1]')} END"


STEP = " ".join(f"WHEN '{k}' THEN {v}" for k, v in
                [("SOLD", 12), ("SALES", 8), ("NOT USABLE", 10), ("INTERNAL", 13), ("IN TREATMENT", 5), ("INTERIM STORAGE", 4)])
# fixed values, stated apart from the library's table: next stage after harvest QC
NEXT = " UNION ALL ".join(f"SELECT '{s}' AS business_status, '{code}' AS next_stage_code" for s, code in (
    ("A-Ware", "InInterimStorage"), ("B-Ware", "InInterimStorage"), ("In Quarantine", "Quarantine"), ("Waste", "Disposed")))
BUSINESS = ("CASE {x} WHEN 'Passed' THEN 'A-Ware' WHEN 'B-Ware' THEN 'B-Ware' WHEN 'Quarantine' THEN 'In Quarantine' "
            "WHEN 'In Quarantine' THEN 'In Quarantine' WHEN 'Waste' THEN 'Waste' ELSE '{d}' END")
AS_OF = "TIMESTAMP '2000-06-30 00:00:00'"

S = "x_stg_excel_data_id"
FE = "x_stg_filament_excel_data"
MULTI = sql_date_multi("date_of_quality_check")
QC_ST = "upper(trim(status_quality_check))"
QC_SR = "upper(trim(coalesce(second_rate_goods, '')))"
QC_MATRIX = (f"CASE WHEN {QC_ST} IS NULL OR {QC_ST} = 'FAIL' THEN CASE WHEN {QC_SR} = 'NO' THEN 'Waste' "
             f"WHEN {QC_SR} = 'YES' THEN 'B-Ware' ELSE 'Waste' END WHEN {QC_ST} = 'PASS' THEN "
             f"CASE WHEN {QC_SR} = 'YES' THEN 'B-Ware' ELSE 'Passed' END ELSE 'Passed' END")
LEGACY_NAME = (f"CASE WHEN {QC_ST} = 'FAIL' THEN 'Waste' WHEN {QC_ST} = 'PASS' AND {QC_SR} = 'YES' THEN 'B-Ware' "
               f"WHEN {QC_ST} = 'PASS' AND {QC_SR} = 'NO' THEN 'A-Ware' END")
RES3 = "['Passed', 'B-Ware', 'Waste'][{x} % 3 + 1]"

SQL = {
    "parse_bigint": f"SELECT filament_id AS input, {sql_bigint_loose('filament_id')} AS output FROM {FE}",
    "parse_bigint_strict": f"SELECT _event_id AS event_id, product_id AS input, {sql_bigint('product_id')} AS output FROM {S}",
    "parse_decimal_comma": f"""SELECT _event_id AS event_id, weight_check_g AS input,
  TRY_CAST(replace(weight_check_g, ',', '.') AS DECIMAL(6,2)) AS output FROM {S}""",
    "parse_date_multi": f"SELECT _event_id AS event_id, date_of_quality_check AS input, {MULTI} AS output FROM {S}",
    "parse_date_de": f"""SELECT filament_id AS key, vsc_date AS input,
  COALESCE(try_strptime(vsc_date, '%d.%m.%Y'), {sql_ts_generic('vsc_date')}) AS output FROM {FE}""",
    "clean_key": f"SELECT _event_id AS event_id, transfer_id AS input, {_clean('transfer_id')} AS output FROM {S}",
    "blank_to_null": f"SELECT filament_id AS key, shelf AS input, nullif(trim(shelf), '') AS output FROM {FE}",
    "lot_prefix": f"""SELECT filament_id AS key, filament AS input,
  left(CASE WHEN strpos(filament, '-') > 0 THEN split_part(filament, '-', 1) ELSE filament END, 100) AS output FROM {FE}""",
    "pass_fail": f"""SELECT filament_id AS key, vs_check AS input,
  CASE WHEN upper(trim(coalesce(vs_check, ''))) IN {FAIL_WORDS} THEN 'FAIL' ELSE 'PASS' END AS output FROM {FE}""",
    "qc_result_matrix": f"SELECT _event_id AS event_id, {QC_ST} AS status_qc, {QC_SR} AS second_rate, {QC_MATRIX} AS output FROM {S}",
    "post_treat_flags": f"""SELECT _event_id AS event_id, COALESCE(upper(trim(visual_check_1)) = 'PASS', FALSE) AS visual_pass,
  COALESCE(upper(trim(surface_treatment)) = 'YES', FALSE) AS surface_treated,
  COALESCE(upper(trim(sterilization)) = 'YES', FALSE) AS sterilized,
  CASE WHEN COALESCE(upper(trim(visual_check_1)) = 'PASS', FALSE) THEN 'Passed' ELSE 'B-Ware' END AS qc_result FROM {S}""",
    "legacy_status_stage": f"""SELECT s._event_id AS event_id, st.id AS current_status_id,
  CAST(CASE upper(trim(coalesce(s.prozess_step, ''))) {STEP} ELSE 1 END AS BIGINT) AS current_stage_id
FROM {S} s LEFT JOIN (SELECT status_name, min(id) AS id FROM x_product_statuses GROUP BY status_name) st
  ON st.status_name = ({LEGACY_NAME.replace('status_quality_check', 's.status_quality_check').replace('second_rate_goods', 's.second_rate_goods')})""",
    "treatment_status": f"""SELECT treatment_id AS key, in_treatment AS input,
  CASE WHEN {_clean('in_treatment')} = 'AT GEB' THEN 'Inspected' WHEN {_clean('in_treatment')} IN ('AT BBF', 'YES') THEN 'Shipped' END
  AS output FROM x_stg_treatment_excel_data""",
    "treatment_notes": f"""SELECT treatment_id AS key, left('LegacyTreatmentID=' || COALESCE({_clean('treatment_id')}, '') ||
  CASE WHEN nullif(trim(operator), '') IS NOT NULL THEN '; Operator=' || trim(operator) ELSE '' END, 255) AS output
FROM x_stg_treatment_excel_data""",
    "base36": f"SELECT o_orderkey AS input, {_b36('o_orderkey')} AS output FROM orders",
    "lot_number": f"""SELECT o_orderkey AS key, lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') ||
  CASE WHEN length({_b36('o_orderkey')}) < 2 THEN lpad({_b36('o_orderkey')}, 2, '0') ELSE {_b36('o_orderkey')} END
  AS output FROM orders""",
    "product_code": "SELECT id AS key, lot_number || printf('%04d', id) AS output FROM x_product_requests",
    "name_initials": f"""SELECT c_custkey AS key, c_mktsegment || ' ' || c_name AS input,
  {_initials("(c_mktsegment || ' ' || c_name)")} AS output FROM customer""",
    "ready_at": "SELECT id, moved_at, moved_at + INTERVAL 2 DAY AS output FROM x_filament_acclimatization",
    "harvest_qc_rule": """SELECT q.id, CASE WHEN CAST(q.pressure_drop AS DOUBLE) >= 6 THEN 'Waste'
  WHEN CAST(q.weight_grams AS DOUBLE) > 0 AND (CAST(q.weight_grams AS DOUBLE) < COALESCE(CAST(s.average_weight_g AS DOUBLE), 0) - COALESCE(CAST(s.weight_buffer_g AS DOUBLE), 0)
    OR CAST(q.weight_grams AS DOUBLE) > COALESCE(CAST(s.average_weight_g AS DOUBLE), 0) + COALESCE(CAST(s.weight_buffer_g AS DOUBLE), 0)) THEN 'B-Ware'
  ELSE 'Passed' END AS output
FROM x_product_quality_control q JOIN x_product_tracking t ON q.product_tracking_id = t.id
LEFT JOIN x_product_print_specs s ON s.sku_id = t.sku_id""",
    "business_status": f"SELECT id, inspection_result AS input, {BUSINESS.format(x='inspection_result', d='Pending')} AS output FROM x_product_quality_control",
    "next_stage": f"""SELECT q.id, q.bs AS business_status, r.next_stage_code FROM
  (SELECT id, {BUSINESS.format(x='inspection_result', d='A-Ware')} AS bs FROM x_product_quality_control) q
  LEFT JOIN ({NEXT}) r ON r.business_status = q.bs""",
    "qm_target_stage": f"""SELECT t.id, {RES3.format(x='t.id')} AS resolution, s.stage_name,
  CASE WHEN {RES3.format(x='t.id')} = 'Waste' THEN 'Discarded Product'
       WHEN s.stage_name = 'Harvest QC Complete; Pending Storage' THEN 'QM Approved for Treatment; Pending Treatment'
       WHEN {RES3.format(x='t.id')} = 'B-Ware' AND s.stage_name = 'Returned / Post-Treatment QC; Pending Storage' THEN 'Internal Use/Client'
       WHEN s.stage_name = 'Returned / Post-Treatment QC; Pending Storage' THEN 'QM Approved For Sales; Pending Sales'
       ELSE s.stage_name END AS output
FROM x_product_tracking t LEFT JOIN x_lifecycle_stages s ON t.current_stage_id = s.id""",
    "resolution_status": f"""SELECT id, {RES3.format(x='id')} AS resolution,
  CASE {RES3.format(x='id')} WHEN 'Passed' THEN 'Cleared A-Ware' WHEN 'B-Ware' THEN 'Cleared B-Ware' ELSE 'Disposed' END AS investigation_status,
  CASE WHEN {RES3.format(x='id')} IN ('Passed', 'B-Ware') THEN 'Released' ELSE 'Disposed' END AS quarantine_status
FROM x_product_investigations""",
    "append_note": f"""SELECT id, old_note, CASE WHEN old_note IS NULL OR old_note = '' THEN note ELSE old_note || chr(13) || note END AS output
FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'initial hold' ELSE quarantine_reason END AS old_note,
  '[Resolution ' || strftime({AS_OF}, '%Y-%m-%d %H:%M') || ']: ' || {RES3.format(x='id')} ||
  CASE WHEN id % 2 = 0 THEN ' — checked' ELSE '' END AS note FROM x_quarantined_products)""",
    "weight_health": """SELECT id, remaining_weight, CASE WHEN remaining_weight IS NULL THEN NULL WHEN remaining_weight < 500 THEN 'Critical'
  WHEN remaining_weight < 2500 THEN 'Low' ELSE 'OK' END AS output FROM x_filament_mounting""",
    "label_expiry": """SELECT id, print_date, strftime(CAST(print_date AS DATE) + INTERVAL 24 MONTH, '%Y-%m-%d') AS expiry_date,
  CAST(month(CAST(print_date AS DATE) + INTERVAL 24 MONTH) AS VARCHAR) || ' / ' || CAST(year(CAST(print_date AS DATE) + INTERVAL 24 MONTH) AS VARCHAR)
  AS expiry_label FROM x_product_harvest""",
    "required_weight": """SELECT r.id, CAST(COALESCE(s.average_weight_g + s.weight_buffer_g + 10, 0) AS DECIMAL(10,2)) AS output
FROM x_product_requests r LEFT JOIN x_product_print_specs s ON s.sku_id = r.sku_id""",
    "expanded_qty": """SELECT i.order_id, i.product_sku_id,
  CASE WHEN COALESCE(s.is_bundle, FALSE) AND NOT COALESCE(i.order_id % 2 = 0, FALSE) THEN i.quantity * s.pack_qty ELSE i.quantity END AS output
FROM x_order_items i JOIN x_product_skus s ON i.product_sku_id = s.id""",
    "has_level": """SELECT id, access_level, CASE access_level WHEN 'Read' THEN 1 WHEN 'Write' THEN 2 WHEN 'Admin' THEN 3 ELSE 0 END >= 2 AS output
FROM x_group_area_rights""",
    "reason_matches_outcome": """SELECT o.outcome, r.id AS reason_id FROM (SELECT DISTINCT inspection_result AS outcome FROM x_product_quality_control) o
JOIN x_issue_reasons r ON r.default_outcome IS NULL OR r.default_outcome = o.outcome""",
    "parse_ts_generic": f"SELECT _event_id AS event_id, date_harvest AS input, {sql_ts_generic('date_harvest')} AS output FROM {S}",
    "clip_text": f"SELECT filament_id AS key, left(filament, 100) AS output FROM {FE}",
}

from spooltrace.oracle.sql_operations import SQL as _G  # noqa: E402

SQL["treatment_qc_rule"] = _G["treatment_qc_evaluation"].rsplit("SELECT id, batch_id, suggested_result,", 1)[0] + \
    "SELECT id, batch_id, suggested_result AS output FROM j"
