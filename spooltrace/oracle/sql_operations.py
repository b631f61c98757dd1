"""Oracle SQL (DuckDB) for G1-G36."""

from spooltrace.oracle.lookup import HARVEST, REQUEST, UNITS, by_id, of_unit, place, plain, present, report, sku, stage, user
from spooltrace.oracle.prelude import AS_OF_SQL


def _values(rows, cols):
    def lit(v):
        return "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") v({', '.join(cols)})"


# fixed values, stated here again so that the oracle does not share the library's table
SHELF_RULES = _values([
    ("A-Ware", "Post-Harvest QC", "CellScrew; Inventory", "InInterimStorage"),
    ("A-Ware", "Post-Treatment QC", "CellScrew; Sales", "PostTreatmentStorage"),
    ("B-Ware", "Post-Harvest QC", "CellScrew; B-Ware", "InInterimStorage"),
    ("B-Ware", "Post-Treatment QC", "CellScrew; Internal Use", "PostTreatmentStorage"),
    ("In Quarantine", "Post-Harvest QC", "CellScrew; Quarantine", "Quarantine"),
    ("In Quarantine", "Post-Treatment QC", "CellScrew; Quarantine", "Quarantine"),
    ("In Quarantine", "AdHoc Quarantine", "CellScrew; Quarantine", "Quarantine"),
    ("Waste", "Post-Harvest QC", "Disposed Product", "Disposed"),
    ("Waste", "Post-Treatment QC", "Disposed Product", "Disposed"),
], ["business_status", "mode", "keyword", "next_stage_code"])
STAGE_RULES = _values([
    ("HarvestQCComplete", "CellScrew; Inventory"), ("HarvestQCComplete", "CellScrew; B-Ware"),
    ("InInterimStorage", "CellScrew; Inventory"), ("InInterimStorage", "CellScrew; B-Ware"),
    ("QMTreatmentApproval", "CellScrew; Inventory"), ("QMTreatmentApproval", "CellScrew; B-Ware"),
    ("InTreatment", "Offsite"), ("InTreatment", "Treatment/Partner/Customer"),
    ("PostTreatmentQC", "CellScrew; Sales"), ("PostTreatmentQC", "Internal Use"), ("PostTreatmentQC", "CellScrew; B-Ware"),
    ("PostTreatmentStorage", "CellScrew; Sales"), ("PostTreatmentStorage", "Internal Use"),
    ("PostTreatmentStorage", "CellScrew; B-Ware"), ("QMSalesApproval", "CellScrew; Sales"),
    ("PendingShipment", "CellScrew; Sales"), ("Shipped", "Offsite"), ("Shipped", "Treatment/Partner/Customer"),
    ("Quarantine", "CellScrew; Quarantine"), ("Disposed", "Disposed Product"), ("Disposed", "Waste"),
    ("Internal Use", "Internal Use"),
], ["stage_code", "keyword"])

BUSINESS = """CASE inspection_result WHEN 'Passed' THEN 'A-Ware' WHEN 'B-Ware' THEN 'B-Ware' WHEN 'Quarantine' THEN 'In Quarantine'
  WHEN 'In Quarantine' THEN 'In Quarantine' WHEN 'Waste' THEN 'Waste' ELSE 'A-Ware' END"""

_RESULT = of_unit("product_quality_control", "inspection_result")
_CHAIN = present(HARVEST["id"], REQUEST["id"], sku("id", "u.sku_id"))
_MOUNT = HARVEST["filament_mounting_id"]
_SPOOL = by_id("filament_mounting", "filament_tracking_id", _MOUNT)
_SKU = {"sku": sku("sku", "u.sku_id"), "sku_name": sku("name", "u.sku_id")}

G4 = report({
    **plain("u", "id", "product_id", "harvest_id"), "request_id": REQUEST["id"], "lot_number": REQUEST["lot_number"],
    "sku": sku("sku", REQUEST["sku_id"]), "sku_name": sku("name", REQUEST["sku_id"]), "print_date": HARVEST["print_date"],
    **{k: f"(SELECT z.{k} FROM x_product_print_specs z WHERE z.sku_id = {REQUEST['sku_id']})"
       for k in ("average_weight_g", "weight_buffer_g")},
    "printer": by_id("printers", "name", by_id("filament_mounting", "printer_id", _MOUNT)),
}, UNITS, [f"{stage('stage_order')} = 1", f"{REQUEST['lot_number']} <> 'LEGACY_LOT'", *present(sku("id", REQUEST["sku_id"]))])

G9 = report({
    **plain("u", "id", "product_id", "location_id", "last_updated_at"), **_SKU, "current_stage_name": stage(),
    "harvest_id": HARVEST["id"], "print_date": HARVEST["print_date"], "printed_by": user(HARVEST["printed_by"]),
    "inspection_result": _RESULT, "filament_serial": by_id("filaments", "serial_number", _SPOOL),
}, UNITS, [f"{stage('stage_code')} = 'HarvestQCComplete'", "u.location_id IS NULL", *_CHAIN,
           *present(of_unit("product_quality_control", "id"), by_id("filaments", "id", _SPOOL))])

_REVIEW = {"product_tracking_id": "u.id", **plain("u", "product_id", "last_updated_at"), **_SKU, "current_stage_name": stage(),
           "current_location": place("u.location_id")}

G22 = report({
    **_REVIEW, "lot_number": REQUEST["lot_number"], "inspection_result": _RESULT,
    "inspected_by": user(of_unit("product_quality_control", "inspected_by")),
    **{k: of_unit("product_quality_control", k) for k in ("weight_grams", "pressure_drop", "visual_pass", "notes")},
}, UNITS, [f"{stage('stage_code')} = 'InInterimStorage'", *_CHAIN,
           *present(user(of_unit("product_quality_control", "inspected_by")))])

G23 = report({
    **_REVIEW, "inspection_result": of_unit("post_treatment_inspections", "qc_result"),
    "inspected_by": user(of_unit("post_treatment_inspections", "inspected_by")),
    **{k: of_unit("post_treatment_inspections", k) for k in ("visual_pass", "surface_treated", "sterilized")},
}, UNITS, [f"{stage('stage_code')} = 'PostTreatmentStorage'", *_CHAIN])



def unit_of(key: str, column: str) -> str:
    return by_id("product_tracking", column, key)


def harvest_of(key: str, column: str) -> str:
    """Column of the harvest of the unit ``key``."""
    return by_id("product_harvest", column, unit_of(key, "harvest_id"))


def request_of(key: str, column: str) -> str:
    return by_id("product_requests", column, harvest_of(key, "request_id"))


def spec(column: str, sku_key: str) -> str:
    return f"(SELECT z.{column} FROM x_product_print_specs z WHERE z.sku_id = {sku_key})"


_STATUS = by_id("product_statuses", "status_name", "u.current_status_id")
_ASKED = {"sku": sku("sku", "r.sku_id"), "sku_name": sku("name", "r.sku_id")}

G2 = report({
    **plain("r", "id", "lot_number", "status", "requested_at", "is_tech_transfer"), **_ASKED, "requested_by": user("r.requested_by"),
    "average_weight_g": spec("average_weight_g", "r.sku_id"), "weight_buffer_g": spec("weight_buffer_g", "r.sku_id"),
}, "x_product_requests r", ["r.status = 'Pending'", "r.lot_number <> 'LEGACY_LOT'",
                            *present(sku("id", "r.sku_id"), by_id("users", "id", "r.requested_by"))])

_H_SKU = by_id("product_requests", "sku_id", "h.request_id")
_H_SPOOL = by_id("filament_mounting", "filament_tracking_id", "h.filament_mounting_id")
_H_PRINTER = by_id("filament_mounting", "printer_id", "h.filament_mounting_id")
G3 = report({
    "harvest_id": "h.id", "mount_id": "h.filament_mounting_id", **plain("h", "lid_id", "seal_id", "request_id", "print_date"),
    "sku": sku("sku", _H_SKU), "sku_name": sku("name", _H_SKU), "filament_serial": by_id("filaments", "serial_number", _H_SPOOL),
    "printer_name": by_id("printers", "name", _H_PRINTER), "lid_serial": by_id("lids", "serial_number", "h.lid_id"),
    "printed_by": user("h.printed_by"),
}, "x_product_harvest h", present(sku("id", _H_SKU), by_id("filaments", "id", _H_SPOOL), by_id("printers", "id", _H_PRINTER),
                                  by_id("lids", "id", "h.lid_id"), by_id("users", "id", "h.printed_by")))

_Q_SKU = request_of("q.product_tracking_id", "sku_id")
G5 = report({
    "qc_id": "q.id", "id": "q.product_tracking_id", "product_id": unit_of("q.product_tracking_id", "product_id"),
    "harvest_id": unit_of("q.product_tracking_id", "harvest_id"), "sku": sku("sku", _Q_SKU), "sku_name": sku("name", _Q_SKU),
    "lot_number": request_of("q.product_tracking_id", "lot_number"), "print_date": harvest_of("q.product_tracking_id", "print_date"),
    **plain("q", "weight_grams", "pressure_drop", "visual_pass", "inspection_result", "notes"),
}, "x_product_quality_control q", present(sku("id", _Q_SKU)))

_I_TYPE = sku("product_type_id", request_of("i.product_tracking_id", "sku_id"))
G6 = report({
    "inspection_id": "i.id", "product_type": by_id("product_types", "name", _I_TYPE),
    **plain("i", "product_tracking_id", "surface_treated", "sterilized", "visual_pass", "qc_result", "inspected_by", "inspected_at"),
}, "x_post_treatment_inspections i", present(by_id("product_types", "id", _I_TYPE)))

G8 = report({
    **plain("u", "id", "product_id", "last_updated_at", "harvest_id"), **_SKU, "current_stage": stage(), "current_status": _STATUS,
    "inspection_result": _RESULT, "location_name": place("u.location_id"),
}, UNITS, [f"{stage('stage_code')} = 'QMTreatmentApproval'", *_CHAIN, *present(of_unit("product_quality_control", "id"), _STATUS)])

_I_SKU = unit_of("i.product_tracking_id", "sku_id")
G10 = report({
    "id": "i.product_tracking_id", "product_id": unit_of("i.product_tracking_id", "product_id"),
    "harvest_id": unit_of("i.product_tracking_id", "harvest_id"), "sku": sku("sku", _I_SKU), "sku_name": sku("name", _I_SKU),
    "inspection_result": "i.qc_result",
}, "x_post_treatment_inspections i", [
    f"{stage('stage_code', unit_of('i.product_tracking_id', 'current_stage_id'))} = 'PostTreatmentQC'",
    *present(request_of("i.product_tracking_id", "id"), sku("id", _I_SKU))])

_A_UNIT = "a.product_tracking_id"
_A_STATUS = by_id("product_statuses", "status_name", unit_of(_A_UNIT, "current_status_id"))
G11 = report({
    "id": _A_UNIT, "product_id": unit_of(_A_UNIT, "product_id"), "quarantine_id": "a.id",
    "current_stage_name": stage("stage_name", unit_of(_A_UNIT, "current_stage_id")), "sku": sku("sku", unit_of(_A_UNIT, "sku_id")),
    "sku_name": sku("name", unit_of(_A_UNIT, "sku_id")), "inspection_result": _A_STATUS,
    "last_updated_at": unit_of(_A_UNIT, "last_updated_at"), **plain("a", "quarantined_by", "quarantine_date"),
}, "x_quarantined_products a", ["a.quarantine_status = 'Active'", "a.location_id IS NULL",
                                *present(request_of(_A_UNIT, "id"), sku("id", unit_of(_A_UNIT, "sku_id")), _A_STATUS)])

_B_UNIT = "b.product_tracking_id"
G13 = report({
    "batch_product_id": "b.id", "id": _B_UNIT, **plain("b", "batch_id", "surface_treat", "sterilize"),
    "product_id": unit_of(_B_UNIT, "product_id"), "location_id": unit_of(_B_UNIT, "location_id"),
    "current_status": by_id("product_statuses", "status_name", unit_of(_B_UNIT, "current_status_id")),
    "current_stage": stage("stage_name", unit_of(_B_UNIT, "current_stage_id")), "sku": sku("sku", unit_of(_B_UNIT, "sku_id")),
    "sku_name": sku("name", unit_of(_B_UNIT, "sku_id")),
    "inspection_result": of_unit("product_quality_control", "inspection_result", _B_UNIT), "visual_pass": "CAST(NULL AS BOOLEAN)",
}, "x_treatment_batch_products b", present(request_of(_B_UNIT, "id"), sku("id", unit_of(_B_UNIT, "sku_id"))))

G14 = report({
    "product_id": "u.id", "harvest_id": "u.harvest_id", **_SKU, "current_status": stage(), "location_id": "u.location_id",
    "location_name": place("u.location_id"), "description": place("u.location_id", "description"),
}, UNITS, [*_CHAIN, *present(place("u.location_id", "id"))])


def _printed_before(*conditions: str) -> str:
    """Units not yet expired whose harvest meets the conditions on its print date."""
    when = [f"{HARVEST['print_date']} {x}" for x in conditions]
    return report({"id": "u.id", "print_date": HARVEST["print_date"], **_SKU}, UNITS,
                  [f"{stage('stage_code')} <> 'Expired'", *when, *_CHAIN])


_YEAR_AGO = f"{AS_OF_SQL} - INTERVAL 1 YEAR"
_FOUND = ["a.quarantine_status = 'Active'", "a.location_id IS NOT NULL"]
_A_REVIEW = {"product_id": _A_UNIT, "sku": sku("sku", unit_of(_A_UNIT, "sku_id")), "sku_name": sku("name", unit_of(_A_UNIT, "sku_id")),
             "previous_stage_name": stage("stage_name", unit_of(_A_UNIT, "previous_stage_id")),
             "current_stage_name": stage("stage_name", unit_of(_A_UNIT, "current_stage_id")),
             "location_name": place(unit_of(_A_UNIT, "location_id")), "last_updated_at": unit_of(_A_UNIT, "last_updated_at"),
             "inspection_result": of_unit("product_quality_control", "inspection_result", _A_UNIT)}
# a unit without an investigation counts once, one with several once for each that is not open
G24 = report({
    **_A_REVIEW, "tracking_id": unit_of(_A_UNIT, "product_id"),
    "qc_result": of_unit("post_treatment_inspections", "qc_result", _A_UNIT), **plain("a", "quarantine_date", "quarantine_reason"),
    "quarantined_by": user("a.quarantined_by"),
    **{k: of_unit("product_quality_control", k, _A_UNIT) for k in ("weight_grams", "pressure_drop")},
}, """(SELECT q.*, unnest(CASE WHEN i.states IS NULL THEN ['none'] ELSE i.states END) AS investigation FROM x_quarantined_products q
  LEFT JOIN (SELECT product_tracking_id, list(status) AS states FROM x_product_investigations GROUP BY product_tracking_id) i
    USING (product_tracking_id)) a""", [*_FOUND, "a.investigation <> 'Under Investigation'",
                                        *present(request_of(_A_UNIT, "id"), user("a.quarantined_by"))])
G25 = report({
    **_A_REVIEW, **plain("a", "deviation_number", "comment", "created_at"), "created_by": user("a.created_by"),
}, "x_product_investigations a", ["a.status = 'Under Investigation'", *present(request_of(_A_UNIT, "id"), user("a.created_by"))])

G26 = report({
    "product_id": "u.id", "tracking_id": "u.product_id", **_SKU, "lot_number": REQUEST["lot_number"], "request_id": REQUEST["id"],
    "harvest_id": "u.harvest_id", "current_stage_name": stage(), "current_status": _STATUS,
    "location_name": place("u.location_id"), "last_updated_at": "u.last_updated_at",
}, UNITS, [f"{_STATUS} IS DISTINCT FROM 'Waste'", *_CHAIN,
           "u.id NOT IN (SELECT a.product_tracking_id FROM x_quarantined_products a WHERE a.quarantine_status = 'Active')"])

G27 = report(plain("a", "table_name", "record_id", "field_name", "old_value", "new_value", "reason", "changed_by", "changed_at"),
             "x_audit_log a")
_REASON = ("id", "reason_code", "reason_label", "category", "default_outcome")
G29 = report(plain("w", *_REASON, "severity", "is_active"), "x_issue_reasons w", ["w.is_active"])
_OUTCOME = by_id("issue_reasons", "default_outcome", "k.reason_id")
G30 = report({
    "context_code": by_id("issue_contexts", "context_code", "k.context_id"),
    **{x: by_id("issue_reasons", x, "k.reason_id") for x in _REASON},
}, "x_issue_reason_contexts k", [by_id("issue_reasons", "is_active", "k.reason_id"), f"COALESCE({_OUTCOME}, 'B-Ware') = 'B-Ware'",
                                 *present(by_id("issue_contexts", "id", "k.context_id"))])

_ENDS = f"({HARVEST['print_date']} + INTERVAL 2 YEAR)"


def _labels(stage_code: str) -> str:
    return report({
        **plain("u", "id", "product_id"), "reference_number": sku("sku", "u.sku_id"), "lot_number": REQUEST["lot_number"],
        "product_type": by_id("product_types", "name", "u.product_type_id"), "volume": spec("average_weight_g", "u.sku_id"),
        "expiration_date": f"strftime({_ENDS}, '%Y-%m-%d')", "expiration_label": f"format('{{}} / {{}}', month({_ENDS}), year({_ENDS}))",
    }, UNITS, [f"{stage('stage_code')} = '{stage_code}'", *_CHAIN,
               *present(by_id("product_types", "id", "u.product_type_id"), spec("sku_id", "u.sku_id"))])


LOCATED = """SELECT pt.id AS product_id, st.status_name, lc.stage_code, sl.id AS location_id, sl.location_name, sl.description
FROM x_product_tracking pt JOIN x_lifecycle_stages lc ON pt.current_stage_id = lc.id
JOIN x_storage_locations sl ON pt.location_id = sl.id LEFT JOIN x_product_statuses st ON pt.current_status_id = st.id"""

MISMATCH = f"""SELECT u.* FROM ({LOCATED}) u
WHERE NOT EXISTS (SELECT 1 FROM {STAGE_RULES} WHERE v.stage_code = u.stage_code AND contains(u.description, v.keyword))"""

SQL = {
    "requestable_skus": """SELECT id, sku, name, is_bundle, pack_qty FROM x_product_skus
  WHERE is_active AND (is_serialized OR is_bundle)""",
    "pending_requests": G2,
    "harvested_products": G3,
    "printed_pending_qc": G4,
    "completed_qc": G5,
    "completed_post_treatment_qc": G6,
    "qc_evaluation": f"""SELECT g.id, g.product_id, g.sku, qc.weight_grams, qc.pressure_drop,
  CASE WHEN qc.pressure_drop >= 6 THEN 'Waste'
       WHEN qc.weight_grams > 0 AND (qc.weight_grams < COALESCE(g.average_weight_g, 0) - COALESCE(g.weight_buffer_g, 0)
            OR qc.weight_grams > COALESCE(g.average_weight_g, 0) + COALESCE(g.weight_buffer_g, 0)) THEN 'B-Ware'
       ELSE 'Passed' END AS suggested_result
FROM ({G4}) g JOIN x_product_quality_control qc ON qc.product_tracking_id = g.id""",
    "treatment_candidates": G8,
    "needs_storage_harvest": G9,
    "needs_storage_treatment": G10,
    "needs_storage_adhoc": G11,
    "shipped_batches": report(plain("b", "id", "sent_at", "notes"), "x_treatment_batches b", ["b.status = 'Shipped'"]),
    "batch_products": G13,
    "stored_products": G14,
    "shelf_options": f"""SELECT DISTINCT g.id, g.product_id, {BUSINESS.replace('inspection_result', 'g.inspection_result')} AS business_status,
  l.id AS location_id, l.location_name, l.description, v.next_stage_code
FROM ({G9}) g JOIN {SHELF_RULES} ON v.mode = 'Post-Harvest QC'
  AND v.business_status = {BUSINESS.replace('inspection_result', 'g.inspection_result')}
JOIN x_storage_locations l ON contains(l.description, v.keyword)""",
    "shelf_stage_mismatch": MISMATCH,
    "mismatch_fixes": f"""SELECT DISTINCT m.*, l.id AS valid_location_id, l.location_name AS valid_location_name,
  l.description AS valid_description
FROM ({MISMATCH}) m JOIN {STAGE_RULES} ON v.stage_code = m.stage_code JOIN x_storage_locations l ON contains(l.description, v.keyword)""",
    "inspection_sample": """
, b AS (SELECT batch_id, product_tracking_id, count(*) OVER (PARTITION BY batch_id) AS n,
   ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY md5('7:' || product_tracking_id), product_tracking_id) AS rk
   FROM x_treatment_batch_products)
SELECT batch_id, product_tracking_id, CAST(n AS BIGINT) AS batch_size,
  CAST(least(n, greatest(2, CAST(round_even(n * 0.05, 0) AS BIGINT))) AS BIGINT) AS sample_size
FROM b WHERE rk <= least(n, greatest(2, CAST(round_even(n * 0.05, 0) AS BIGINT)))""",
    "inspection_all": """SELECT p.batch_id, p.product_tracking_id, z.n AS batch_size, z.n AS sample_size
FROM x_treatment_batch_products p JOIN (SELECT batch_id, count(*) AS n FROM x_treatment_batch_products GROUP BY batch_id) z
  ON z.batch_id = p.batch_id""",
    "treatment_qc_evaluation": """
, u AS (SELECT pt.id, tbp.batch_id, tbp.surface_treat, st.status_name AS current_status
   FROM x_treatment_batch_products tbp JOIN x_product_tracking pt ON tbp.product_tracking_id = pt.id
   LEFT JOIN x_product_statuses st ON pt.current_status_id = st.id),
i AS (SELECT product_tracking_id, surface_treated, sterilized, id % 11 = 0 AS quarantine, visual_pass,
   CASE WHEN id % 2 = 0 THEN 'Waste' END AS manual_outcome FROM x_post_treatment_inspections),
j AS (SELECT u.*, i.*, COALESCE(i.visual_pass, TRUE) AS vis,
   CASE WHEN NOT COALESCE(i.sterilized, FALSE) OR NOT COALESCE(i.visual_pass, TRUE) THEN 'Waste'
        WHEN COALESCE(u.surface_treat, FALSE) AND NOT COALESCE(i.surface_treated, FALSE) THEN 'Waste'
        WHEN COALESCE(i.quarantine, FALSE) THEN 'Quarantine'
        WHEN u.current_status = 'A-Ware' AND COALESCE(i.surface_treated, FALSE) AND COALESCE(i.sterilized, FALSE)
             AND COALESCE(i.visual_pass, TRUE) THEN 'Passed'
        ELSE 'B-Ware' END AS suggested_result
   FROM u JOIN i ON u.id = i.product_tracking_id)
SELECT id, batch_id, suggested_result,
  CASE WHEN NOT vis AND manual_outcome IS NOT NULL THEN manual_outcome ELSE suggested_result END AS qc_result,
  CASE WHEN quarantine THEN TRUE ELSE vis END AS visual_pass
FROM j""",
    "expiring_soon": _printed_before(f"< {AS_OF_SQL} - INTERVAL 358 DAY", f">= {_YEAR_AGO}"),
    "expired": _printed_before(f"< {_YEAR_AGO}"),
    "qm_review": G22,
    "qm_post_treatment": G23,
    "quarantined": G24,
    "investigated": G25,
    "quarantine_search": G26,
    "audit_entries": G27,
    "previous_stage": "SELECT id AS product_tracking_id, previous_stage_id FROM x_product_tracking",
    "reasons": G29,
    "contexts": "SELECT id, context_code FROM x_issue_contexts",
    "reasons_for_context": G30,
    "label_data": _labels("Printed"),
    "label_id_series": """SELECT id AS request_id, CAST(unnest(range(product_id, product_id + 1 + id % 5)) AS BIGINT) AS label_id
FROM x_product_tracking""",
    "effective_access": """
, m AS (SELECT DISTINCT * FROM (
   SELECT CAST(s.s_suppkey + 1 AS BIGINT) AS user_id, n.n_name AS group_oid FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
   UNION ALL SELECT CAST(s_suppkey + 1 AS BIGINT), 'NATION_' || CAST(s_suppkey % 25 AS VARCHAR) FROM supplier)),
r AS (SELECT m.user_id, a.area_name, g.access_level,
   ROW_NUMBER() OVER (PARTITION BY m.user_id, a.area_name ORDER BY CASE g.access_level WHEN 'Read' THEN 1 WHEN 'Write' THEN 2
                      WHEN 'Admin' THEN 3 ELSE 0 END DESC) AS rk
   FROM m JOIN x_group_area_rights g ON g.group_oid = m.group_oid JOIN x_application_areas a ON a.id = g.area_id)
SELECT user_id, area_name, access_level FROM r WHERE rk = 1""",
    "qm_bulk_eligible": f"""SELECT 'Post-Harvest Approval' AS approval_type, product_tracking_id AS pid, inspection_result AS result
FROM ({G22}) a WHERE current_stage_name = 'Stored; Pending QM Approval for Treatment'
UNION ALL SELECT 'Post-Treatment Approval', product_tracking_id, inspection_result
FROM ({G23}) b WHERE current_stage_name = 'Stored; Pending QM Approval'""",
}


# fixed values: label, its skus with the surface area printed, QR code, print size
_BIG = [("GEB-CS10KTCS-4", "10197"), ("GEB-CS6KTCS-2", "6001"), ("GEB-CS6KTCS-4", "6124")]
_MINI = [("GEB-CSmTCS", "856"), ("GEB-CSmTC2S", "851"), ("GEB-CSmTCS-2", "851")]
_LABELS = [("CS10K-6K_v1", _BIG, "TRUE", 76), ("CS10K-6K_v2", _BIG, "TRUE", 76), ("CS10K-6K_v3", _BIG, "TRUE", 76),
           ("CSmini_v1", _MINI, "TRUE", 50), ("CSmini_v2", _MINI, "TRUE", 50), ("CSmini_v3", _MINI, "FALSE", 76),
           ("Tridock", [("GEB-CSmTD", "")], "FALSE", 76)]
LABELS = _values([(code, label, qr, str(size), area) for label, skus, qr, size in _LABELS for code, area in skus],
                 ["sku", "label", "qr", "size", "area"])
SQL["label_templates"] = f"""SELECT g.id, g.product_id, g.reference_number, v.label, CAST(v.qr AS BOOLEAN) AS qr_required,
  CAST(v.size AS INTEGER) AS print_size, nullif(v.area, '') AS surface_area, g.expiration_label
FROM ({SQL['label_data']}) g JOIN {LABELS} ON v.sku = g.reference_number"""

_SEARCH = SQL["quarantine_search"]
SQL.update({
    "quarantine_search_unit": f"SELECT * FROM ({_SEARCH}) d WHERE product_id = 18",
    "quarantine_search_lot": f"SELECT * FROM ({_SEARCH}) d WHERE lot_number = '0012'",
    "quarantine_search_batch": f"""SELECT * FROM ({_SEARCH}) d
WHERE product_id IN (SELECT product_tracking_id FROM x_treatment_batch_products WHERE batch_id = 141)""",
    "quarantine_search_mount": f"""SELECT * FROM ({_SEARCH}) d
WHERE harvest_id IN (SELECT id FROM x_product_harvest WHERE filament_mounting_id = 21)""",
    "stored_product": f"SELECT * FROM ({G14}) d WHERE product_id = 9",
    "label_data_after_qc": _labels("HarvestQCComplete"),
    "label_templates_after_qc": SQL["label_templates"].replace("'Printed'", "'HarvestQCComplete'"),
})


def _shelves(units: str, mode: str) -> str:
    status = BUSINESS.replace("inspection_result", "g.inspection_result")
    return f"""SELECT DISTINCT g.id, g.product_id, {status} AS business_status, l.id AS location_id, l.location_name, l.description,
  v.next_stage_code FROM ({units}) g JOIN {SHELF_RULES} ON v.mode = '{mode}' AND v.business_status = {status}
JOIN x_storage_locations l ON contains(l.description, v.keyword)"""


SQL["shelf_options_after_treatment"] = _shelves(SQL["needs_storage_treatment"], "Post-Treatment QC")
SQL["next_stage_modes"] = f"""SELECT q.id, {BUSINESS} AS business_status, v.mode, v.next_stage_code
FROM x_product_quality_control q JOIN {SHELF_RULES} ON v.business_status = {BUSINESS}"""
