"""Oracle SQL (DuckDB) for M1-M22."""

from spooltrace.oracle.lookup import by_id, place, plain, present, report
from spooltrace.oracle.prelude import AS_OF_SQL
from spooltrace.oracle.sql_views import V_FILAMENT_STATUS, V_LID_INVENTORY, V_MATERIAL_USAGE_SUMMARY, V_SEAL_INVENTORY

FS = "(" + V_FILAMENT_STATUS + ")"

UNIT_WEIGHT = """(SELECT s.id AS sku_id, sp.average_weight_g + sp.weight_buffer_g AS unit_weight
  FROM x_product_skus s LEFT JOIN x_product_print_specs sp ON sp.sku_id = s.id)"""
LOTS = """(SELECT f.lot_number, CAST(SUM(fm.remaining_weight) AS DECIMAL(18,2)) AS available_grams
  FROM x_filament_mounting fm JOIN x_filaments f ON fm.filament_tracking_id = f.id
  WHERE fm.status = 'In Use' AND f.qc_result = 'PASS' GROUP BY f.lot_number)"""


def batch_remaining(table: str, material: str) -> str:
    return f"""(SELECT a.serial_number, CAST(a.available_units AS BIGINT) AS available_units,
      CAST(COALESCE(u.used_units, 0) AS BIGINT) AS used_units,
      CAST(a.available_units - COALESCE(u.used_units, 0) AS BIGINT) AS remaining_units
    FROM (SELECT serial_number, SUM(quantity) AS available_units FROM {table} WHERE qc_result = 'PASS' GROUP BY serial_number) a
    LEFT JOIN (SELECT lot_number, COUNT(*) AS used_units FROM x_material_usage
               WHERE material_type = '{material}' AND lot_number IS NOT NULL GROUP BY lot_number) u
      ON u.lot_number = a.serial_number)"""


_SPOOL = ("filament_id", "serial_number")


def _resting(*conditions: str) -> str:
    """Spools in acclimatization that no mount has ever held."""
    spool = "a.filament_tracking_id"
    return report({
        "id": spool, **{k: by_id("filaments", k, spool) for k in (*_SPOOL, "weight_grams")}, "acclimatization_id": "a.id",
        "ready_at": "a.ready_at", "location_name": place(by_id("filaments", "location_id", spool)),
    }, "x_filament_acclimatization a", [
        "a.status = 'Acclimatizing'", *conditions, f"{spool} NOT IN (SELECT m.filament_tracking_id FROM x_filament_mounting m)",
        *present(place(by_id("filaments", "location_id", spool), "id"))])


def _mounts(more: dict[str, str], *conditions: str) -> str:
    return report({
        **more, **{k: by_id("filaments", k, "m.filament_tracking_id") for k in _SPOOL},
        "printer_name": by_id("printers", "name", "m.printer_id"), "remaining_weight": "m.remaining_weight",
    }, "x_filament_mounting m", [*conditions, *present(by_id("filaments", "id", "m.filament_tracking_id"),
                                                       by_id("printers", "id", "m.printer_id"))])


# what a spool weighs: once for each mount it has had, or as received
_WEIGHED = """(SELECT filament_tracking_id AS spool, remaining_weight AS grams FROM x_filament_mounting
  UNION ALL SELECT id, NULL FROM x_filaments WHERE id NOT IN (SELECT filament_tracking_id FROM x_filament_mounting)) w"""
_GRAMS = f"COALESCE(w.grams, {by_id('filaments', 'weight_grams', 'w.spool')})"
_MOUNTABLE = report({
    "id": "w.spool", **{k: by_id("filaments", k, "w.spool") for k in _SPOOL},
    "location_name": place(by_id("filaments", "location_id", "w.spool")), "weight_grams": _GRAMS,
}, _WEIGHED, [f"{_GRAMS} >= 165", *present(place(by_id("filaments", "location_id", "w.spool"), "id")),
              "(SELECT count(*) FROM x_filament_mounting z WHERE z.filament_tracking_id = w.spool AND z.status = 'In Use') = 0"])

SQL = {
    "filaments_in_storage": f"SELECT id, filament_id, serial_number FROM {FS} v WHERE qc_result = 'PASS' AND current_status = 'In Storage'",
    "mountable_filaments": _MOUNTABLE,
    "acclimatized_ready": _resting(f"a.ready_at <= {AS_OF_SQL}"),
    "acclimatizing_restorable": _resting(),
    "available_printers": """SELECT * FROM x_printers WHERE status = 'Active'
  AND id NOT IN (SELECT printer_id FROM x_filament_mounting WHERE unmounted_at IS NULL)""",
    "mounted_filaments": _mounts({"mount_id": "m.id"}, "m.status = 'In Use'"),
    "mounts_with_weight": _mounts({"id": "m.id"}, "m.status = 'In Use'", "m.remaining_weight >= 986"),
    "request_mount_candidates": """
, req AS (SELECT pr.id, pr.sku_id, CAST(COALESCE(sp.average_weight_g + sp.weight_buffer_g + 10, 0) AS DECIMAL(10,2)) AS required_weight
  FROM x_product_requests pr LEFT JOIN x_product_print_specs sp ON sp.sku_id = pr.sku_id
  WHERE pr.status = 'Pending' AND pr.lot_number <> 'LEGACY_LOT'),
cand AS (SELECT r.id AS request_id, fm.id AS mount_id, fm.remaining_weight,
  ROW_NUMBER() OVER (PARTITION BY r.id ORDER BY fm.remaining_weight DESC, fm.id) AS rk
  FROM req r JOIN x_filament_mounting fm ON fm.status = 'In Use' AND fm.remaining_weight >= r.required_weight)
SELECT r.id AS request_id, r.sku_id, r.required_weight,
  CAST((SELECT count(*) FROM cand WHERE cand.request_id = r.id) AS BIGINT) AS candidate_mounts,
  b.mount_id AS best_mount_id, b.remaining_weight AS best_remaining_weight
FROM req r LEFT JOIN cand b ON b.request_id = r.id AND b.rk = 1""",
    "filament_current_weight": """
SELECT f.id AS filament_pk, f.filament_id, f.serial_number, fm.id AS mount_id,
  CASE WHEN fm.id IS NOT NULL THEN fm.remaining_weight WHEN f.weight_grams > 0 THEN f.weight_grams END AS current_weight,
  CASE WHEN fm.id IS NOT NULL THEN 'mounting' WHEN f.weight_grams > 0 THEN 'filament' ELSE 'none' END AS weight_source
FROM x_filaments f LEFT JOIN x_filament_mounting fm ON fm.filament_tracking_id = f.id AND fm.status = 'In Use'""",
    "filament_list": "SELECT * FROM x_filaments ORDER BY id",
    "open_mounts": "SELECT * FROM x_filament_mounting WHERE unmounted_at IS NULL ORDER BY id",
    "unmounted_mounts": _mounts({"mount_id": "m.id", **plain("m", "unmounted_at", "status", "unmounted_by")}, "m.unmounted_at IS NOT NULL"),
    "weight_health_report": f"""SELECT filament_id, serial_number, printer_name, remaining_weight,
  CASE WHEN remaining_weight IS NULL THEN NULL WHEN remaining_weight < 500 THEN 'Critical'
       WHEN remaining_weight < 2500 THEN 'Low' ELSE 'OK' END AS health
FROM {FS} v WHERE current_status = 'In Use'""",
    "filament_inventory": f"SELECT * REPLACE (TRY_CAST(initial_weight AS DECIMAL(10,2)) AS initial_weight, TRY_CAST(remaining_weight AS DECIMAL(10,2)) AS remaining_weight) FROM {FS} v",
    "lid_inventory": f"SELECT * FROM ({V_LID_INVENTORY}) v WHERE serial_number <> 'LEGACY_SEAL'",
    "seal_inventory": f"SELECT * FROM ({V_SEAL_INVENTORY}) v WHERE serial_number <> 'LEGACY_LID'",
    "available_lids": "SELECT id, serial_number FROM x_lids WHERE qc_result = 'PASS' AND serial_number <> 'LEGACY_LID'",
    "available_seals": "SELECT id, serial_number FROM x_seals WHERE qc_result = 'PASS' AND serial_number <> 'LEGACY_SEAL'",
    "all_lids": "SELECT * FROM x_lids",
    "all_seals": "SELECT * FROM x_seals",
    "material_usage_summary": V_MATERIAL_USAGE_SUMMARY,
    "filament_lot_units": f"""
, uw AS {UNIT_WEIGHT}, lots AS {LOTS},
cand AS (SELECT uw.sku_id, lots.lot_number, lots.available_grams, CAST(floor(lots.available_grams / uw.unit_weight) AS BIGINT) AS units
  FROM uw JOIN lots ON floor(lots.available_grams / uw.unit_weight) > 0 WHERE uw.unit_weight IS NOT NULL),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku_id ORDER BY units DESC, lot_number) AS rk FROM cand)
SELECT uw.sku_id, b.lot_number, b.available_grams, CAST(COALESCE(b.units, 0) AS BIGINT) AS max_units
FROM uw LEFT JOIN best b ON b.sku_id = uw.sku_id AND b.rk = 1 WHERE uw.unit_weight IS NOT NULL""",
    "lid_remaining": "SELECT * FROM " + batch_remaining("x_lids", "Lid"),
    "seal_remaining": "SELECT * FROM " + batch_remaining("x_seals", "Seal"),
    "material_feasibility": f"""
, uw AS {UNIT_WEIGHT}, lots AS {LOTS},
req AS (SELECT sku_id, CAST(count(*) AS BIGINT) AS quantity FROM x_product_requests
  WHERE status = 'Pending' AND lot_number <> 'LEGACY_LOT' GROUP BY sku_id),
cand AS (SELECT uw.sku_id, lots.lot_number, CAST(floor(lots.available_grams / uw.unit_weight) AS BIGINT) AS units
  FROM uw JOIN lots ON floor(lots.available_grams / uw.unit_weight) > 0 WHERE uw.unit_weight IS NOT NULL),
bf AS (SELECT sku_id, units, lot_number FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku_id ORDER BY units DESC, lot_number) AS rk FROM cand) WHERE rk = 1),
lid AS (SELECT serial_number, remaining_units FROM {batch_remaining("x_lids", "Lid")} WHERE remaining_units > 0
        ORDER BY remaining_units DESC, serial_number LIMIT 1),
seal AS (SELECT serial_number, remaining_units FROM {batch_remaining("x_seals", "Seal")} WHERE remaining_units > 0
        ORDER BY remaining_units DESC, serial_number LIMIT 1)
SELECT q.sku_id, q.quantity, uw.unit_weight IS NOT NULL AS has_spec,
  CASE WHEN uw.unit_weight IS NOT NULL THEN COALESCE(bf.units, 0) < q.quantity END AS filament_short,
  CASE WHEN uw.unit_weight IS NOT NULL THEN COALESCE((SELECT remaining_units FROM lid), 0) < q.quantity END AS lid_short,
  CASE WHEN uw.unit_weight IS NOT NULL THEN COALESCE((SELECT remaining_units FROM seal), 0) < q.quantity END AS seal_short,
  CASE WHEN uw.unit_weight IS NOT NULL THEN bf.lot_number END AS best_filament_lot,
  CASE WHEN uw.unit_weight IS NOT NULL THEN (SELECT serial_number FROM lid) END AS best_lid,
  CASE WHEN uw.unit_weight IS NOT NULL THEN (SELECT serial_number FROM seal) END AS best_seal,
  CASE WHEN uw.unit_weight IS NOT NULL THEN CAST(least(COALESCE(bf.units, 0), COALESCE((SELECT remaining_units FROM lid), 0),
       COALESCE((SELECT remaining_units FROM seal), 0)) AS BIGINT) END AS max_units
FROM req q LEFT JOIN uw ON uw.sku_id = q.sku_id LEFT JOIN bf ON bf.sku_id = q.sku_id""",
    "storage_locations": "SELECT * FROM x_storage_locations",
    "printers": "SELECT * FROM x_printers",
    "users": "SELECT * FROM x_users",
}
