"""Oracle SQL (DuckDB) for I1-I10, from the output contract: one independent look-up per column."""

from spooltrace.oracle.lookup import (HARVEST, REQUEST, UNITS, by_id, of_unit, place, plain, present, report, sku, stage,
                                      type_name, user)

_BUSY = "SELECT w.filament_tracking_id FROM x_filament_acclimatization w WHERE w.status IN ('Acclimatizing', 'In Production')"
_SPOOL = {n: by_id("filaments", n, "m.filament_tracking_id") for n in
          ("id", "serial_number", "qc_result", "weight_grams", "received_at", "received_by", "location_id")}
_MOUNTS = "x_filament_mounting m"
_MACHINE = by_id("printers", "name", "m.printer_id")
_OPEN_MOUNT = "(SELECT m.{} FROM x_filament_mounting m WHERE m.filament_tracking_id = s.id AND m.unmounted_at IS NULL)"
_QC = of_unit("product_quality_control", "inspection_result")
_UNTREATED = f"{of_unit('treatment_batch_products', 'batch_id')} IS NULL"

_WARMING = "SELECT w.filament_tracking_id AS k, w.status, w.moved_at, w.ready_at FROM x_filament_acclimatization w WHERE w.status = 'Acclimatizing'"
_IDLE = f"SELECT s.id AS k, 'Storage' AS status, NULL::TIMESTAMP AS moved_at, NULL::TIMESTAMP AS ready_at FROM x_filaments s WHERE s.id NOT IN ({_BUSY})"

SQL = {
    "active_filaments": "SELECT DISTINCT * FROM (" + report({
        "status": "n.status", "moved_at": "n.moved_at", "ready_at": "n.ready_at",
        **{k: by_id("filaments", k, "n.k") for k in ("serial_number", "qc_result", "received_at")},
        "initial_weight": by_id("filaments", "weight_grams", "n.k"),
        "location_name": place(by_id("filaments", "location_id", "n.k")),
    }, f"({_IDLE} UNION ALL {_WARMING}) n", present(by_id("filaments", "id", "n.k"))) + ") d",
    "archived_filaments": report({
        **plain("m", "remaining_weight", "status", "mounted_at", "unmounted_at"), "printer_name": _MACHINE,
        "serial_number": _SPOOL["serial_number"], "qc_result": _SPOOL["qc_result"], "initial_weight": _SPOOL["weight_grams"],
        "unmounted_by": user("m.unmounted_by"),
    }, _MOUNTS, ["m.unmounted_at IS NOT NULL", *present(_SPOOL["id"])]),
    "in_use_filaments": report({
        **plain("m", "remaining_weight", "mounted_at"), "printer_name": _MACHINE, "initial_weight": _SPOOL["weight_grams"],
        **{k: _SPOOL[k] for k in ("id", "serial_number", "qc_result", "received_at")},
        "received_by": user(_SPOOL["received_by"]), "location_name": place(_SPOOL["location_id"]),
    }, _MOUNTS, ["m.unmounted_at IS NULL", *present(_SPOOL["id"], by_id("printers", "id", "m.printer_id"))]),
    "filaments_with_mount": report({
        **plain("s", "id", "serial_number", "qc_result", "received_at"), "initial_weight": "s.weight_grams",
        "remaining_weight": _OPEN_MOUNT.format("remaining_weight"),
        "printer_name": by_id("printers", "name", _OPEN_MOUNT.format("printer_id")),
        "received_by": user("s.received_by"), "storage_location": place("s.location_id"),
    }, "x_filaments s"),
    "low_filaments": report({
        **plain("m", "id", "remaining_weight"), "serial_number": _SPOOL["serial_number"], "printer_name": _MACHINE,
    }, _MOUNTS, ["m.remaining_weight < 2500", *present(_SPOOL["id"], by_id("printers", "id", "m.printer_id"))]),
    "not_acclimatizing": report(plain("s", "id", "serial_number"), "x_filaments s",
                                ["s.qc_result = 'PASS'", f"s.id NOT IN ({_BUSY})"]),
    "needs_storage_v1": report({
        "tracking_id": "u.id", **plain("u", "location_id", "last_updated_at"), "current_status": stage(),
        "harvest_id": HARVEST["id"], "print_date": HARVEST["print_date"], "printed_by": user(HARVEST["printed_by"]),
        "inspection_result": _QC, "product_type": type_name(REQUEST["sku_id"]),
        "filament_serial": by_id("filaments", "serial_number", by_id(
            "filament_mounting", "filament_tracking_id", HARVEST["filament_mounting_id"])),
    }, UNITS, ["u.location_id IS NULL", f"{_QC} IN ('Passed', 'B-Ware', 'Quarantine')", _UNTREATED,
               *present(type_name(REQUEST["sku_id"]), by_id("filaments", "id", by_id(
                   "filament_mounting", "filament_tracking_id", HARVEST["filament_mounting_id"])))]),
    "qc_passed_v1": report({
        "tracking_id": "u.id", "last_updated_at": "u.last_updated_at", "current_status": stage(), "inspection_result": _QC,
        "harvest_id": HARVEST["id"], "product_type": type_name(REQUEST["sku_id"]), "location_name": place("u.location_id"),
    }, UNITS, [f"{stage('stage_code')} = 'InInterimStorage'", _UNTREATED,
               *present(of_unit("product_quality_control", "id"), type_name(REQUEST["sku_id"]))]),
    "printed_without_qc": report({
        "harvest_id": HARVEST["id"], "request_id": REQUEST["id"], "lot_number": REQUEST["lot_number"],
        "print_date": HARVEST["print_date"], "product_type": type_name(REQUEST["sku_id"]),
        **{out: f"(SELECT z.{col} FROM x_product_print_specs z WHERE z.sku_id = {sku('id', REQUEST['sku_id'])})"
           for out, col in (("average_weight", "average_weight_g"), ("buffer_weight", "weight_buffer_g"))},
    }, UNITS, [f"{stage('stage_code')} = 'Printed'", f"{of_unit('product_quality_control', 'id')} IS NULL",
               *present(type_name(REQUEST["sku_id"]))]),
    "product_record": report({
        "tracking_id": "u.id", "location_id": "u.location_id", "current_status": stage(),
        **{k: of_unit("post_treatment_inspections", k) for k in ("visual_pass", "surface_treated", "sterilized", "qc_result")},
    }, UNITS),
}

_FIELDS = ["id", "batch_id", "product_tracking_id", "surface_treat", "sterilize"]
SQL["record_by_id"] = " UNION ALL ".join(
    f"SELECT {i} AS position, '{x}' AS field, CAST({x} AS VARCHAR) AS value FROM x_treatment_batch_products WHERE id = 9"
    for i, x in enumerate(_FIELDS))
