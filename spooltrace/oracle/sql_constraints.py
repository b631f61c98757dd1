"""Oracle SQL (DuckDB) for the constraint report: one count per constraint, each on its own."""

# fixed values: constraints by kind, one line per table
REQUIRED = """
product_tracking harvest_id product_id product_type_id sku_id current_stage_id
product_harvest request_id lid_id seal_id filament_mounting_id printed_by
product_requests requested_by sku_id lot_number
product_quality_control product_tracking_id inspected_by inspected_at weight_grams pressure_drop visual_pass inspection_result
post_treatment_inspections product_tracking_id inspected_by visual_pass surface_treated sterilized qc_result
filaments filament_id serial_number lot_number location_id weight_grams received_at received_by qc_result
filament_mounting filament_tracking_id printer_id mounted_by remaining_weight status
filament_acclimatization filament_tracking_id moved_by moved_at status
lids serial_number quantity location_id received_at received_by qc_result
seals serial_number quantity location_id received_at received_by qc_result
treatment_batches sent_by sent_at status
treatment_batch_products batch_id product_tracking_id surface_treat sterilize
customers customer_name
orders customer_id order_date order_creator_id status updated_by
order_items order_id product_sku_id quantity
shipments customer_id creator_id created_date status updated_by
shipment_unit_items shipment_id product_tracking_id
quarantined_products product_tracking_id from_stage_id source quarantine_date quarantined_by quarantine_status
product_investigations product_tracking_id status created_by created_at
material_usage product_tracking_id material_type lot_number used_quantity used_at used_by
audit_log table_name record_id field_name reason changed_by changed_at
product_skus product_type_id sku name is_serialized is_bundle pack_qty is_active
product_print_specs height_mm diameter_mm average_weight_g weight_buffer_g
issue_reason_contexts reason_id context_id
group_area_rights group_oid area_id access_level
"""

PARENTS = """
users product_harvest.printed_by product_requests.requested_by product_quality_control.inspected_by
users post_treatment_inspections.inspected_by filaments.received_by filament_mounting.mounted_by filament_mounting.unmounted_by
users filament_acclimatization.moved_by lids.received_by seals.received_by treatment_batches.sent_by orders.order_creator_id
users orders.updated_by shipments.creator_id shipments.updated_by quarantined_products.quarantined_by
users quarantined_products.resolved_by product_investigations.created_by product_investigations.resolved_by
users material_usage.used_by audit_log.changed_by
product_tracking product_quality_control.product_tracking_id post_treatment_inspections.product_tracking_id
product_tracking treatment_batch_products.product_tracking_id shipment_unit_items.product_tracking_id
product_tracking quarantined_products.product_tracking_id product_investigations.product_tracking_id material_usage.product_tracking_id
product_harvest product_tracking.harvest_id material_usage.harvest_id
product_requests product_harvest.request_id
lids product_harvest.lid_id
seals product_harvest.seal_id
filament_mounting product_harvest.filament_mounting_id
filaments filament_mounting.filament_tracking_id filament_acclimatization.filament_tracking_id
printers filament_mounting.printer_id
storage_locations product_tracking.location_id filaments.location_id lids.location_id seals.location_id quarantined_products.location_id
lifecycle_stages product_tracking.current_stage_id product_tracking.previous_stage_id quarantined_products.from_stage_id
product_statuses product_tracking.current_status_id
product_skus product_tracking.sku_id product_requests.sku_id order_items.product_sku_id product_print_specs.sku_id
product_types product_tracking.product_type_id product_skus.product_type_id
treatment_batches treatment_batch_products.batch_id
customers orders.customer_id shipments.customer_id
orders orders.parent_order_id order_items.order_id shipments.order_id
shipments shipment_unit_items.shipment_id
issue_reasons issue_reason_contexts.reason_id
issue_contexts issue_reason_contexts.context_id
application_areas group_area_rights.area_id
"""

ALLOWED = {
    "product_requests.status": "Pending|Fulfilled|Cancelled",
    "product_quality_control.inspection_result": "Passed|B-Ware|Quarantine|Waste",
    "post_treatment_inspections.qc_result": "Passed|B-Ware|Quarantine|Waste",
    "filaments.qc_result": "PASS|FAIL", "lids.qc_result": "PASS|FAIL", "seals.qc_result": "PASS|FAIL",
    "filament_mounting.status": "In Use|Unmounted", "filament_acclimatization.status": "Acclimatizing|Complete",
    "treatment_batches.status": "Shipped|Inspected", "orders.status": "Processing|Shipped|Completed|Canceled",
    "shipments.status": "Pending|Shipped|In Transit|Delivered|Returned|Canceled",
    "quarantined_products.source": "Harvest QC|Post-Treatment QC|Ad-Hoc",
    "quarantined_products.quarantine_status": "Active|Released|Disposed", "quarantined_products.result": "Passed|B-Ware|Waste",
    "product_investigations.status": "Under Investigation|Cleared A-Ware|Cleared B-Ware|Disposed",
    "material_usage.material_type": "Filament|Lid|Seal", "group_area_rights.access_level": "Read|Write|Admin",
}
LEAST = {"order_items.quantity": "<= 0", "product_skus.pack_qty": "<= 0", "product_print_specs.height_mm": "<= 0",
         "product_print_specs.diameter_mm": "<= 0", "product_print_specs.average_weight_g": "<= 0",
         "product_print_specs.weight_buffer_g": "< 0"}
UNIQUE = ["product_tracking harvest_id", "product_tracking product_id", "product_tracking product_code", "filaments filament_id",
          "filament_acclimatization filament_tracking_id", "lids serial_number", "seals serial_number",
          "treatment_batch_products product_tracking_id", "customers customer_name", "shipment_unit_items product_tracking_id",
          "product_skus sku", "issue_reason_contexts reason_id, context_id", "group_area_rights group_oid, area_id"]


def _row(table: str, name: str, counted: str) -> str:
    return f"SELECT '{table}' AS table_name, '{name}' AS constraint_name, CAST(({counted}) AS BIGINT) AS n"


def _all() -> list[str]:
    out = []
    for line in REQUIRED.strip().splitlines():
        table, *cols = line.split()
        out += [_row(table, f"NN {x}", f"SELECT count(*) FROM x_{table} WHERE {x} IS NULL") for x in cols]
    for line in PARENTS.strip().splitlines():
        parent, *refs = line.split()
        for table, x in (r.split(".") for r in refs):
            out.append(_row(table, f"FK {x}", f"SELECT count(*) FROM x_{table} k WHERE k.{x} IS NOT NULL "
                                              f"AND NOT EXISTS (SELECT 1 FROM x_{parent} p WHERE p.id = k.{x})"))
    for ref, values in ALLOWED.items():
        table, x = ref.split(".")
        listed = ", ".join(f"'{v}'" for v in values.split("|"))
        out.append(_row(table, f"CK {x}", f"SELECT count(*) FROM x_{table} WHERE {x} NOT IN ({listed})"))
    for ref, bad in LEAST.items():
        table, x = ref.split(".")
        out.append(_row(table, f"CK {x}", f"SELECT count(*) FROM x_{table} WHERE {x} {bad}"))
    for entry in UNIQUE:
        table, cols = entry.split(" ", 1)
        out.append(_row(table, f"UQ {cols}", f"SELECT count(*) FROM (SELECT 1 FROM x_{table} WHERE COALESCE("
                        + ", ".join(f"CAST({x} AS VARCHAR)" for x in cols.split(", "))
                        + f") IS NOT NULL GROUP BY {cols} HAVING count(*) > 1) d"))
    return out


SQL = {"constraint_report": " UNION ALL ".join(_all())}
