"""Oracle SQL (DuckDB) for H1-H20."""

from spooltrace.oracle.lookup import HARVEST, REQUEST, UNITS, by_id, plain, present, report, sku, stage, user
from spooltrace.oracle.prelude import AS_OF_SQL
from spooltrace.oracle.sql_operations import harvest_of, request_of, unit_of

# units that may be sold: of good status and printed within a year
READY = report({
    "product_id": "u.id", "tracking_id": "u.product_id", "sku_id": REQUEST["sku_id"], "print_date": HARVEST["print_date"],
    "last_updated_at": "u.last_updated_at", "stage_code": stage("stage_code"),
}, UNITS, [f"{by_id('product_statuses', 'status_name', 'u.current_status_id')} IN ('A-Ware', 'B-Ware')",
           f"{HARVEST['print_date']} >= {AS_OF_SQL} - INTERVAL 1 YEAR", *present(REQUEST["id"], stage("id"))])
PICKABLE = f"""(SELECT * EXCLUDE (stage_code) FROM ({READY}) r WHERE r.stage_code = 'QMSalesApproval'
  AND r.sku_id IN (SELECT k.id FROM x_product_skus k WHERE k.is_serialized AND NOT k.is_bundle))"""

OPEN_LINES = """FROM x_order_items oi JOIN x_orders o ON oi.order_id = o.id AND o.status = 'Processing'
JOIN x_product_skus s ON oi.product_sku_id = s.id"""

UNIT_REQ = f"""SELECT oi.order_id, oi.id AS order_item_id, oi.product_sku_id AS sku_id, s.sku, s.name AS sku_name,
  COALESCE(s.pack_qty, 1) AS pack_qty, oi.quantity AS order_qty, oi.quantity * COALESCE(s.pack_qty, 1) AS required_units,
  s.is_bundle, s.is_serialized, o.order_date {OPEN_LINES}"""

CANCELED = report({
    "order_id": "w.id", **plain("w", "customer_id", "order_date", "notes"),
    "customer_name": by_id("customers", "customer_name", "w.customer_id"),
}, "x_orders w", ["w.status = 'Canceled'", *present(by_id("customers", "id", "w.customer_id")),
                  "w.id NOT IN (SELECT k.parent_order_id FROM x_orders k WHERE k.parent_order_id IS NOT NULL)"])

BOM = """
, RECURSIVE walk(root_sku_id, node, qty) AS (
   SELECT id, id, CAST(1 AS BIGINT) FROM x_product_skus
   UNION ALL
   SELECT w.root_sku_id, b.component_sku_id, w.qty * b.component_qty
   FROM walk w JOIN x_sku_bom b ON b.parent_sku_id = w.node),
closure AS (SELECT root_sku_id, node AS component_sku_id, CAST(sum(qty) AS BIGINT) AS qty FROM walk
   WHERE NOT EXISTS (SELECT 1 FROM x_sku_bom b WHERE b.parent_sku_id = walk.node) GROUP BY root_sku_id, node)
"""

OPEN_ORDERS = """SELECT o.id AS order_id, c.customer_name, o.order_date, o.notes, o.parent_order_id, o.status, o.updated_at,
  o.updated_by, o.customer_id FROM x_orders o JOIN x_customers c ON o.customer_id = c.id WHERE o.status = 'Processing'"""

FIFO = f"""
, units AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku_id ORDER BY print_date, product_id) AS fifo_rank FROM {PICKABLE} p),
navail AS (SELECT sku_id, count(*) AS n FROM units GROUP BY sku_id),
lines AS (SELECT r.*, SUM(required_units) OVER (PARTITION BY sku_id ORDER BY order_date, order_id, order_item_id
     ROWS UNBOUNDED PRECEDING) AS run_end FROM ({UNIT_REQ}) r WHERE r.is_serialized OR r.is_bundle),
lines2 AS (SELECT l.*, run_end - required_units AS run_start, COALESCE(na.n, 0) AS n FROM lines l LEFT JOIN navail na ON na.sku_id = l.sku_id)
"""

SQL = {
    "active_skus": "SELECT id, sku, name, is_serialized, is_bundle, product_type_id FROM x_product_skus WHERE is_active",
    "orderable_types": "SELECT * FROM x_product_types WHERE is_active",
    "customers": "SELECT id, customer_name FROM x_customers",
    "product_types": "SELECT id, name FROM x_product_types WHERE is_active",
    "sales_ready_qty": f"""SELECT r.sku_id, count(*) AS qty FROM ({READY}) r
WHERE r.stage_code IN ('QMSalesApproval', 'Internal Use/Client') AND r.sku_id IN (SELECT k.id FROM x_product_skus k) GROUP BY r.sku_id""",
    "sales_inventory": report({
        **plain("u", "id", "last_updated_at"), "sku_id": sku("id", "u.sku_id"), "sku": sku("sku", "u.sku_id"),
        "sku_name": sku("name", "u.sku_id"), "lot_number": REQUEST["lot_number"], "current_stage": stage(),
        "product_status": by_id("product_statuses", "status_name", "u.current_status_id"),
        "printed_by": user(HARVEST["printed_by"]),
    }, UNITS, [f"{stage('stage_code')} = 'QMSalesApproval'", f"{HARVEST['print_date']} >= {AS_OF_SQL} - INTERVAL 1 YEAR",
               f"{by_id('product_statuses', 'status_name', 'u.current_status_id')} IN ('A-Ware', 'B-Ware')",
               *present(REQUEST["id"], sku("id", "u.sku_id"), user(HARVEST["printed_by"]))]),
    "canceled_orders": CANCELED,
    "canceled_order_items": f"""SELECT oi.order_id, s.product_type_id, ty.name AS product_type, oi.quantity
FROM x_order_items oi JOIN x_product_skus s ON oi.product_sku_id = s.id JOIN x_product_types ty ON s.product_type_id = ty.id
WHERE oi.order_id IN (SELECT order_id FROM ({CANCELED}) h)""",
    "unit_requirements": UNIT_REQ,
    "bom_expand": BOM + "SELECT root_sku_id AS parent_sku_id, component_sku_id, qty AS component_qty FROM closure",
    "order_components": BOM + f"""SELECT oi.order_id, cl.component_sku_id, CAST(sum(oi.quantity * cl.qty) AS BIGINT) AS required_qty,
  s.sku, s.name AS sku_name, s.is_serialized
FROM x_order_items oi JOIN x_orders o ON oi.order_id = o.id AND o.status = 'Processing'
JOIN closure cl ON cl.root_sku_id = oi.product_sku_id JOIN x_product_skus s ON s.id = cl.component_sku_id
GROUP BY oi.order_id, cl.component_sku_id, s.sku, s.name, s.is_serialized""",
    "fifo_pick": f"SELECT * FROM {PICKABLE} p WHERE sku_id = 1 ORDER BY print_date, product_id LIMIT 5",
    "fifo_allocate": FIFO + """SELECT order_id, order_item_id, sku_id, sku, sku_name, pack_qty, order_qty, required_units, is_bundle,
  is_serialized, order_date, CAST(greatest(least(run_end, n) - run_start, 0) AS BIGINT) AS allocated_units,
  greatest(least(run_end, n) - run_start, 0) < required_units AS is_short FROM lines2""",
    "fifo_allocation_units": FIFO + """SELECT u.product_id, u.tracking_id, u.sku_id, u.print_date, u.last_updated_at, u.fifo_rank,
  l.order_id, l.order_item_id, l.sku, l.sku_name, l.pack_qty, l.order_qty, l.required_units, l.is_bundle, l.is_serialized, l.order_date
FROM units u JOIN lines2 l ON l.sku_id = u.sku_id AND u.fifo_rank > l.run_start AND u.fifo_rank <= l.run_end""",
    "shipment_sku_items": FIFO + """
, alloc AS (SELECT l.order_id, u.sku_id FROM units u JOIN lines2 l ON l.sku_id = u.sku_id AND u.fifo_rank > l.run_start AND u.fifo_rank <= l.run_end),
picked AS (SELECT a.order_id, a.sku_id, count(*) AS units FROM alloc a GROUP BY a.order_id, a.sku_id),
ser AS (SELECT p.order_id, p.sku_id AS product_sku_id,
   CAST(CASE WHEN s.is_bundle AND s.pack_qty > 0 THEN p.units // s.pack_qty ELSE p.units END AS BIGINT) AS quantity
   FROM picked p JOIN x_product_skus s ON s.id = p.sku_id),
ns AS (SELECT order_id, sku_id AS product_sku_id, CAST(order_qty AS BIGINT) AS quantity FROM (""" + UNIT_REQ + """) r
   WHERE NOT r.is_serialized AND NOT r.is_bundle)
SELECT * FROM (SELECT * FROM ser UNION ALL SELECT * FROM ns) WHERE quantity > 0""",
    "active_shipments": report({
        "shipment_id": "d.id", **plain("d", "status", "order_id", "customer_id", "created_date", "ship_date", "delivery_date", "carrier",
                                       "tracking_number"), "customer_name": by_id("customers", "customer_name", "d.customer_id"),
    }, "x_shipments d", ["d.status IN ('Pending', 'Shipped')", *present(by_id("customers", "id", "d.customer_id"))]),
    "shipment_products": report({
        "shipment_id": "v.shipment_id", "product_id": "v.product_tracking_id", "tracking_id": unit_of("v.product_tracking_id", "product_id"),
        "sku": sku("sku", request_of("v.product_tracking_id", "sku_id")), "sku_name": sku("name", request_of("v.product_tracking_id", "sku_id")),
        "print_date": harvest_of("v.product_tracking_id", "print_date"),
    }, "x_shipment_unit_items v", present(sku("id", request_of("v.product_tracking_id", "sku_id")))),
    "processing_orders": f"""SELECT h.*, COALESCE(n.js, '[]') AS order_items
FROM ({OPEN_ORDERS}) h LEFT JOIN (
  SELECT li.order_id AS oid, CAST(to_json(list({{'id': li.id, 'product_sku_id': li.product_sku_id, 'sku': k.sku, 'sku_name': k.name,
    'quantity': li.quantity}} ORDER BY li.id, li.product_sku_id)) AS VARCHAR) AS js
  FROM x_order_items li JOIN x_product_skus k ON k.id = li.product_sku_id GROUP BY li.order_id) n ON n.oid = h.order_id""",
    "open_orders": OPEN_ORDERS,
    "skus_with_specs_flag": report({**plain("k", "id", "sku", "name", "is_active"),
        "has_print_specs": "CAST(k.id IN (SELECT z.sku_id FROM x_product_print_specs z) AS INTEGER)"}, "x_product_skus k"),
    "package_estimate": f"""
, counts AS (SELECT oi.order_id, s.product_type_id, sum(oi.quantity) AS ordered {OPEN_LINES} GROUP BY oi.order_id, s.product_type_id)
SELECT c.order_id, p.package_id, CAST(max(floor(c.ordered / p.quantity)) AS BIGINT) AS packages
FROM counts c JOIN x_packages p ON p.item_kind = 'product' AND p.quantity > 0 AND p.item_id = c.product_type_id
GROUP BY c.order_id, p.package_id""",
    "package_totals": f"""
, counts AS (SELECT oi.order_id, s.product_type_id, sum(oi.quantity) AS ordered {OPEN_LINES} GROUP BY oi.order_id, s.product_type_id),
est AS (SELECT c.order_id, p.package_id, CAST(max(floor(c.ordered / p.quantity)) AS BIGINT) AS packages
  FROM counts c JOIN x_packages p ON p.item_kind = 'product' AND p.quantity > 0 AND p.item_id = c.product_type_id
  GROUP BY c.order_id, p.package_id)
SELECT e.order_id, p.item_kind, p.item_id, CAST(sum(p.quantity * e.packages) AS BIGINT) AS quantity
FROM est e JOIN x_packages p ON p.package_id = e.package_id WHERE e.packages > 0 GROUP BY e.order_id, p.item_kind, p.item_id""",
}
SQL["shipment_non_serialized"] = SQL["shipment_sku_items"].replace(
    "SELECT * FROM (SELECT * FROM ser UNION ALL SELECT * FROM ns) WHERE quantity > 0",
    """SELECT x.order_id, x.product_sku_id AS sku_id, ps.sku, ps.name AS sku_name, x.quantity
FROM (SELECT * FROM ser UNION ALL SELECT * FROM ns) x JOIN x_product_skus ps ON ps.id = x.product_sku_id WHERE x.quantity > 0""")

SQL["sales_summary"] = f"SELECT sku, sku_name, count(*) AS count FROM ({SQL['sales_inventory']}) d GROUP BY sku, sku_name"
for _name, _cond in (("sku", "sku = 'GEB-CSmTCS'"), ("status", "product_status = 'B-Ware'"), ("operator", "printed_by = 'Op 0008'")):
    SQL[f"sales_summary_by_{_name}"] = (f"SELECT sku, sku_name, count(*) AS count FROM ({SQL['sales_inventory']}) d "
                                        f"WHERE {_cond} GROUP BY sku, sku_name")
