"""Sales and shipment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.operators import bom as BOM
from spooltrace.operators import fifo as FIFO
from spooltrace.session import broadcast_if_small

c = F.col


def active_skus(db) -> DataFrame:
    """H1: active skus by sku code."""
    return db.product_skus.where(c("is_active")).select(
        "id", "sku", "name", "is_serialized", "is_bundle", "product_type_id").orderBy("sku")


def orderable_types(db) -> DataFrame:
    """H1: active product types by name."""
    return db.product_types.where(c("is_active")).orderBy("name")


def customers_sorted(db) -> DataFrame:
    """H1: customers by name."""
    return db.customers.select("id", "customer_name").orderBy("customer_name")


def product_types_sorted(db) -> DataFrame:
    """H1: active product types (id, name) by name."""
    return db.product_types.where(c("is_active")).select("id", "name").orderBy("name")


def _releasable(db, as_of: str, stages) -> DataFrame:
    t = F.lit(as_of).cast("timestamp_ntz")
    return (db.product_tracking.alias("pt")
            .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
            .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
            .join(db.product_statuses.alias("ps"), c("pt.current_status_id") == c("ps.id"))
            .join(db.lifecycle_stages.alias("ls"), c("pt.current_stage_id") == c("ls.id"))
            .where(c("ls.stage_code").isin(*stages) & c("ps.status_name").isin("A-Ware", "B-Ware")
                   & (c("ph.print_date") >= F.timestamp_add("YEAR", F.lit(-1), t))))


def sales_ready_qty(db, as_of: str) -> DataFrame:
    """H2: releasable units (A/B-Ware, approved for sales, printed within a year) per request sku.

    The stage list keeps the literal 'Internal Use/Client', which is a stage
    *name* compared with codes, so it never matches (documented defect).
    """
    r = _releasable(db, as_of, ["QMSalesApproval", "Internal Use/Client"]).join(
        db.product_skus.alias("s"), c("pr.sku_id") == c("s.id"))
    return r.groupBy(c("pr.sku_id").alias("sku_id")).agg(F.count(F.lit(1)).alias("qty"))


def processing_orders(db) -> DataFrame:
    """H3: open order headers with their lines nested (one join + collect per order; an order has
    at most one line per sku)."""
    lines = (db.order_items.alias("oi").join(db.product_skus.alias("s"), c("oi.product_sku_id") == c("s.id"))
             .select(c("oi.order_id").alias("_oid"),
                     F.struct(c("oi.id").alias("id"), c("oi.product_sku_id").alias("product_sku_id"),
                              c("s.sku").alias("sku"), c("s.name").alias("sku_name"),
                              c("oi.quantity").alias("quantity")).alias("_line"))
             .groupBy("_oid").agg(F.array_sort(F.collect_list("_line")).alias("order_items")))
    return (open_orders(db).join(lines, c("order_id") == c("_oid"), "left").drop("_oid")
            .withColumn("order_items", F.coalesce(c("order_items"), F.array().cast(lines.schema["order_items"].dataType))))


def processing_orders_flat(db) -> DataFrame:
    """H3 with the nested lines as JSON text, for readers without nested types."""
    return processing_orders(db).withColumn("order_items", F.to_json("order_items"))


def sales_inventory(db, as_of: str) -> DataFrame:
    """H4: releasable units with sku, lot, status, stage and printer operator, newest first."""
    r = (_releasable(db, as_of, ["QMSalesApproval"])
         .join(db.product_skus.alias("psku"), c("psku.id") == c("pt.sku_id"))
         .join(db.users.alias("u"), c("ph.printed_by") == c("u.id")))
    return r.select(c("pt.id").alias("id"), c("psku.id").alias("sku_id"), c("psku.sku").alias("sku"),
                    c("psku.name").alias("sku_name"), c("pr.lot_number").alias("lot_number"),
                    c("ps.status_name").alias("product_status"), c("ls.stage_name").alias("current_stage"),
                    c("pt.last_updated_at").alias("last_updated_at"),
                    c("u.display_name").alias("printed_by")).orderBy(c("last_updated_at").desc())


def sales_summary(db, as_of: str, sku=None, status=None, operator=None) -> DataFrame:
    """H5: H4 filtered by sku / status / operator, counted per (sku, sku_name)."""
    inv = sales_inventory(db, as_of)
    if sku is not None:
        inv = inv.where(c("sku") == sku)
    if status is not None:
        inv = inv.where(c("product_status") == status)
    if operator is not None:
        inv = inv.where(c("printed_by") == operator)
    return inv.groupBy("sku", "sku_name").agg(F.count(F.lit(1)).alias("count"))


def canceled_orders(db) -> DataFrame:
    """H6: canceled orders that no order names as its parent."""
    children = db.orders.where(c("parent_order_id").isNotNull()).select(c("parent_order_id").alias("_parent"))
    out = (db.orders.alias("o").where(c("o.status") == "Canceled")
           .join(children, c("o.id") == c("_parent"), "left_anti")
           .join(db.customers.alias("cu"), c("o.customer_id") == c("cu.id")))
    return out.select(c("o.id").alias("order_id"), c("o.customer_id").alias("customer_id"),
                      c("cu.customer_name").alias("customer_name"), c("o.order_date").alias("order_date"),
                      c("o.notes").alias("notes")).orderBy(c("order_date").desc())


def canceled_order_items(db) -> DataFrame:
    """H7: lines of re-creatable canceled orders with product type (via the line's sku)."""
    heads = canceled_orders(db).select(c("order_id").alias("_oid"))
    out = (db.order_items.alias("oi").join(heads, c("oi.order_id") == c("_oid"), "left_semi")
           .join(db.product_skus.alias("s"), c("oi.product_sku_id") == c("s.id"))
           .join(db.product_types.alias("ty"), c("s.product_type_id") == c("ty.id")))
    return out.select(c("oi.order_id").alias("order_id"), c("s.product_type_id").alias("product_type_id"),
                      c("ty.name").alias("product_type"), c("oi.quantity").alias("quantity"))


def _open_lines(db) -> DataFrame:
    heads = db.orders.where(c("status") == "Processing").select(c("id").alias("_oid"), c("order_date").alias("order_date"))
    return (db.order_items.alias("oi").join(heads, c("oi.order_id") == c("_oid"))
            .join(db.product_skus.alias("s"), c("oi.product_sku_id") == c("s.id")))


def unit_requirements(db) -> DataFrame:
    """H8: per open order line, required units = quantity x pack quantity (default 1)."""
    pack = F.coalesce(c("s.pack_qty"), F.lit(1))
    return _open_lines(db).select(
        c("oi.order_id").alias("order_id"), c("oi.id").alias("order_item_id"),
        c("oi.product_sku_id").alias("sku_id"), c("s.sku").alias("sku"), c("s.name").alias("sku_name"),
        pack.alias("pack_qty"), c("oi.quantity").alias("order_qty"), (c("oi.quantity") * pack).alias("required_units"),
        c("s.is_bundle").alias("is_bundle"), c("s.is_serialized").alias("is_serialized"), "order_date")


def bom_expand(db) -> DataFrame:
    """H9: per sku, leaf components and quantities per one unit (no BOM rows: the sku itself)."""
    return BOM.bom_closure(db.sku_bom, db.product_skus.select("id")).select(
        c("root_sku_id").alias("parent_sku_id"), "component_sku_id", c("qty").alias("component_qty"))


def order_components(db) -> DataFrame:
    """Per open order, total leaf components of all its lines, with sku fields."""
    closure = BOM.bom_closure(db.sku_bom, db.product_skus.select("id"))
    lines = db.order_items.join(
        db.orders.where(c("status") == "Processing").select(c("id").alias("_oid")), c("order_id") == c("_oid"))
    exp = BOM.expand_lines(lines, closure)
    agg = exp.groupBy("order_id", "component_sku_id").agg(F.sum("required_qty").cast("long").alias("required_qty"))
    return (agg.join(db.product_skus.alias("s"), c("component_sku_id") == c("s.id"))
            .select("order_id", "component_sku_id", "required_qty", c("s.sku").alias("sku"),
                    c("s.name").alias("sku_name"), c("s.is_serialized").alias("is_serialized")))


def fifo_units(db, as_of: str) -> DataFrame:
    """Units pickable by FIFO: serialized, non-bundle request sku, approved for sales, A/B-Ware, < 1 year."""
    r = (_releasable(db, as_of, ["QMSalesApproval"])
         .join(db.product_skus.alias("s"), c("pr.sku_id") == c("s.id"))
         .where(c("s.is_serialized") & ~c("s.is_bundle")))
    return r.select(c("pt.id").alias("product_id"), c("pt.product_id").alias("tracking_id"),
                    c("pr.sku_id").alias("sku_id"), c("ph.print_date").alias("print_date"),
                    c("pt.last_updated_at").alias("last_updated_at"))


def fifo_pick(db, as_of: str, sku_id: int, limit: int) -> DataFrame:
    """The first ``limit`` units of one sku by print date (then unit id)."""
    return fifo_units(db, as_of).where(c("sku_id") == sku_id).orderBy("print_date", "product_id").limit(limit)


def _picking_lines(db) -> DataFrame:
    return unit_requirements(db).where(c("is_serialized") | c("is_bundle"))


def fifo_allocate(db, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Allocate FIFO units to all open order lines that need picking, oldest order first.

    Units are ranked per sku by (print date, id) and lines per sku by
    (order date, order id, line id); a line is short when it gets fewer
    units than it requires.
    """
    return fifo_allocate_op(fifo_units(db, as_of), _picking_lines(db))


def fifo_allocate_op(units: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    return FIFO.fifo_allocate(units, ["print_date", "product_id"], lines, ["order_date", "order_id", "order_item_id"])


def shipment_sku_items(db, as_of: str) -> DataFrame:
    """Per open order, shipped quantity per sku: picked units (bundles: floor(units / pack)),
    plus the ordered quantity of non-serialized skus; positive quantities only."""
    alloc, _ = fifo_allocate(db, as_of)
    picked = alloc.groupBy("order_id", "sku_id").agg(F.count(F.lit(1)).alias("_units"))
    skus = db.product_skus.select(c("id").alias("_sid"), "pack_qty", "is_bundle")
    serial = (picked.join(skus, c("sku_id") == c("_sid"))
              .select("order_id", c("sku_id").alias("product_sku_id"),
                      F.when(c("is_bundle") & (c("pack_qty") > 0), F.floor(c("_units") / c("pack_qty")))
                       .otherwise(c("_units")).cast("long").alias("quantity")))
    non_serial = (unit_requirements(db).where(~c("is_serialized") & ~c("is_bundle"))
                  .select("order_id", c("sku_id").alias("product_sku_id"), c("order_qty").cast("long").alias("quantity")))
    return serial.unionByName(non_serial).where(c("quantity") > 0)


def active_shipments(db) -> DataFrame:
    """Pending or shipped shipments with customer, oldest first."""
    out = (db.shipments.alias("s").where(c("s.status").isin("Pending", "Shipped"))
           .join(db.customers.alias("cu"), c("s.customer_id") == c("cu.id")))
    return out.select(c("s.id").alias("shipment_id"), c("s.status").alias("status"), c("s.order_id").alias("order_id"),
                      c("s.customer_id").alias("customer_id"), c("cu.customer_name").alias("customer_name"),
                      c("s.created_date").alias("created_date"), c("s.ship_date").alias("ship_date"),
                      c("s.delivery_date").alias("delivery_date"), c("s.carrier").alias("carrier"),
                      c("s.tracking_number").alias("tracking_number")).orderBy("created_date")


def shipment_products(db) -> DataFrame:
    """Units in every shipment with sku (via request) and print date."""
    out = (db.shipment_unit_items.alias("si")
           .join(db.product_tracking.alias("pt"), c("si.product_tracking_id") == c("pt.id"))
           .join(db.product_harvest.alias("ph"), c("pt.harvest_id") == c("ph.id"))
           .join(db.product_requests.alias("pr"), c("ph.request_id") == c("pr.id"))
           .join(db.product_skus.alias("s"), c("pr.sku_id") == c("s.id")))
    return out.select(c("si.shipment_id").alias("shipment_id"), c("pt.id").alias("product_id"),
                      c("pt.product_id").alias("tracking_id"), c("s.sku").alias("sku"),
                      c("s.name").alias("sku_name"), c("ph.print_date").alias("print_date"))


def shipment_non_serialized(db, sku_items: DataFrame) -> DataFrame:
    """Sku lines of shipments with sku code and name."""
    out = sku_items.alias("ssi").join(db.product_skus.alias("ps"), c("ps.id") == c("ssi.product_sku_id"))
    return out.select(c("ssi.order_id").alias("order_id"), c("ssi.product_sku_id").alias("sku_id"),
                      c("ps.sku").alias("sku"), c("ps.name").alias("sku_name"), c("ssi.quantity").alias("quantity"))


def open_orders(db) -> DataFrame:
    """Processing order headers with customer, oldest first."""
    out = (db.orders.alias("o").where(c("o.status") == "Processing")
           .join(db.customers.alias("cu"), c("o.customer_id") == c("cu.id")))
    return out.select(c("o.id").alias("order_id"), c("cu.customer_name").alias("customer_name"),
                      c("o.order_date").alias("order_date"), c("o.notes").alias("notes"),
                      c("o.parent_order_id").alias("parent_order_id"), c("o.status").alias("status"),
                      c("o.updated_at").alias("updated_at"), c("o.updated_by").alias("updated_by"),
                      c("o.customer_id").alias("customer_id")).orderBy("order_date")


def skus_with_specs_flag(db) -> DataFrame:
    """Skus with a 0/1 flag for having print specs."""
    out = db.product_skus.alias("ps").join(db.product_print_specs.alias("pps"), c("pps.sku_id") == c("ps.id"), "left")
    return out.select(c("ps.id").alias("id"), c("ps.sku").alias("sku"), c("ps.name").alias("name"),
                      c("ps.is_active").alias("is_active"),
                      F.when(c("pps.sku_id").isNull(), 0).otherwise(1).alias("has_print_specs")).orderBy("name", "sku")


def _order_type_counts(db) -> DataFrame:
    lines = _open_lines(db)
    return lines.groupBy(c("oi.order_id").alias("order_id"), c("s.product_type_id").alias("product_type_id")).agg(
        F.sum("oi.quantity").cast("long").alias("ordered"))


def package_estimate(db) -> DataFrame:
    """Per open order and package sharing a product type with it, packages = max over the
    package's product lines of floor(ordered quantity of that type / per-package quantity)."""
    counts = _order_type_counts(db)
    # few types and packages: a join that shuffles would gather all orders on them
    prod = broadcast_if_small(db.packages.where((c("item_kind") == "product") & (c("quantity") > 0)))
    return (counts.join(prod, counts.product_type_id == prod.item_id)
            .groupBy("order_id", "package_id")
            .agg(F.max(F.floor(c("ordered") / c("quantity"))).cast("long").alias("packages")))


def package_totals(db) -> DataFrame:
    """Per open order, items implied by its package estimate: sum of per-package quantity x packages."""
    est = package_estimate(db).where(c("packages") > 0)
    out = est.join(broadcast_if_small(db.packages), "package_id")
    return (out.groupBy("order_id", "item_kind", "item_id")
            .agg(F.sum(c("quantity") * c("packages")).cast("long").alias("quantity")))
