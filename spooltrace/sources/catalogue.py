"""Catalogue tables derived from the supplied data, laid over the literal seeds.

The seeds are what an empty plant starts with; a plant in use has a catalogue
that grows. ``Catalogue`` adds a sku, its print spec and its parts per row of
``part``, a location and a printer per supplier, and reasons with their
contexts from the event types and regions. Only queries over the catalogue
itself use it; the fixture's units keep to the seeded skus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# new ids start here, beyond every seed
FIRST_ID = 1000

# table -> (source, Spark SQL columns in the seed table's order)
DERIVED = {
    "product_types": ("part", f"""CAST({FIRST_ID} + min(p_partkey) AS BIGINT) AS id, p_type AS name, min(p_size) <= 40 AS is_active""",
                      "p_type"),
    "product_skus": ("part", f"""CAST({FIRST_ID} + p_partkey AS BIGINT) AS id, CAST(1 + p_size % 4 AS BIGINT) AS product_type_id,
        concat('P', CAST(p_partkey AS STRING)) AS sku, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name,
        p_partkey % 2 = 0 AS is_serialized, p_partkey % 10 = 0 AS is_bundle, CAST(1 + p_size % 5 AS BIGINT) AS pack_qty,
        p_retailprice < 1000 AS is_active""", None),
    "product_print_specs": ("part", f"""CAST({FIRST_ID} + p_partkey AS BIGINT) AS sku_id, CAST(p_size AS DECIMAL(7,2)) AS height_mm,
        CAST(2 * p_size AS DECIMAL(7,2)) AS diameter_mm, CAST(10 * p_size AS DECIMAL(7,2)) AS average_weight_g,
        CAST(5 AS DECIMAL(4,2)) AS weight_buffer_g""", None),
    "storage_locations": ("supplier", f"""CAST({FIRST_ID} + s_suppkey AS BIGINT) AS id, s_name AS location_name, 'Partner' AS location_type,
        concat('Nation ', CAST(s_nationkey AS STRING)) AS description, s_acctbal > 0 AS is_active""", None),
    "printers": ("supplier", f"""CAST({FIRST_ID} + s_suppkey AS BIGINT) AS id, concat('Printer of ', s_name) AS name, 'Idle' AS status,
        s_acctbal > 0 AS is_active""", None),
    "issue_reasons": ("events", f"""CAST({FIRST_ID} + min(event_id) AS BIGINT) AS id, concat('EVENT_', upper(event_type)) AS reason_code,
        event_type AS reason_label, 'Events' AS category, CASE WHEN min(event_id) % 2 = 0 THEN 'B-Ware' END AS default_outcome,
        CAST(count(*) AS BIGINT) AS severity, true AS is_active""", "event_type"),
    "issue_contexts": ("region", f"CAST({FIRST_ID} + r_regionkey AS BIGINT) AS id, r_name AS context_code", None),
    "issue_reason_contexts": ("events", f"""CAST({FIRST_ID} + min(event_id) AS BIGINT) AS id, CAST({FIRST_ID} + min(event_id) AS BIGINT)
        AS reason_id, CAST({FIRST_ID} + min(event_id) % 5 AS BIGINT) AS context_id""", "event_type"),
    # every tenth part is a kit of the next; every hundredth also holds two of the kit ten parts on
    "sku_bom": ("part", f"""CAST({FIRST_ID} + p_partkey AS BIGINT) AS parent_sku_id,
        CAST({FIRST_ID} + p_partkey + 1 AS BIGINT) AS component_sku_id, CAST(1 + p_size % 3 AS BIGINT) AS component_qty""",
                "WHERE p_partkey % 10 = 0"),
}


class Catalogue:
    """A ``Tables`` view whose catalogue tables hold the seeds and the derived rows."""

    def __init__(self, db):
        self._db = db

    def __getattr__(self, name: str) -> DataFrame:
        base = getattr(self._db, name)
        if name not in DERIVED:
            return base
        source, columns, group = DERIVED[name]
        rows = self._db.src(source)
        if group and group.startswith("WHERE "):
            rows, group = rows.where(group[len("WHERE "):]), None
        rows.createOrReplaceTempView(view := f"catalogue_{name}")
        derived = self._db.spark.sql(f"SELECT {columns} FROM {view}" + (f" GROUP BY {group}" if group else ""))
        if name == "sku_bom":
            again = rows.where("p_partkey % 100 = 0").selectExpr(
                f"CAST({FIRST_ID} + p_partkey AS BIGINT) AS parent_sku_id",
                f"CAST({FIRST_ID} + p_partkey + 10 AS BIGINT) AS component_sku_id", "CAST(2 AS BIGINT) AS component_qty")
            derived = derived.unionByName(again)
        return base.unionByName(derived)
