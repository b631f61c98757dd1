"""Small literal dimension tables.

The rows below are the seed data of the modelled plant and are fixed values
that must equal the source system's seeds (ids follow the listed order).
Every table here is bounded by its literal row count, so joins against these
tables may broadcast them without a size check.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (seed rows), in natural order.
# ---------------------------------------------------------------------------

DEPARTMENTS = [
    ("GEN", "General", True),
    ("PROD", "Production", True),
    ("QM", "Quality Management", True),
    ("SALES", "Sales", True),
    ("LOG", "Logistics", True),
]

APPLICATION_AREAS = [
    ("Quality Management", True),
    ("Production", True),
    ("Sales", True),
    ("Logistics", True),
    ("Admin", True),
]

STORAGE_LOCATIONS = [
    ("2253", "Shelf", "Filament; Materials; Inventory Room"),
    ("2255", "Shelf", "Filament; Materials; Inventory Room"),
    ("2254", "Shelf", "Filament; Materials; Inventory Room"),
    ("2256", "Shelf", "Filament; Materials; Inventory Room"),
    ("2257", "Shelf", "Filament; Materials; Inventory Room"),
    ("2258", "Shelf", "Filament; Materials; Inventory Room"),
    ("2259", "Shelf", "Filament; Materials; Inventory Room"),
    ("2260", "Shelf", "Filament; Materials; Inventory Room"),
    ("2273", "Shelf", "CellScrew; Inventory"),
    ("2274", "Shelf", "CellScrew; Inventory"),
    ("2275", "Shelf", "CellScrew; Inventory"),
    ("2277", "Shelf", "CellScrew; Inventory"),
    ("2278", "Shelf", "CellScrew; Inventory"),
    ("2276", "Shelf", "CellScrew; B-Ware"),
    ("2280", "Shelf", "CellScrew; B-Ware"),
    ("2279", "Shelf", "CellScrew; Quarantine"),
    ("K11c-3", "Shelf", "CellScrew; 6K; Sales"),
    ("K11c-4", "Shelf", "CellScrew; 6K; Sales"),
    ("K11c-5", "Shelf", "CellScrew; 10K; Sales"),
    ("K11c-6", "Shelf", "CellScrew; 10K; Sales"),
    ("K11c-7", "Shelf", "CellScrew; mini; Sales"),
    ("K11c-8", "Shelf", "CellScrew; mini; Sales"),
    ("207", "Room", "CellScrew; Internal Use"),
    ("Offsite", "Offsite", "Treatment/Partner/Customer"),
    ("Waste", "Waste", "Disposed Product"),
]

PRINTERS = [
    ("GEB1", "Active", True),
    ("GEB2", "Active", True),
    ("GEB3", "Active", True),
    ("GEB4", "Active", True),
    ("GEB5", "Active", True),
    ("GEB6", "Active", True),
    ("GEB7", "Active", True),
]

PRODUCT_TYPES = [
    ("10K", True),
    ("6K", True),
    ("CS MINI", True),
    ("TriDock", True),
]

# (product type name, sku, name, is_serialized, is_bundle, pack_qty, is_active)
PRODUCT_SKUS = [
    ("10K", "GEB-CS10KTCS-4", "CellScrew 10K", True, False, 1, True),
    ("6K", "GEB-CS6KTCS-2", "CellScrew 6K", True, False, 1, False),
    ("6K", "GEB-CS6KTCS-4", "CellScrew 6K", True, False, 1, True),
    ("CS MINI", "GEB-CSmTCS", "CellScrew Mini", False, True, 3, False),
    ("CS MINI", "GEB-CSmTC2S", "CellScrew Mini", False, True, 3, False),
    ("CS MINI", "GEB-CSmTCS-2", "CellScrew Mini", False, True, 3, True),
    ("TriDock", "GEB-CSmTD", "TriDock", False, False, 1, True),
]

# (sku, height_mm, diameter_mm, average_weight_g, weight_buffer_g)
PRINT_SPECS = [
    ("GEB-CS10KTCS-4", "288.7", "121", "930", "46"),
    ("GEB-CS6KTCS-2", "202.2", "121", "615", "30"),
    ("GEB-CS6KTCS-4", "202.2", "121", "615", "30"),
    ("GEB-CSmTCS", "161.4", "53", "120", "7.50"),
    ("GEB-CSmTC2S", "161.4", "53", "120", "7.50"),
    ("GEB-CSmTCS-2", "161.4", "53", "162", "8"),
]

# (stage_code, stage_name, stage_order, is_active)
LIFECYCLE_STAGES = [
    ("Printed", "Printed, Pending QC", 1, True),
    ("HarvestQCComplete", "Harvest QC Complete; Pending Storage", 2, True),
    ("InInterimStorage", "Stored; Pending QM Approval for Treatment", 3, True),
    ("QMTreatmentApproval", "QM Approved for Treatment; Pending Treatment", 4, True),
    ("InTreatment", "In Treatment / Shipped; Pending Return", 5, True),
    ("PostTreatmentQC", "Returned / Post-Treatment QC; Pending Storage", 6, True),
    ("PostTreatmentStorage", "Stored; Pending QM Approval", 7, True),
    ("QMSalesApproval", "QM Approved For Sales; Pending Sales", 8, True),
    ("Quarantine", "Moved to Quarantine", 99, True),
    ("Disposed", "Discarded Product", 100, True),
    ("PendingShipment", "Marked for Shipment", 110, True),
    ("Shipped", "Shipped to Customer", 120, True),
    ("Internal Use", "Internal Use/Client", 130, True),
    ("Expired", "Overaged - Do Not Use", 999, True),
]

PRODUCT_STATUSES = [
    ("Pending", True),
    ("A-Ware", True),
    ("B-Ware", True),
    ("In Quarantine", True),
    ("Waste", True),
]

# (reason_code, reason_label, category, default_outcome, is_active)
ISSUE_REASONS = [
    ("VIS_COLOR_DIFF", "Color differences", "Visual", "B-Ware", True),
    ("VIS_UNDER_EXT", "Under-extrusion bottom", "Visual", "B-Ware", True),
    ("VIS_BLACK_LINE_W", "Black line with scratch", "Visual", "B-Ware", True),
    ("VIS_BLACK_LINE_WO", "Black line without scratch", "Visual", "B-Ware", True),
    ("VIS_PARTICLES_IN", "Particles in inner area", "Visual", "B-Ware", True),
    ("VIS_GREATER_FIVE", "Greater than five particles", "Visual", "B-Ware", True),
    ("VIS_STRINGING", "Stringing", "Visual", "B-Ware", True),
    ("VIS_CRACKS", "Cracks/Damage outer shell", "Visual", "Waste", True),
    ("VIS_TEARS", "Tears/Damage on surface", "Visual", "Waste", True),
    ("VIS_OFFSET", "Offset", "Visual", "Waste", True),
    ("VIS_GYROID", "Visible gyroid pattern", "Visual", "Waste", True),
    ("VIS_BROKEN_BAG", "Broken bag", "Visual", "B-Ware", True),
    ("VIS_CONTAMINATION", "Contamination visible", "Visual", "Waste", True),
    ("PKG_SEAL_ISSUE", "Packaging seal issue", "Packaging", "B-Ware", True),
    ("LBL_DAMAGED", "Damaged label", "Packaging", "B-Ware", True),
    ("PROC_INCOMPLETE", "Incomplete documentation", "Process", "Quarantine", True),
    ("OTHER_BWARE", "Other - B-Ware (please specify)", "General", "B-Ware", True),
    ("OTHER_QUARANTINE", "Other - Quarantine (please specify)", "General", "Quarantine", True),
    ("OTHER_WASTE", "Other - Waste", "General", "Waste", True),
]

ISSUE_CONTEXTS = ["HarvestQC", "PostTreatmentQC", "Quarantine", "AdHoc"]

# Contexts every seeded reason is linked to.
SEEDED_REASON_CONTEXTS = ["HarvestQC", "PostTreatmentQC", "AdHoc"]

# ---------------------------------------------------------------------------
# Typed tables
# ---------------------------------------------------------------------------

L, S, B, I = T.LongType(), T.StringType(), T.BooleanType(), T.IntegerType()


def _dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


def _rows() -> dict[str, tuple[T.StructType, list[tuple]]]:
    type_id = {name: i + 1 for i, (name, _) in enumerate(PRODUCT_TYPES)}
    sku_id = {r[1]: i + 1 for i, r in enumerate(PRODUCT_SKUS)}
    ctx_id = {c: i + 1 for i, c in enumerate(ISSUE_CONTEXTS)}
    links = []
    for r_id in range(1, len(ISSUE_REASONS) + 1):
        for c in SEEDED_REASON_CONTEXTS:
            links.append((len(links) + 1, r_id, ctx_id[c]))
    return {
        "departments": (
            _schema(("id", L), ("department_code", S), ("department_name", S), ("is_active", B)),
            [(i + 1, *r) for i, r in enumerate(DEPARTMENTS)],
        ),
        "application_areas": (
            _schema(("id", L), ("area_name", S), ("is_active", B)),
            [(i + 1, *r) for i, r in enumerate(APPLICATION_AREAS)],
        ),
        "storage_locations": (
            _schema(("id", L), ("location_name", S), ("location_type", S), ("description", S), ("is_active", B)),
            [(i + 1, *r, True) for i, r in enumerate(STORAGE_LOCATIONS)],
        ),
        "printers": (
            _schema(("id", L), ("name", S), ("status", S), ("is_active", B)),
            [(i + 1, *r) for i, r in enumerate(PRINTERS)],
        ),
        "product_types": (
            _schema(("id", L), ("name", S), ("is_active", B)),
            [(i + 1, *r) for i, r in enumerate(PRODUCT_TYPES)],
        ),
        "product_skus": (
            _schema(("id", L), ("product_type_id", L), ("sku", S), ("name", S), ("is_serialized", B),
                    ("is_bundle", B), ("pack_qty", L), ("is_active", B)),
            [(i + 1, type_id[r[0]], *r[1:]) for i, r in enumerate(PRODUCT_SKUS)],
        ),
        "product_print_specs": (
            _schema(("sku_id", L), ("height_mm", _dec(7, 2)), ("diameter_mm", _dec(7, 2)),
                    ("average_weight_g", _dec(7, 2)), ("weight_buffer_g", _dec(4, 2))),
            [(sku_id[r[0]], *(Decimal(v).quantize(Decimal("0.01")) for v in r[1:])) for r in PRINT_SPECS],
        ),
        "lifecycle_stages": (
            _schema(("id", L), ("stage_code", S), ("stage_name", S), ("stage_order", L), ("is_active", B)),
            [(i + 1, *r) for i, r in enumerate(LIFECYCLE_STAGES)],
        ),
        "product_statuses": (
            _schema(("id", L), ("status_name", S), ("is_active", B)),
            [(i + 1, *r) for i, r in enumerate(PRODUCT_STATUSES)],
        ),
        "issue_reasons": (
            _schema(("id", L), ("reason_code", S), ("reason_label", S), ("category", S), ("default_outcome", S),
                    ("severity", L), ("is_active", B)),
            [(i + 1, r[0], r[1], r[2], r[3], None, r[4]) for i, r in enumerate(ISSUE_REASONS)],
        ),
        "issue_contexts": (
            _schema(("id", L), ("context_code", S)),
            [(i + 1, c) for i, c in enumerate(ISSUE_CONTEXTS)],
        ),
        "issue_reason_contexts": (
            _schema(("id", L), ("reason_id", L), ("context_id", L)),
            links,
        ),
    }


DIM_NAMES = list(_rows().keys())


def dim(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = _rows()[name]
    return spark.createDataFrame(rows, schema)


def dim_size(name: str) -> int:
    return len(_rows()[name][1])


def dim_sql(name: str) -> str:
    """The same literal table as a DuckDB ``SELECT ... FROM (VALUES ...)``."""
    schema, rows = _rows()[name]

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, Decimal)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    def sqltype(t: T.DataType) -> str:
        if isinstance(t, T.LongType):
            return "BIGINT"
        if isinstance(t, T.BooleanType):
            return "BOOLEAN"
        if isinstance(t, T.DecimalType):
            return f"DECIMAL({t.precision},{t.scale})"
        return "VARCHAR"

    names = [f.name for f in schema.fields]
    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {sqltype(f.dataType)}) AS {n}" for n, f in zip(names, schema.fields))
    return f"SELECT {casts} FROM (VALUES {values}) v({', '.join(names)})"
