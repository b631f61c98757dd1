"""Fixed storage and label rules of the modelled plant, as small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Business status -> storage mode -> allowed shelf description keywords.
SHELF_OPTIONS_BY_RESULT = {
    "A-Ware": {"Post-Harvest QC": ["CellScrew; Inventory"], "Post-Treatment QC": ["CellScrew; Sales"]},
    "B-Ware": {"Post-Harvest QC": ["CellScrew; B-Ware"], "Post-Treatment QC": ["CellScrew; Internal Use"]},
    "In Quarantine": {"Post-Harvest QC": ["CellScrew; Quarantine"], "Post-Treatment QC": ["CellScrew; Quarantine"],
                      "AdHoc Quarantine": ["CellScrew; Quarantine"]},
    "Waste": {"Post-Harvest QC": ["Disposed Product"], "Post-Treatment QC": ["Disposed Product"]},
}

# Business status -> storage mode -> next stage code.
NEXT_STAGE_BY_RESULT = {
    "A-Ware": {"Post-Harvest QC": "InInterimStorage", "Post-Treatment QC": "PostTreatmentStorage"},
    "B-Ware": {"Post-Harvest QC": "InInterimStorage", "Post-Treatment QC": "PostTreatmentStorage"},
    "In Quarantine": {"Post-Harvest QC": "Quarantine", "Post-Treatment QC": "Quarantine",
                      "AdHoc Quarantine": "Quarantine"},
    "Waste": {"Post-Harvest QC": "Disposed", "Post-Treatment QC": "Disposed"},
}

# Stage code -> acceptable shelf keywords in the location description.
STAGE_SHELF_RULES = {
    "HarvestQCComplete": ["CellScrew; Inventory", "CellScrew; B-Ware"],
    "InInterimStorage": ["CellScrew; Inventory", "CellScrew; B-Ware"],
    "QMTreatmentApproval": ["CellScrew; Inventory", "CellScrew; B-Ware"],
    "InTreatment": ["Offsite", "Treatment/Partner/Customer"],
    "PostTreatmentQC": ["CellScrew; Sales", "Internal Use", "CellScrew; B-Ware"],
    "PostTreatmentStorage": ["CellScrew; Sales", "Internal Use", "CellScrew; B-Ware"],
    "QMSalesApproval": ["CellScrew; Sales"],
    "PendingShipment": ["CellScrew; Sales"],
    "Shipped": ["Offsite", "Treatment/Partner/Customer"],
    "Quarantine": ["CellScrew; Quarantine"],
    "Disposed": ["Disposed Product", "Waste"],
    "Internal Use": ["Internal Use"],
}


def shelf_option_rows() -> list[tuple[str, str, str, str]]:
    """(business_status, mode, keyword, next_stage_code)."""
    return [(s, m, k, NEXT_STAGE_BY_RESULT[s][m])
            for s, modes in SHELF_OPTIONS_BY_RESULT.items() for m, kws in modes.items() for k in kws]


def stage_rule_rows() -> list[tuple[str, str]]:
    return [(s, k) for s, kws in STAGE_SHELF_RULES.items() for k in kws]


def shelf_options_table(spark: SparkSession, locations: DataFrame) -> DataFrame:
    """(business_status, mode, next_stage_code, location_id, location_name, description): bounded by
    the literal rule list x the locations, which may grow."""
    rules = spark.createDataFrame(shelf_option_rows(), "business_status STRING, mode STRING, keyword STRING, "
                                                       "next_stage_code STRING")
    return (F.broadcast(rules).join(locations, F.col("description").contains(F.col("keyword")))
            .select("business_status", "mode", "next_stage_code", F.col("id").alias("location_id"),
                    "location_name", "description").distinct())


def stage_valid_locations(spark: SparkSession, locations: DataFrame) -> DataFrame:
    """(stage_code, location_id): location description holds a keyword allowed for the stage."""
    rules = spark.createDataFrame(stage_rule_rows(), "stage_code STRING, keyword STRING")
    return (F.broadcast(rules).join(locations, F.col("description").contains(F.col("keyword")))
            .select("stage_code", F.col("id").alias("location_id"), "location_name", "description").distinct())


# Label templates per sku family (label names, allowed skus, QR required, print size mm).
LABEL_FAMILIES = [
    (["CS10K-6K_v1", "CS10K-6K_v2", "CS10K-6K_v3"], ["GEB-CS10KTCS-4", "GEB-CS6KTCS-2", "GEB-CS6KTCS-4"], True, 76),
    (["CSmini_v1", "CSmini_v2"], ["GEB-CSmTCS", "GEB-CSmTC2S", "GEB-CSmTCS-2"], True, 50),
    (["CSmini_v3"], ["GEB-CSmTCS", "GEB-CSmTC2S", "GEB-CSmTCS-2"], False, 76),
    (["Tridock"], ["GEB-CSmTD"], False, 76),
]

# Surface area printed on the label, per sku.
SKU_SURFACE_AREA = [
    ("GEB-CS10KTCS-4", "10197"),
    ("GEB-CS6KTCS-2", "6001"),
    ("GEB-CS6KTCS-4", "6124"),
    ("GEB-CSmTCS", "856"),
    ("GEB-CSmTC2S", "851"),
    ("GEB-CSmTCS-2", "851"),
]


def label_rows() -> list[tuple[str, str, bool, int]]:
    """(sku, label, qr_required, print_size) for every label allowed for a sku."""
    return [(sku, label, qr, size) for labels, skus, qr, size in LABEL_FAMILIES for sku in skus for label in labels]


def label_table(spark: SparkSession) -> DataFrame:
    areas = dict(SKU_SURFACE_AREA)
    rows = [(sku, label, qr, size, areas.get(sku)) for sku, label, qr, size in label_rows()]
    return spark.createDataFrame(rows, "sku STRING, label STRING, qr_required BOOLEAN, print_size INT, surface_area STRING")
