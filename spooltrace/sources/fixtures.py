"""Domain tables derived from the supplied synthetic Parquet tables.

Every derived column is integer/text/date arithmetic on source keys and
dates, so the same tables can be rebuilt independently in DuckDB for the
oracle check. These builders only shape rows into the domain schema; none
of them does an operator's work. Large sources (orders, lineitem, events,
part) stay distributed: each table is a projection/filter of one source,
and the only fixture joins are key-equality joins between facts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spooltrace.session import BROADCAST_ROWS
from spooltrace.sources.dims import DIM_NAMES, dim, dim_size

SOURCE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed evaluation instants for the supplied data (see FIXTURES.md).
AS_OF = "2000-06-30 00:00:00"
CUTOFF = "2024-01-10"


def ts_plus_days(base: str, days: str) -> str:
    """SQL text: timestamp ``base`` plus ``days`` whole days."""
    return f"timestampadd(DAY, CAST({days} AS INT), {base})"


def ntz(text: str) -> str:
    return f"TIMESTAMP_NTZ'{text}'"


class Tables:
    """Lazily derived domain tables for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    # -- sources -----------------------------------------------------------
    def src(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- literal dims --------------------------------------------------------
    def __getattr__(self, name: str) -> DataFrame:
        if name in DIM_NAMES:
            df = dim(self.spark, name)
            if dim_size(name) <= BROADCAST_ROWS:  # a seed list may grow: its size is known
                df = F.broadcast(df)
            self.__dict__[name] = df
            return df
        raise AttributeError(name)

    # -- derived tables ----------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        return self.src("supplier").selectExpr(
            "CAST(s_suppkey + 1 AS BIGINT) AS id",
            "'Op ' || lpad(CAST(s_suppkey AS STRING), 4, '0') AS display_name",
            "CAST(1 + s_suppkey % 5 AS BIGINT) AS department_id",
            "s_suppkey % 9 <> 0 AS is_active",
            "CAST(NULL AS STRING) AS azure_ad_object_id",
            "CAST(NULL AS STRING) AS user_principal_name",
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.src("customer").selectExpr("CAST(c_custkey + 1 AS BIGINT) AS id", "c_name AS customer_name")

    @cached_property
    def filaments(self) -> DataFrame:
        return self.src("part").selectExpr(
            "CAST(p_partkey + 1 AS BIGINT) AS id",
            "CAST(5000 + p_partkey AS BIGINT) AS filament_id",
            "'L' || CAST(p_partkey div 4 AS STRING) || '-' || CAST(p_partkey AS STRING) AS serial_number",
            "'L' || CAST(p_partkey div 4 AS STRING) AS lot_number",
            "CAST(1 + p_partkey % 25 AS BIGINT) AS location_id",
            "CAST(100 + (p_partkey * 37) % 4900 AS DECIMAL(10,2)) AS weight_grams",
            f"{ts_plus_days(ntz('1999-01-01 00:00:00'), 'p_partkey % 500')} AS received_at",
            "CAST(1 + p_partkey % 10 AS BIGINT) AS received_by",
            "CASE WHEN p_partkey % 13 = 0 THEN 'FAIL' ELSE 'PASS' END AS qc_result",
        )

    @cached_property
    def filament_mounting(self) -> DataFrame:
        unm = "(p_partkey % 3 = 0 OR p_partkey % 7 = 6)"
        return self.src("part").where("p_partkey % 5 <> 4").selectExpr(
            "CAST(p_partkey + 1 AS BIGINT) AS id",
            "CAST(p_partkey + 1 AS BIGINT) AS filament_tracking_id",
            "CAST(1 + p_partkey % 7 AS BIGINT) AS printer_id",
            "CAST(1 + p_partkey % 10 AS BIGINT) AS mounted_by",
            f"{ts_plus_days(ntz('1999-02-01 00:00:00'), 'p_partkey % 500')} AS mounted_at",
            f"CASE WHEN {unm} THEN {ts_plus_days(ntz('1999-03-01 00:00:00'), 'p_partkey % 500')} END AS unmounted_at",
            f"CASE WHEN {unm} THEN CAST(1 + p_partkey % 9 AS BIGINT) END AS unmounted_by",
            "CAST((p_partkey * 53) % 3500 AS DECIMAL(10,2)) AS remaining_weight",
            f"CASE WHEN {unm} THEN 'Unmounted' ELSE 'In Use' END AS status",
        )

    @cached_property
    def filament_acclimatization(self) -> DataFrame:
        return self.src("part").where("p_partkey % 5 = 4 AND p_partkey % 4 <> 0").selectExpr(
            "CAST(p_partkey + 1 AS BIGINT) AS id",
            "CAST(p_partkey + 1 AS BIGINT) AS filament_tracking_id",
            "CAST(1 + p_partkey % 10 AS BIGINT) AS moved_by",
            f"{ts_plus_days(ntz('2000-06-01 00:00:00'), 'p_partkey % 40')} AS moved_at",
            f"{ts_plus_days(ntz('2000-06-03 00:00:00'), 'p_partkey % 40')} AS ready_at",
            "CASE WHEN p_partkey % 10 = 9 THEN 'Complete' ELSE 'Acclimatizing' END AS status",
        )

    @cached_property
    def lids(self) -> DataFrame:
        return self.src("supplier").selectExpr(
            "CAST(s_suppkey + 1 AS BIGINT) AS id",
            "CASE WHEN s_suppkey = 0 THEN 'LEGACY_LID' ELSE 'LID' || CAST(s_suppkey AS STRING) END AS serial_number",
            "CAST(500 + (s_suppkey * 7) % 300 AS BIGINT) AS quantity",
            "CAST(1 + s_suppkey % 25 AS BIGINT) AS location_id",
            f"{ts_plus_days(ntz('1999-01-01 00:00:00'), 's_suppkey % 300')} AS received_at",
            "CAST(1 + s_suppkey % 10 AS BIGINT) AS received_by",
            "CASE WHEN s_suppkey % 6 = 5 THEN 'FAIL' ELSE 'PASS' END AS qc_result",
        )

    @cached_property
    def seals(self) -> DataFrame:
        return self.lids.selectExpr(
            "id",
            "CASE WHEN id = 1 THEN 'LEGACY_SEAL' ELSE 'SEAL' || CAST(id AS STRING) END AS serial_number",
            "quantity + 11 AS quantity", "location_id", "received_at", "received_by", "qc_result",
        )

    @cached_property
    def product_requests(self) -> DataFrame:
        return self.src("orders").selectExpr(
            "CAST(o_orderkey + 1 AS BIGINT) AS id",
            "CAST(1 + o_custkey % 10 AS BIGINT) AS requested_by",
            "CAST(1 + o_custkey % 7 AS BIGINT) AS sku_id",
            "CASE WHEN o_orderkey % 17 = 0 THEN 'LEGACY_LOT' "
            "ELSE '00' || lpad(CAST(o_orderkey % 97 AS STRING), 2, '0') END AS lot_number",
            "CASE WHEN o_orderkey % 5 = 0 THEN 'Pending' WHEN o_orderkey % 5 = 1 THEN 'Cancelled' "
            "ELSE 'Fulfilled' END AS status",
            "o_orderdate AS requested_at",
            "CAST(NULL AS STRING) AS notes",
            "o_orderkey % 19 = 0 AS is_tech_transfer",
        )

    @cached_property
    def product_harvest(self) -> DataFrame:
        return self.src("orders").where("o_orderkey % 5 >= 2").selectExpr(
            "CAST(o_orderkey + 1 AS BIGINT) AS id",
            "CAST(o_orderkey + 1 AS BIGINT) AS request_id",
            "CAST(1 + o_orderkey % 10 AS BIGINT) AS lid_id",
            "CAST(1 + o_orderkey % 9 AS BIGINT) AS seal_id",
            "CAST(1 + 5 * (o_orderkey % 40) AS BIGINT) AS filament_mounting_id",
            "CAST(1 + o_orderkey % 10 AS BIGINT) AS printed_by",
            "o_orderdate AS print_date",
        )

    def _tracking_with_cust(self) -> DataFrame:
        return self.src("orders").where("o_orderkey % 5 >= 2").selectExpr(
            "CAST(o_orderkey + 1 AS BIGINT) AS id",
            "CAST(o_orderkey + 1 AS BIGINT) AS harvest_id",
            "CAST(1000000 + o_orderkey AS BIGINT) AS product_id",
            "CAST(CASE 1 + o_custkey % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 7 THEN 4 ELSE 3 END AS BIGINT)"
            " AS product_type_id",
            "CAST(1 + o_custkey % 7 AS BIGINT) AS sku_id",
            "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(1 + (o_orderkey div 3) % 5 AS BIGINT) END"
            " AS current_status_id",
            "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(1 + (o_orderkey div 2) % 14 AS BIGINT) END"
            " AS previous_stage_id",
            "CAST(1 + (o_orderkey div 5) % 14 AS BIGINT) AS current_stage_id",
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 25 AS BIGINT) END AS location_id",
            f"{ts_plus_days('o_orderdate', 'o_orderkey % 40')} AS last_updated_at",
            "CAST(NULL AS STRING) AS product_code",
            "o_orderkey % 19 = 0 AS was_tech_transfer",
            "o_custkey AS _custkey",
        )

    @cached_property
    def product_tracking(self) -> DataFrame:
        return self._tracking_with_cust().drop("_custkey")

    @cached_property
    def product_quality_control(self) -> DataFrame:
        return self.product_tracking.where("id % 6 <> 0").selectExpr(
            "id", "id AS product_tracking_id",
            "CAST(1 + id % 10 AS BIGINT) AS inspected_by",
            "last_updated_at AS inspected_at",
            "CAST(500 + (id * 31) % 600 AS DECIMAL(6,2)) AS weight_grams",
            "CAST((id * 13) % 9 AS DECIMAL(6,3)) AS pressure_drop",
            "id % 8 <> 0 AS visual_pass",
            "CASE id % 7 WHEN 0 THEN 'Waste' WHEN 1 THEN 'B-Ware' WHEN 2 THEN 'Quarantine' ELSE 'Passed' END"
            " AS inspection_result",
            "CAST(NULL AS STRING) AS notes",
        )

    @cached_property
    def material_usage(self) -> DataFrame:
        li = self.src("lineitem")
        t = self.product_tracking.select("id", "harvest_id")
        return li.join(t, t.id == li.l_orderkey + 1).selectExpr(
            "CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS id",
            "id AS product_tracking_id",
            "harvest_id",
            "CASE l_linenumber % 3 WHEN 0 THEN 'Filament' WHEN 1 THEN 'Lid' ELSE 'Seal' END AS material_type",
            "CASE l_linenumber % 3 WHEN 0 THEN 'L' || CAST(l_partkey div 4 AS STRING) "
            "WHEN 1 THEN 'LID' || CAST(l_suppkey AS STRING) ELSE 'SEAL' || CAST(l_suppkey + 1 AS STRING) END"
            " AS lot_number",
            "CAST(l_quantity AS DECIMAL(10,2)) AS used_quantity",
            "l_shipdate AS used_at",
            "CAST(1 + l_suppkey % 10 AS BIGINT) AS used_by",
            "CAST(NULL AS STRING) AS reason",
        )

    @cached_property
    def treatment_batches(self) -> DataFrame:
        return self.src("customer").where("c_custkey % 10 = 0").selectExpr(
            "CAST(c_custkey + 1 AS BIGINT) AS id",
            "CAST(1 + c_custkey % 10 AS BIGINT) AS sent_by",
            f"{ts_plus_days(ntz('1999-06-01 00:00:00'), 'c_custkey % 365')} AS sent_at",
            "CAST(NULL AS TIMESTAMP_NTZ) AS received_at",
            "CAST(NULL AS STRING) AS notes",
            "CASE WHEN c_custkey % 3 = 0 THEN 'Shipped' ELSE 'Inspected' END AS status",
        )

    @cached_property
    def treatment_batch_products(self) -> DataFrame:
        t = self._tracking_with_cust().where("id % 3 = 0").selectExpr(
            "id", "CAST(_custkey + 1 - _custkey % 10 AS BIGINT) AS _batch")
        b = self.treatment_batches.select(F.col("id").alias("batch_id"))
        return t.join(b, t._batch == b.batch_id).selectExpr(
            "id", "batch_id", "id AS product_tracking_id",
            "id % 4 <> 0 AS surface_treat", "id % 5 <> 0 AS sterilize",
        )

    @cached_property
    def post_treatment_inspections(self) -> DataFrame:
        p = self.treatment_batch_products
        b = self.treatment_batches.where("status = 'Inspected'").selectExpr("id AS _bid", "sent_at")
        return p.join(b, p.batch_id == b._bid).selectExpr(
            "id", "product_tracking_id",
            "CAST(1 + id % 10 AS BIGINT) AS inspected_by",
            f"{ts_plus_days('sent_at', '30')} AS inspected_at",
            "id % 6 <> 3 AS visual_pass",
            "surface_treat AS surface_treated",
            "sterilize AS sterilized",
            "CASE id % 9 WHEN 0 THEN 'Waste' WHEN 3 THEN 'B-Ware' ELSE 'Passed' END AS qc_result",
            "CAST(NULL AS STRING) AS notes",
        )

    @cached_property
    def quarantined_products(self) -> DataFrame:
        return self.product_tracking.where("(id div 2) % 8 = 0").selectExpr(
            "id", "id AS product_tracking_id", "current_stage_id AS from_stage_id",
            "CASE id % 3 WHEN 0 THEN 'Harvest QC' WHEN 1 THEN 'Post-Treatment QC' ELSE 'Ad-Hoc' END AS source",
            "CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(16 AS BIGINT) END AS location_id",
            "last_updated_at AS quarantine_date",
            "CAST(1 + id % 10 AS BIGINT) AS quarantined_by",
            "CAST(NULL AS STRING) AS quarantine_reason",
            "CASE (id div 8) % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Released' ELSE 'Disposed' END"
            " AS quarantine_status",
            "CAST(NULL AS STRING) AS result",
            "CAST(NULL AS TIMESTAMP_NTZ) AS resolved_at",
            "CAST(NULL AS BIGINT) AS resolved_by",
        )

    @cached_property
    def product_investigations(self) -> DataFrame:
        return self.quarantined_products.where("id % 5 = 0").selectExpr(
            "id", "product_tracking_id",
            "CASE WHEN id % 2 = 0 THEN 'Under Investigation' ELSE 'Cleared B-Ware' END AS status",
            "'DEV-' || CAST(id AS STRING) AS deviation_number",
            "CAST(NULL AS STRING) AS comment",
            "CAST(1 + id % 10 AS BIGINT) AS created_by",
            "quarantine_date AS created_at",
            "CAST(NULL AS TIMESTAMP_NTZ) AS resolved_at",
            "CAST(NULL AS BIGINT) AS resolved_by",
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self.src("orders").selectExpr(
            "CAST(o_orderkey + 1 AS BIGINT) AS id",
            "CASE WHEN o_orderkey % 10 = 3 THEN CAST(o_orderkey div 2 + 1 AS BIGINT) END AS parent_order_id",
            "CAST(o_custkey + 1 AS BIGINT) AS customer_id",
            "o_orderdate AS order_date",
            "CAST(1 + o_custkey % 10 AS BIGINT) AS order_creator_id",
            "CASE o_orderstatus WHEN 'O' THEN 'Processing' WHEN 'P' THEN 'Canceled' ELSE 'Completed' END AS status",
            "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
            "CAST(NULL AS BIGINT) AS updated_by",
            "CAST(NULL AS STRING) AS notes",
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return (
            self.src("lineitem")
            .groupBy("l_orderkey", F.expr("l_partkey % 7").alias("_sku"))
            .agg(
                F.min(F.expr("CAST(l_orderkey * 8 + l_linenumber AS BIGINT)")).alias("id"),
                F.sum(F.col("l_quantity").cast("bigint")).cast("bigint").alias("quantity"),
            )
            .selectExpr("id", "CAST(l_orderkey + 1 AS BIGINT) AS order_id",
                        "CAST(1 + _sku AS BIGINT) AS product_sku_id", "quantity")
        )

    @cached_property
    def shipments(self) -> DataFrame:
        return self.orders.where("status = 'Completed'").selectExpr(
            "id", "customer_id", "id AS order_id", "order_creator_id AS creator_id",
            "order_date AS created_date",
            f"CASE WHEN id % 3 <> 0 THEN {ts_plus_days('order_date', '5')} END AS ship_date",
            f"CASE WHEN id % 3 = 2 THEN {ts_plus_days('order_date', '9')} END AS delivery_date",
            "CASE id % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Shipped' ELSE 'Delivered' END AS status",
            "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
            "CAST(NULL AS BIGINT) AS updated_by",
            "CAST(NULL AS STRING) AS tracking_number",
            "CAST(NULL AS STRING) AS carrier",
            "CAST(NULL AS STRING) AS notes",
        )

    @cached_property
    def shipment_unit_items(self) -> DataFrame:
        t = self.product_tracking.where("current_stage_id IN (11, 12)").select("id")
        s = self.shipments.select(F.col("id").alias("shipment_id"))
        return t.join(s, t.id == s.shipment_id).selectExpr("id", "shipment_id", "id AS product_tracking_id")

    @cached_property
    def shipment_sku_items(self) -> DataFrame:
        return self.spark.createDataFrame(
            [], "id BIGINT, shipment_id BIGINT, product_sku_id BIGINT, quantity BIGINT")

    @cached_property
    def sku_bom(self) -> DataFrame:
        # Fixed bill of materials rows (FIXTURES.md).
        return self.spark.createDataFrame(
            [(4, 1, 2), (4, 6, 3), (5, 4, 2), (6, 7, 4)],
            "parent_sku_id BIGINT, component_sku_id BIGINT, component_qty BIGINT")

    @cached_property
    def packages(self) -> DataFrame:
        # Fixed sales catalogue lines: (package, kind, product type or supplement id, quantity per package).
        return self.spark.createDataFrame(
            [(1, "product", 1, 2), (1, "supplement", 1, 1), (2, "product", 2, 3), (2, "product", 3, 1),
             (3, "product", 4, 5), (3, "supplement", 2, 2)],
            "package_id BIGINT, item_kind STRING, item_id BIGINT, quantity BIGINT")

    @cached_property
    def audit_log(self) -> DataFrame:
        return self.src("events").selectExpr(
            "CAST(event_id + 1 AS BIGINT) AS id",
            "CASE event_id % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'filaments' ELSE 'product_tracking' END AS table_name",
            "CAST(1 + user_id AS BIGINT) AS record_id",
            "CASE event_id % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'weight_grams' ELSE 'location_id' END AS field_name",
            "CAST(event_id % 7 AS STRING) AS old_value",
            "CAST(event_id % 5 AS STRING) AS new_value",
            "event_type AS reason",
            "CAST(1 + user_id % 10 AS BIGINT) AS changed_by",
            "ts AS changed_at",
        )

    @cached_property
    def group_area_rights(self) -> DataFrame:
        return (
            self.src("nation").select("*", F.explode(F.array(*[F.lit(a) for a in range(1, 6)])).alias("area_id"))
            .where("(n_nationkey + area_id) % 4 <> 0")
            .selectExpr(
                "CAST(n_nationkey * 5 + area_id AS BIGINT) AS id",
                "n_name AS group_oid",
                "CAST(area_id AS BIGINT) AS area_id",
                "CASE (n_nationkey + area_id) % 3 WHEN 0 THEN 'Read' WHEN 1 THEN 'Write' ELSE 'Admin' END"
                " AS access_level",
            )
        )

    @cached_property
    def stg_excel_data(self) -> DataFrame:
        return self._stg_excel_with_id().drop("_event_id")

    def _stg_excel_with_id(self) -> DataFrame:
        nb, tab = "\u00a0", "\t"
        return self.src("events").selectExpr(
            "event_id AS _event_id",
            "CASE event_id % 20 WHEN 7 THEN 'n/a' WHEN 11 THEN CAST(event_id AS STRING) || '.0' "
            "ELSE CAST(900000 + event_id AS STRING) END AS product_id",
            "CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(5000 + user_id AS STRING) END AS filament_id",
            "' GEB' || CAST(1 + user_id % 7 AS STRING) || ' ' AS printer",
            "' Op ' || lpad(CAST(user_id % 12 AS STRING), 4, '0') AS operator_harvest",
            "date_format(ts, 'yyyy-MM-dd') AS date_harvest",
            "CASE event_id % 4 WHEN 0 THEN '10K' WHEN 1 THEN '6K ' WHEN 2 THEN 'CS MINI' ELSE 'OTHER' END AS product",
            "CASE event_id % 3 WHEN 0 THEN '2273' WHEN 1 THEN ' 2276' ELSE 'nowhere' END AS storage",
            "CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN NULL ELSE 'Pass ' END AS status_quality_check",
            "CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'NO' END AS second_rate_goods",
            "CASE event_id % 6 WHEN 0 THEN 'Sold' WHEN 1 THEN 'Sales' WHEN 2 THEN 'in treatment' "
            "WHEN 3 THEN 'internal' END AS prozess_step",
            "CAST(NULL AS STRING) AS operater_quality_check",
            "CASE event_id % 5 WHEN 0 THEN date_format(ts, 'dd.MM.yyyy') WHEN 1 THEN date_format(ts, 'dd-MM-yyyy') "
            "WHEN 2 THEN date_format(ts, 'MM/dd/yyyy') WHEN 3 THEN CAST(45292 + event_id % 30 AS STRING) "
            "ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS date_of_quality_check",
            "CASE WHEN event_id % 2 = 0 THEN CAST(600 + event_id % 90 AS STRING) || ',5' "
            "ELSE CAST(600 + event_id % 90 AS STRING) END AS weight_check_g",
            "CAST(event_id % 9 AS STRING) || ',25' AS pressure_drop_check_mbar",
            "CASE event_id % 7 WHEN 0 THEN 'FAIL' ELSE 'pass' END AS visual_check",
            "CAST(NULL AS STRING) AS comment",
            f"CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'tr' || '{nb}' || CAST(user_id div 3 AS STRING) || '{tab}' END"
            " AS transfer_id",
            "CAST(NULL AS STRING) AS operator_visual_check_incoming_goods",
            "CASE WHEN event_id % 6 = 5 THEN NULL ELSE date_format(ts, 'dd.MM.yyyy') END"
            " AS date_of_visual_check_incoming_goods",
            "CASE event_id % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN NULL ELSE 'PASS' END AS visual_check_1",
            "CASE event_id % 2 WHEN 0 THEN 'Yes' ELSE 'PASS' END AS surface_treatment",
            "CASE event_id % 3 WHEN 0 THEN 'yes' END AS sterilization",
        )

    # Messy sheet headers of the production log, in column order from column D (c4).
    RAW_HEADERS = ["Product ID", "Filament-ID", "Printer", "Operator\nHarvest", "Date Harvest", "Product", "Storage",
                   "Status Quality Check", "Second rate goods", "Prozess step", "Operater quality check",
                   "Date of quality check", "Weight check [g]", "Pressure drop check [mbar]", "Visual check", "Comment",
                   "Transfer-ID", "Operator visual check incoming goods", "Date of visual check incoming goods",
                   "Visual Check ", "Surface treatment", "Sterilization", None]
    RAW_START_ROW, RAW_START_COL, RAW_WIDTH = 12, 4, 28

    @cached_property
    def raw_production_sheet(self) -> DataFrame:
        """The production log as a raw cell drop (row_no, c1..c28): a title row, the header row at D12
        and one row per staging record below it; this only lays the staging rows out as cells."""
        w, sr, sc = self.RAW_WIDTH, self.RAW_START_ROW, self.RAW_START_COL
        stg = self._stg_excel_with_id()
        data_cols = [x for x in stg.columns if x != "_event_id"]
        cells = {sc + i: F.col(name) for i, name in enumerate(data_cols)}
        body = stg.select(
            (F.lit(sr + 1) + F.col("_event_id")).cast("long").alias("row_no"),
            *[(cells[k] if k in cells else F.lit(None).cast("string")).alias(f"c{k}") for k in range(1, w + 1)])
        head = [None] * w
        for i, h in enumerate(self.RAW_HEADERS):
            head[sc - 1 + i] = h
        title = [None] * w
        title[0] = "Production log"
        schema = "row_no BIGINT, " + ", ".join(f"c{k} STRING" for k in range(1, w + 1))
        top = self.spark.createDataFrame([(1, *title), (sr, *head)], schema)
        return top.unionByName(body)

    @cached_property
    def stg_filament_excel_data(self) -> DataFrame:
        return self.src("part").selectExpr(
            "CASE p_partkey % 4 WHEN 0 THEN '5,' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') "
            "WHEN 1 THEN CAST(5000 + p_partkey AS STRING) || '.0' ELSE CAST(5000 + p_partkey AS STRING) END"
            " AS filament_id",
            "CASE WHEN p_partkey % 29 = 0 THEN ' ' ELSE 'L' || CAST(p_partkey div 4 AS STRING) || "
            "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '-' || CAST(p_partkey AS STRING) END END AS filament",
            "CASE p_partkey % 6 WHEN 0 THEN ' air lock ' WHEN 1 THEN '' WHEN 2 THEN 'NEW' || CAST(p_partkey % 5 AS STRING)"
            " ELSE CAST(2253 + p_partkey % 8 AS STRING) END AS shelf",
            "CAST(100 + p_partkey % 900 AS STRING) || ',75' AS weight_fl",
            f"date_format({ts_plus_days(ntz('2024-01-01 00:00:00'), 'p_partkey % 28')}, 'dd.MM.yyyy') AS vsc_date",
            "upper('Op ' || lpad(CAST(p_partkey % 12 AS STRING), 4, '0')) AS vsc_operator",
            "CASE p_partkey % 5 WHEN 0 THEN 'nein' WHEN 1 THEN ' Ja' WHEN 2 THEN 'OK' WHEN 3 THEN NULL ELSE '??' END"
            " AS vs_check",
            "CASE WHEN p_partkey % 2 = 0 THEN 'GEB' || CAST(1 + p_partkey % 7 AS STRING) END AS printer_fi",
            "CASE p_partkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS usage",
        )

    @cached_property
    def stg_treatment_excel_data(self) -> DataFrame:
        g = self.src("events").select(F.expr("user_id div 3").alias("g")).distinct()
        return g.selectExpr(
            "'TR ' || CAST(g AS STRING) AS treatment_id",
            "CASE g % 5 WHEN 0 THEN 'at geb' WHEN 1 THEN 'AT BBF ' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' ELSE 'lost' END"
            " AS in_treatment",
            "CASE g % 2 WHEN 0 THEN '15.01.2024' ELSE '01/20/2024' END AS run_date",
            "CASE WHEN g % 3 = 0 THEN ' ' ELSE 'Op 0001' END AS operator",
        )
