"""Plan-shape checks for the scale properties the design relies on."""

from spooltrace.operators import merge as C
from spooltrace.sources.fixtures import Tables

from conftest import SF_SMALL


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_has_no_full_outer_join(spark):
    db = Tables(spark, SF_SMALL)
    src = db.lids.selectExpr("serial_number", "quantity + 1 AS quantity")
    merged, _ = C.merge_upsert(db.lids, src, ["serial_number"], set_cols=["quantity"], id_col="id")
    plan = _plan(merged)
    assert "FullOuter" not in plan
    assert "LeftOuter" in plan


def test_mounting_runs_on_the_merge_kernel(spark):
    from spooltrace.plans import etl as E
    from spooltrace.sources.fixtures import AS_OF
    assert "FullOuter" not in _plan(E.etl_mounting(Tables(spark, SF_SMALL), AS_OF))


def test_order_components_joins_the_closure_once(spark):
    from spooltrace.plans import sales as H
    plan = _plan(H.order_components(Tables(spark, SF_SMALL)))
    assert plan.count("Exchange hashpartitioning") <= 12  # initial and final plan together; the closure is one written table


def test_mounts_meet_no_sku_by_inequality(spark):
    from spooltrace.plans import materials as M
    plan = _plan(M.request_mount_candidates(Tables(spark, SF_SMALL)))
    # one-row scalars may join without a condition; no row is compared with another table's rows
    assert not any(">=" in x or "<=" in x for x in plan.splitlines() if "NestedLoopJoin" in x)


def test_best_lots_need_no_inequality_join(spark):
    from decimal import Decimal
    from pyspark.sql import functions as F
    from spooltrace.plans import materials as M
    # equal lots: every lot reaches every sku's number
    lots = [(f"L{i:04d}", Decimal("1000.00")) for i in range(300, 0, -1)] + [("A", Decimal("999.99")), (None, Decimal("1000.00"))]
    skus = [(i, Decimal(i) / 4) for i in range(1, 400)] + [(500, Decimal("1000.01")), (501, Decimal("999.99"))]
    out = M._best_lots(spark.createDataFrame(lots, "lot_number string, available_grams decimal(18,2)"),
                       spark.createDataFrame(skus, "sku_id long, unit_weight decimal(18,2)")
                       .withColumn("unit_weight", F.col("unit_weight")))
    got = {r.sku_id: (r.b.lot_number, r.max_units) for r in out.collect()}
    want = {}
    for sku, w in skus:
        best = sorted((-(g // w), n) for n, g in lots if n and g // w >= 1)
        if best:
            want[sku] = (best[0][1], int(-best[0][0]))
    assert got == want
    for query in ("filament_lot_units", "material_feasibility"):
        import __spark_entry__ as entry
        plan = _plan(entry.queries()[query](spark, SF_SMALL))
        assert "CartesianProduct" not in plan
        # what joins without a key is a one-row scalar
        assert not any(">=" in x and "available_grams" in x for x in plan.splitlines() if "Join" in x)


def test_dimensions_in_use_survive_without_static_broadcast(spark):
    from spooltrace.plans import views
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        db = Tables(spark, SF_SMALL)
        assert views.v_product_status(db).count() == db.product_tracking.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
