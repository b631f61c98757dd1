"""Property tests (laws the transforms must keep) on the smallest supplied scale and hand-made cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spooltrace.operators import merge as C
from spooltrace.operators.bom import BomCycleError, bom_closure
from spooltrace.operators.fifo import fifo_allocate
from spooltrace.plans import etl as E
from spooltrace.plans import transitions as K
from spooltrace.sources import seeds as S
from spooltrace.sources.dims import dim
from spooltrace.sources.fixtures import AS_OF, CUTOFF, Tables

from conftest import SF_SMALL


class Overlay:
    """A Tables view with some tables replaced (to re-run a transform on its own output)."""

    def __init__(self, base, **tables):
        self._base, self._tables = base, tables

    def __getattr__(self, name):
        if name in self._tables:
            return self._tables[name]
        return getattr(self._base, name)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def db(spark):
    return Tables(spark, SF_SMALL)


def test_seed_dims_idempotent(spark, db):
    rows = spark.createDataFrame([(None, "NEW-1", "Shelf", "x", True), (None, "2253", "Shelf", "changed", True)],
                                 db.storage_locations.schema)
    once = S.seed_dims(db.storage_locations, rows, "location_name", update_cols=["description"])
    twice = S.seed_dims(once, rows, "location_name", update_cols=["description"])
    assert _rows(once) == _rows(twice)
    assert once.count() == db.storage_locations.count() + 1


def test_seed_skus_and_specs_keep_existing(spark, db):
    rows = spark.createDataFrame([("10K", "GEB-CS10KTCS-4", "CellScrew 10K", True, False, 1, True)],
                                 "product_type_name STRING, sku STRING, name STRING, is_serialized BOOLEAN, "
                                 "is_bundle BOOLEAN, pack_qty BIGINT, is_active BOOLEAN")
    assert _rows(S.seed_skus(db.product_skus, db.product_types, rows)) == _rows(db.product_skus)


def test_seed_reason_contexts_idempotent(spark, db):
    rows = db.issue_reasons.select("reason_code", "reason_label", "category", "default_outcome", "is_active")
    once = S.seed_reason_contexts(db.issue_reasons, db.issue_reason_contexts, db.issue_contexts, rows,
                                  ["HarvestQC", "PostTreatmentQC", "AdHoc"])
    assert once["issue_reason_contexts"].count() == db.issue_reason_contexts.count()
    assert _rows(once["issue_reasons"]) == _rows(db.issue_reasons)


def test_seed_group_rights_idempotent(spark, db):
    rows = S.region_group_rows(db.src("region"))
    once = S.seed_group_rights(db.group_area_rights, db.application_areas, rows, admin_group="NATION_0")
    twice = S.seed_group_rights(once, db.application_areas, rows, admin_group="NATION_0")
    assert _rows(once) == _rows(twice)


def test_merge_count_law_and_idempotence(spark, db):
    src = db.lids.select("serial_number", (F.col("quantity") + 1).alias("quantity")).union(
        spark.createDataFrame([("NEWLID", 5)], "serial_number STRING, quantity BIGINT"))
    target = db.lids
    merged, actions = C.merge_upsert(target, src, ["serial_number"], set_cols=["quantity"], id_col="id",
                                     id_order=["serial_number"])
    counts = {r["action"]: r["n"] for r in C.merge_outcome(actions).collect()}
    assert merged.count() == target.count() + counts.get("INSERT", 0)
    again, actions2 = C.merge_upsert(merged, src, ["serial_number"], set_cols=["quantity"], id_col="id",
                                     id_order=["serial_number"])
    assert _rows(again) == _rows(merged)
    assert "INSERT" not in {r["action"] for r in C.merge_outcome(actions2).collect()}


def test_merge_rejects_duplicate_source_keys(spark, db):
    src = spark.createDataFrame([("A", 1), ("A", 2)], "serial_number STRING, quantity BIGINT")
    with pytest.raises(C.DuplicateSourceKeys):
        C.merge_upsert(db.lids, src, ["serial_number"], set_cols=["quantity"])


def test_etl_filaments_idempotent(spark, db):
    first, _ = E.etl_filaments(db, CUTOFF, AS_OF)
    first = first.checkpoint(eager=True)
    second, _ = E.etl_filaments(Overlay(db, filaments=first), CUTOFF, AS_OF)
    assert _rows(second) == _rows(first)


def test_harvest_maps_are_one_to_one(spark, db):
    _, _, cand = E.etl_harvest(db, CUTOFF)
    m = E.etl_harvest_map(cand)
    assert m.count() == m.select("product_id_bigint").distinct().count() == m.select("harvest_id").distinct().count()
    harvest = E.etl_harvest(db, CUTOFF)[0]
    out = E.etl_harvest_clone(db, harvest, CUTOFF)["etl_harvest_map"]
    assert out.count() == out.select("product_id_bigint").distinct().count() == out.select("harvest_id").distinct().count()


def test_unmapped_products_have_no_harvest_of_their_operator_and_date(spark, db):
    from spooltrace import registry
    harvest = E.etl_harvest(db, CUTOFF)[0]  # with the harvests that E5 adds from the sheet
    left = registry.queries()["etl_harvest_clone_unmapped"](spark, SF_SMALL)
    users = db.users.select(F.col("id").alias("printed_by"), F.col("display_name").alias("operator_trim"))
    met = left.join(users, "operator_trim").join(harvest, "printed_by").where("print_date = print_date_dt")
    assert met.count() == 0


def test_clones_match_the_least_harvest_of_operator_and_date(spark, db):
    users = spark.createDataFrame([(7, "Op A")], "id BIGINT, display_name STRING")
    sheet = spark.createDataFrame([(str(p), "5", "GEB1", "Op A", "2024-02-01", "10K", "Pass") for p in range(1, 41)],
                                  "product_id STRING, filament_id STRING, printer STRING, operator_harvest STRING, "
                                  "date_harvest STRING, product STRING, status_quality_check STRING")
    harvest = spark.range(100, 150).selectExpr(
        "id", "id AS request_id", "id AS lid_id", "id AS seal_id", "id AS filament_mounting_id", "CAST(7 AS BIGINT) AS printed_by",
        "TIMESTAMP_NTZ'2024-02-01 00:00:00' AS print_date")
    out = E.etl_harvest_clone(Overlay(db, users=users, stg_excel_data=sheet), harvest, CUTOFF)
    assert _rows(out["mapped"]) == sorted([(1, 100, "reuse")] + [(p, 148 + p, "clone") for p in range(2, 41)])
    assert out["product_harvest"].where("id >= 150").select("request_id").distinct().collect() == [(100,)]
    # products and harvests of one operator and date are not paired with one another
    plan = out["mapped"]._jdf.queryExecution().optimizedPlan().toString()
    assert "min(id" in plan and "min(harvest_id" not in plan


def test_tracking_after_etl_has_unique_keys(spark, db):
    unified = E.views.v_unified_legacy_prints(db, CUTOFF)
    _, _, cand = E.etl_harvest(db, CUTOFF, unified)
    t, _ = E.etl_tracking(db, CUTOFF, E.etl_harvest_map(cand), AS_OF, unified)
    assert t.count() == t.select("id").distinct().count() == t.select("product_id").distinct().count()


def test_qc_usage_equals_weight_removed(spark, db):
    out = K.apply_qc(db, K.qc_commands(db), AS_OF)
    used = out["material_usage"].agg(F.sum("used_quantity")).first()[0] or Decimal(0)
    before = db.filament_mounting.agg(F.sum("remaining_weight")).first()[0]
    after = out["filament_mounting"].agg(F.sum("remaining_weight")).first()[0]
    assert before - after == used
    assert out["product_status_history"].count() == K.qc_commands(db).count()


def test_stage_change_history_per_command(spark, db):
    cmd = K.stage_commands(db)
    out = K.apply_stage_change(db.product_tracking, cmd, AS_OF)
    assert out["product_status_history"].count() == cmd.count()
    assert out["product_tracking"].count() == db.product_tracking.count()


def test_bom_cycle_raises(spark):
    bom = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "parent_sku_id BIGINT, component_sku_id BIGINT, component_qty BIGINT")
    skus = spark.createDataFrame([(1,), (2,)], "id BIGINT")
    with pytest.raises(BomCycleError):
        bom_closure(bom, skus)


def test_bom_deep_chain_takes_few_rounds(spark, monkeypatch):
    from spooltrace.operators import bom as B
    written = []
    real = B.materialize
    monkeypatch.setattr(B, "materialize", lambda df: written.append(1) or real(df))
    chain = spark.range(1024).selectExpr("id AS parent_sku_id", "id + 1 AS component_sku_id", "1L AS component_qty")
    skus = spark.createDataFrame([(0,), (1000,), (1024,), (5000,)], "id BIGINT")
    got = {(r.root_sku_id, r.component_sku_id): r.qty for r in bom_closure(chain, skus).collect()}
    assert got == {(0, 1024): 1, (1000, 1024): 1, (1024, 1024): 1, (5000, 5000): 1}
    assert len(written) <= 3 + 11
    loop = chain.unionByName(spark.createDataFrame([(1024, 512, 2)], chain.schema))
    with pytest.raises(BomCycleError):
        bom_closure(loop, skus)


def test_bom_quantity_overflow_raises(spark):
    doubling = spark.range(70).selectExpr("id AS parent_sku_id", "id + 1 AS component_sku_id", "2L AS component_qty")
    with pytest.raises(OverflowError):
        bom_closure(doubling, spark.createDataFrame([(0,)], "id BIGINT"))


def test_sample_of_hot_batch_moves_few_rows(spark):
    from spooltrace.operators import sampling
    rows = (spark.range(40_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 4000 END AS batch_id", "id AS product_tracking_id")
            .withColumn("_k", F.md5(F.concat(F.lit("s:"), F.col("product_tracking_id").cast("string")))))
    size = F.least(F.col("n"), F.greatest(F.lit(2), F.bround(F.col("n") * 0.05, 0).cast("long")))
    want = rows.selectExpr("*", "count(*) OVER (PARTITION BY batch_id) AS n",
                           "row_number() OVER (PARTITION BY batch_id ORDER BY _k, product_tracking_id) AS rk").where(F.col("rk") <= size)
    expect = sorted((r.batch_id, r.product_tracking_id) for r in want.collect())
    key = ("batch_id", "_k", "product_tracking_id")
    got = sampling.smallest_share(rows, *key, size, 0.05)
    assert sorted((r.batch_id, r.product_tracking_id) for r in got.collect()) == expect
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    # a bound below every key: the exact way for groups without enough low keys
    assert sorted((r.batch_id, r.product_tracking_id) for r in
                  sampling.smallest_share(rows, *key, size, 0.0000001).collect()) == expect


def test_headers_of_a_cell_table(spark):
    from spooltrace.sources import staging as A
    cells = [("s", 1, 1, "title"), ("s", 2, 1, " "), ("s", 3, 1, " Visual\nCheck "), ("s", 3, 2, "visual-check"), ("s", 3, 3, ""),
             ("s", 3, 4, "Weight  [g]"), ("s", 3, 5, "visual check"), ("s", 4, 1, "x"), ("s", 4, 2, "y"), ("t", 1, 1, "a"), ("t", 1, 2, "a_1"),
             ("t", 1, 3, "A"), ("u", 1, 1, "alone")]
    heads = A.header_cells(spark.createDataFrame(cells, "sheet string, row_no int, position int, value string"))
    assert [(r.sheet, r.position, r.normalized) for r in heads.orderBy("sheet", "position").collect()] == [
        ("s", 1, A.normalize_header(" Visual\nCheck ")), ("s", 2, "visual_check"), ("s", 4, "weight_g"), ("s", 5, "visual_check"),
        ("t", 1, "a"), ("t", 2, "a_1"), ("t", 3, "a")]
    names = A.number_repeats(heads).orderBy("sheet", "position").collect()
    assert [r.final_name for r in names] == ["visual_check", "visual_check_1", "weight_g", "visual_check_2", "a", "a_1", "a_1"]
    assert [r.clash for r in names] == [False] * 5 + [True, True]


def test_bom_multiplies_and_sums_paths(spark):
    bom = spark.createDataFrame([(1, 2, 2), (1, 3, 1), (3, 2, 5)],
                                "parent_sku_id BIGINT, component_sku_id BIGINT, component_qty BIGINT")
    skus = spark.createDataFrame([(1,), (2,), (3,)], "id BIGINT")
    got = {(r.root_sku_id, r.component_sku_id): r.qty for r in bom_closure(bom, skus).collect()}
    assert got == {(1, 2): 7, (2, 2): 1, (3, 2): 5}


def test_fifo_matches_brute_force_with_hot_sku(spark):
    # sku 1 holds most units and most demand (a hot group); ties in dates broken by id
    units = [(i, 1 if i % 5 else 2, i // 3) for i in range(1, 400)]
    lines = [(o, 1 if o % 4 else 2, o // 2, (o * 7) % 13 + 1) for o in range(1, 80)]
    u = spark.createDataFrame(units, "product_id BIGINT, sku_id BIGINT, print_date BIGINT")
    d = spark.createDataFrame(lines, "order_id BIGINT, sku_id BIGINT, order_date BIGINT, required_units BIGINT")
    alloc, res = fifo_allocate(u, ["print_date", "product_id"], d, ["order_date", "order_id"])
    got = {r.product_id: r.order_id for r in alloc.collect()}
    expect = {}
    for sku in (1, 2):
        us = sorted([x for x in units if x[1] == sku], key=lambda x: (x[2], x[0]))
        ls = sorted([x for x in lines if x[1] == sku], key=lambda x: (x[2], x[0]))
        it = iter(us)
        for o, _, _, need in ls:
            for _ in range(need):
                nxt = next(it, None)
                if nxt is None:
                    break
                expect[nxt[0]] = o
    assert got == expect
    short = {r.order_id: r.is_short for r in res.collect()}
    assert sum(short.values()) > 0


def test_bom_has_no_depth_limit(spark):
    chain = [(i, i + 1, 2 if i < 3 else 1) for i in range(1, 41)]
    bom = spark.createDataFrame(chain, "parent_sku_id BIGINT, component_sku_id BIGINT, component_qty BIGINT")
    closure = bom_closure(bom, spark.createDataFrame([(1,)], "id BIGINT"))
    assert [tuple(r) for r in closure.collect()] == [(1, 41, 4)]


def test_codes_stay_unique_past_four_digits(spark):
    from spooltrace.functions import exprs as X
    from spooltrace.operators.merge import next_seq_for_lot
    lots = spark.createDataFrame([("0012",), ("00121",), ("0013",)], "lot_number STRING")
    codes = spark.range(1, 10_002).selectExpr("'0012' lot_number", "id seq").withColumn(
        "product_code", X.product_code(F.col("lot_number"), F.col("seq")))
    assert codes.select("product_code").distinct().count() == 10_001
    codes = codes.unionByName(spark.createDataFrame([("00121", "001210007"), ("0013", "odd")], "lot_number STRING, product_code STRING"),
                              allowMissingColumns=True)
    assert {r.lot_number: r.next_seq for r in next_seq_for_lot(codes, lots).collect()} == {"0012": 10_002, "00121": 8, "0013": 1}


def test_inspection_sample_depends_on_seed_and_takes_large_ids(spark):
    from types import SimpleNamespace
    from spooltrace.plans.operations import inspection_sample
    db = SimpleNamespace(treatment_batch_products=spark.range(4_000_000_000, 4_000_000_400).selectExpr("1 batch_id", "id product_tracking_id"))
    picks = [sorted(r.product_tracking_id for r in inspection_sample(db, seed=s).collect()) for s in (1, 2)]
    assert len(picks[0]) == len(picks[1]) == 20
    offsets = [[x - p[0] for x in p] for p in picks]
    assert picks[0] != picks[1] and offsets[0] != offsets[1]
    assert inspection_sample(db, inspect_all=True).count() == 400


def test_unchanged_content_is_not_staged_again(spark, tmp_path):
    from spooltrace.sources.staging import content_digest, load_if_changed
    df = spark.createDataFrame([("a", None), ("b", "")], "x STRING, y STRING")
    path = str(tmp_path / "stage")
    first = load_if_changed(df, path, None)
    assert first is not None and spark.read.parquet(path).count() == 2
    assert load_if_changed(df.orderBy(F.desc("x")), path, first) is None
    changed = spark.createDataFrame([("a", ""), ("b", "")], "x STRING, y STRING")
    assert load_if_changed(changed, path, content_digest(df)) is not None


def test_cluster_session_needs_a_checkpoint_folder():
    from types import SimpleNamespace
    from spooltrace.session import ensure_checkpoint_dir
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"),
                           conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(fake)


def test_serials_beyond_the_calendar_are_reported(spark):
    from spooltrace.functions import exprs as X
    df = spark.createDataFrame([("44000",), ("2958465",), ("2958466",), ("x",), (None,)], "v STRING")
    got = df.select(X.excel_serial("v").isNull().alias("n"), X.serial_out_of_range("v").alias("o")).collect()
    assert [(r.n, r.o) for r in got] == [(False, False), (False, False), (True, True), (True, False), (True, False)]
