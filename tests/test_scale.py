"""How the heavy steps are planned, and that the cheap ways give the same values, on the smallest supplied scale."""

import pytest
from pyspark.sql import functions as F

from spooltrace.functions import exprs as X
from spooltrace.operators import merge
from spooltrace.operators.constraints import constraint_report
from spooltrace.plans import etl as E
from spooltrace.plans import materials as M
from spooltrace.plans import sales as H
from spooltrace.plans import transitions as K
from spooltrace.plans import views
from spooltrace.session import written_once
from spooltrace.sources.fixtures import AS_OF, CUTOFF, Tables

from conftest import SF_SMALL


@pytest.fixture()
def db(spark):
    return Tables(spark, SF_SMALL)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_usage_is_ordered_by_more_than_the_few_types(db):
    out = M.material_usage_summary(db)
    sort = _plan(out).splitlines()[0]
    assert sort.startswith("Sort [product_type#") and "usage_id#" in sort
    types = [r[0] for r in out.select("product_type").collect()]
    assert types == sorted(types, key=lambda t: (t is not None, t or ""))


def test_orders_are_not_gathered_on_packages(db):
    joins = [x for x in _plan(H.package_totals(db)).splitlines() if "Join" in x and ("package_id" in x or "item_id" in x)]
    assert len(joins) == 2 and all("strategy=broadcast" in x for x in joins)


def test_line_diff_and_constraints_do_not_derive_the_lines_again(db):
    out = K.apply_order_line_diff(db, K.line_diff_commands(db), 1, AS_OF)
    assert "l_orderkey" not in _plan(out["order_items"])
    assert "l_orderkey" not in _plan(constraint_report(db))


def test_sheet_is_written_once_for_all_steps(spark, db):
    views.v_unified_legacy_prints(db, CUTOFF)
    first = written_once(db, "stg_excel_data")
    assert "event_id" not in _plan(first) and written_once(db, "stg_excel_data") is first
    db.__dict__["stg_excel_data"] = first.limit(1)  # another sheet is written anew
    assert written_once(db, "stg_excel_data").count() == 1


def test_casts_tried_by_shape_equal_plain_casts(spark):
    texts = ["12", " 12 ", "+5", "-7", "\t8\n", "5,123", "1.0", "1.", ".5", "n/a", "", " ", None, "1 2", "--3", "9223372036854775807",
             "9223372036854775808", "1e3", "1e-3", "1d", "NaN", "Infinity", "0x10", "12.03.2024", "12-03-2024", "12/03/2024",
             "2024-01-05", "2024-01-05 10:00:00", "45292", "45292.75", "-45292"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = rows.select("t", X.parse_bigint_strict(F.col("t")).alias("a"), F.col("t").try_cast("bigint").alias("b"),
                      X._try_serial(F.col("t")).alias("c"), F.col("t").try_cast("double").alias("d")).collect()
    for r in got:
        assert r.a == r.b and str(r.c) == str(r.d), r


def test_cells_of_the_sheets_are_parsed_once(db):
    for df in (E._eligible_spools(db, CUTOFF), E.etl_mounting(db, AS_OF)):
        assert "RLIKE" not in _plan(df) and "try_to_timestamp" not in _plan(df)


def test_prints_are_written_by_their_numbering_alone(db, monkeypatch):
    written = []
    monkeypatch.setattr(E, "materialize", lambda df: written.append(df) or df)
    v = E.Versions(db)
    assert v.prints(CUTOFF) is v.prints(CUTOFF) and not written


def test_spools_find_their_receiver_by_collation(spark, db):
    names = ["\u00c9va", "Bo", "Cy", "Cy"]
    users = spark.createDataFrame(
        [(i, x, None, None, None, E.LEGACY_IMPORT_UPN if x == "Bo" else None) for i, x in enumerate(names, 1)],
        "id BIGINT, display_name STRING, department_id BIGINT, is_active BOOLEAN, azure_ad_object_id STRING, "
        "user_principal_name STRING")
    rows = [(str(9_000_000 + i), f"L{i}-1", None, "1,5", "20.01.2024", op, None, None, None)
            for i, op in enumerate([" eva ", "EVA", "cy", None, " ", "nobody"])]
    db.__dict__["stg_filament_excel_data"] = spark.createDataFrame(
        rows, "filament_id STRING, filament STRING, shelf STRING, weight_fl STRING, vsc_date STRING, vsc_operator STRING, "
        "vs_check STRING, printer_fi STRING, usage STRING")
    db.__dict__["users"] = users
    got = E.etl_filaments(db, CUTOFF, AS_OF, users)[0].where("filament_id >= 9000000").select("filament_id", "received_by")
    assert {r[0] - 9_000_000: r[1] for r in got.collect()} == {0: 1, 1: 1, 2: 3, 3: 2, 4: 2, 5: 2}


def test_quality_checks_are_parsed_once_a_row(db, monkeypatch):
    sources = []
    keep = merge.materialize
    monkeypatch.setattr(merge, "materialize", lambda df: sources.append(df) or keep(df))
    E.etl_quality_control(db, db.product_tracking, CUTOFF)
    assert _plan(sources[0]).count(r"\d{1,2}-\d{1,2}-\d{4}") == 1


def test_merge_of_few_matches_does_not_shuffle_the_target(spark):
    target = spark.range(1, 5).selectExpr("id", "CASE WHEN id < 4 THEN id * 10 END AS k", "'old' AS v")
    source = spark.createDataFrame([(10, "new"), (77, "new"), (None, "new"), (55, "new")], "k BIGINT, v STRING")
    merged, actions = merge.merge_upsert(target, source, ["k"], ["v"], id_order=["k"])
    join = next(x for x in _plan(merged).splitlines() if "LeftOuter" in x)
    assert "strategy=broadcast" in join
    got = sorted(map(tuple, merged.select("id", "k", "v").collect()))
    assert got == [(1, 10, "new"), (2, 20, "old"), (3, 30, "old"), (4, None, "old"), (5, None, "new"), (6, 55, "new"), (7, 77, "new")]
    assert sorted(map(str, (r._action for r in actions.collect()))) == ["INSERT"] * 3 + ["UPDATE"]


def test_treatment_sheet_is_filtered_by_its_own_rows(db):
    E.etl_treatment_batches(db, db.product_tracking, CUTOFF)  # written, so that no filter goes below its distinct
    assert "event" not in _plan(db.__dict__["_written_once"]["stg_treatment_excel_data"][1])
