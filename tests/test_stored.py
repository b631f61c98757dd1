"""Merges that rewrite only touched buckets, and reruns that skip unchanged steps."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from spooltrace.operators import merge as C
from spooltrace.operators.outputs import Outputs, once
from spooltrace.operators.stored import StoredTable
from spooltrace.plans import etl as E
from spooltrace.plans import etl_rerun
from spooltrace.plans import transitions as K
from spooltrace.session import ensure_checkpoint_dir
from spooltrace.sources.fixtures import AS_OF, CUTOFF, Tables

from conftest import SF_SMALL


def folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


def files(path):
    out = {}
    for d, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                out[f"{d}/{n}"] = os.stat(f"{d}/{n}").st_mtime_ns
    return out


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def db(spark):
    return Tables(spark, SF_SMALL)


def test_merge_rewrites_only_touched_buckets(spark, db):
    target = db.product_tracking
    path = folder(spark, "tracking")
    table = StoredTable.create(target, path, ["product_id"], 32)
    assert rows(table.read()) == rows(target)
    # two known units change, one is new
    source = target.where("id IN (3, 9)").unionByName(
        target.where("id = 3").withColumn("product_id", F.lit(77_000_001).cast("long"))).select(
        "product_id", F.lit(7).cast("long").alias("current_stage_id"), "harvest_id", "sku_id")
    want, actions = C.merge_upsert(target, source, ["product_id"], ["current_stage_id"])
    touched = table.touched(source)
    before = files(path)
    got = table.merge(source, ["current_stage_id"])
    assert rows(table.read()) == rows(want)
    assert rows(got) == rows(actions)
    after = files(path)
    inside = {f"{path}/bucket={b}/" for b in touched}
    kept = {f: t for f, t in before.items() if not any(f.startswith(x) for x in inside)}
    assert len(touched) <= 3 < 20 < len(kept)
    assert all(after.get(f) == t for f, t in kept.items())
    assert not set(before) - set(kept) & set(after)  # the touched ones were replaced


def test_merge_without_effect_writes_nothing(spark, db):
    path = folder(spark, "lids")
    table = StoredTable.create(db.lids, path, ["serial_number"], 8)
    before = files(path)
    same = db.lids.select("serial_number", "quantity")
    table.merge(same, ["quantity"], update_when=F.col("t_quantity") != F.col("s_quantity"))
    assert files(path) == before
    new = table.insert(db.lids.limit(3).unionByName(db.lids.limit(1).withColumn("serial_number", F.lit("fresh"))))
    assert new.count() == 1 and new.first().id == C.next_id(db.lids)
    after = files(path)
    assert {f: t for f, t in after.items() if f in before} == before and len(after) == len(before) + 1
    with pytest.raises(C.DuplicateSourceKeys):
        table.merge(same.unionByName(same), ["quantity"])
    assert table.merge(same.limit(0), ["quantity"]).count() == 0


class Changed:
    """The tables with some replaced."""

    def __init__(self, db, **tables):
        self.__dict__.update(tables)
        self._db = db

    def __getattr__(self, name):
        return getattr(self._db, name)


def test_rerun_skips_unchanged_steps(spark, db):
    path = folder(spark, "rerun")
    first, ran = etl_rerun.run_changed(db, path, CUTOFF, AS_OF)
    assert ran == list(E.PIPELINE_STEPS)
    whole = E.etl_pipeline(db, CUTOFF, AS_OF)
    assert set(first) == set(whole)
    for name in ("product_tracking", "filaments", "treatment_batches", "product_quality_control"):
        assert rows(first[name]) == rows(whole[name])
    written = files(path)
    second, ran = etl_rerun.run_changed(db, path, CUTOFF, AS_OF)
    assert ran == [] and files(path) == written
    assert rows(second["product_tracking"]) == rows(first["product_tracking"])
    # another order of the same rows is the same content
    shuffled = Changed(db, stg_treatment_excel_data=db.stg_treatment_excel_data.orderBy(F.rand(3)))
    assert etl_rerun.run_changed(shuffled, path, CUTOFF, AS_OF)[1] == []
    fewer = db.stg_treatment_excel_data.where("treatment_id IS NOT NULL").where(
        F.col("treatment_id") != db.stg_treatment_excel_data.agg(F.max("treatment_id")).first()[0])
    third, ran = etl_rerun.run_changed(Changed(db, stg_treatment_excel_data=fewer), path, CUTOFF, AS_OF)
    assert "treatment_batch" in ran and "filaments" not in ran and "product_tracking" not in ran
    assert {f: t for f, t in files(path).items() if f in written and "/ledger/" not in f} == {
        f: t for f, t in written.items() if "/ledger/" not in f}
    again = E.etl_pipeline(Changed(db, stg_treatment_excel_data=fewer), CUTOFF, AS_OF)
    assert rows(third["treatment_batches"]) == rows(again["treatment_batches"])


def test_unknown_steps_are_an_error(db):
    with pytest.raises(ValueError):
        E.etl_pipeline(db, CUTOFF, AS_OF, until="filament")
    with pytest.raises(ValueError):
        E.etl_pipeline(db, CUTOFF, AS_OF, only={"spools"})


def test_outputs_are_made_when_read(spark):
    made = []

    def make(name):
        def run():
            made.append(name)
            return spark.range(1)
        return run
    shared = once(make("shared"))
    out = Outputs(a=lambda: shared(), b=make("b")) | Outputs(c=lambda: shared())
    assert made == [] and set(out) == {"a", "b", "c"}
    out["a"], out["c"], out["a"]
    assert made == ["shared"]


def test_one_output_writes_only_what_it_needs(spark, db, monkeypatch):
    from spooltrace.operators import merge, ranking
    numbered = []
    real = ranking.row_number_global
    monkeypatch.setattr(merge, "row_number_global", lambda df, *a, **k: numbered.append(df.columns) or real(df, *a, **k))
    out = K.apply_shipment(db, AS_OF)
    assert numbered == []
    out["audit_log"]
    assert len(numbered) == 1 and "field_name" in numbered[0]  # neither shipments nor units nor history
    K.apply_qc(db, K.qc_commands(db), AS_OF)["filament_mounting"]
    assert len(numbered) == 1  # the weights need no inspection to be numbered


def test_commands_apply_in_order(spark):
    tracking = spark.createDataFrame(
        [(i, 1, 10, None, 5, None) for i in range(1, 4)],
        "id long, harvest_id long, current_stage_id long, previous_stage_id long, location_id long, last_updated_at timestamp_ntz")
    steps = [(1, 2, 11, "a", 1, 7), (1, 1, 12, "b", 1, 8), (1, 9, 13, "c", 2, None), (2, 1, 14, "d", 3, None)]
    cmd = spark.createDataFrame(steps, "product_tracking_id long, seq int, new_stage_id long, reason string, user_id long, location_id long")
    out = K.apply_stage_change(tracking, cmd, AS_OF)
    got = {r.id: (r.previous_stage_id, r.current_stage_id, r.location_id) for r in out["product_tracking"].collect()}
    assert got == {1: (11, 13, 7), 2: (10, 14, 5), 3: (None, 10, 5)}
    hist = [(r.product_tracking_id, r.from_stage_id, r.to_stage_id, r.reason) for r in out["product_status_history"].orderBy("id").collect()]
    assert hist == [(1, 10, 12, "b"), (1, 12, 11, "a"), (1, 11, 13, "c"), (2, 10, 14, "d")]
    with pytest.raises(C.DuplicateSourceKeys):
        K.apply_stage_change(tracking, cmd.unionByName(cmd), AS_OF)
    with pytest.raises(C.DuplicateSourceKeys):
        K.apply_stage_change(tracking, cmd.drop("seq"), AS_OF)
