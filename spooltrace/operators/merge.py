"""Merge kernel (C1-C5, C8, C11): set-based upsert, insert-only merge, id assignment.

Plain Spark sources have no MERGE, so an upsert is a left join of the target
with the source plus an anti-join for the inserts: matched rows take the
source's ``set_cols`` (optionally only when ``update_when`` holds), unmatched
source rows are inserted with new ids, unmatched target rows stay. Duplicate
source keys raise, as the database does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spooltrace.operators.ranking import row_number_global
from spooltrace.session import broadcast_if_small, materialize

c = F.col


class DuplicateSourceKeys(ValueError):
    pass


def next_id(df: DataFrame, id_col: str = "id", empty_start: int = 1) -> int:
    """max(id) + 1, or ``empty_start`` for an empty table (one scalar aggregate)."""
    v = df.agg(F.max(id_col)).first()[0]
    return empty_start if v is None else int(v) + 1


def assign_ids(df: DataFrame, order_by: Sequence[str | Column], start: int, id_col: str = "id") -> DataFrame:
    """Ids start, start+1, ... in ``order_by`` order, without a single-partition window;
    materialized by the ranking kernel so retries give the same ids."""
    return row_number_global(df, order_by, col=id_col, start=start)


def check_unique(source: DataFrame, keys: Sequence[str]) -> None:
    dup = source.groupBy(*keys).count().where(c("count") > 1).limit(1).collect()
    if dup:
        raise DuplicateSourceKeys(f"source has duplicate merge keys, e.g. {dup[0].asDict()}")


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], set_cols: Sequence[str],
                 insert_cols: Sequence[str] | None = None, update_when: Column | None = None,
                 id_col: str | None = "id", id_order: Sequence[str] | None = None,
                 validate: bool = True, fill_cols: Sequence[str] = (),
                 start_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (new_target, actions) where actions has one row per touched key with ``_action``.

    Matched rows take ``set_cols`` from the source, and ``fill_cols`` only where the target has none.
    ``update_when`` may reference target columns as ``t_<name>`` and source
    columns as ``s_<name>``. Inserted rows get ids after the target's max id
    in ``id_order`` (default: the keys) order, or from ``start_id`` where the
    target given is only a part of its table.

    Plan: the target's keys, semi-joined to the source's, mark the source rows
    that have a target. Marked rows update by target LEFT JOIN source (few of
    them are broadcast, so that a large target is not shuffled for a daily
    increment or for a source that only inserts); the others are the inserts.
    A full outer join would always shuffle both sides, since neither side of a
    full outer join can be broadcast.
    """
    keys = list(keys)
    # the source (an increment) is read by the duplicate check and twice by the marking:
    # materialize it once instead of re-deriving it from lineage for each
    source = materialize(source)
    if validate:
        check_unique(source, keys)
    tcols = target.columns
    insert_cols = list(insert_cols) if insert_cols is not None else [x for x in source.columns]
    matched_keys = target.select(*keys).join(source.select(*keys), keys, "left_semi").distinct()
    marked = materialize(source.join(matched_keys.withColumn("_hit", F.lit(True)), keys, "left"))
    t = target.select(*[c(x).alias(f"t_{x}") for x in tcols])
    s = broadcast_if_small(marked.where(c("_hit")).select(*[c(x).alias(f"s_{x}") for x in source.columns],
                                                          F.lit(True).alias("_s")))
    cond = None
    for k in keys:
        e = c(f"t_{k}") == c(f"s_{k}")
        cond = e if cond is None else cond & e
    j = t.join(s, cond, "left")
    do_update = c("_s").isNotNull() & (update_when if update_when is not None else F.lit(True))

    def kept_col(x: str) -> Column:
        if x in set_cols and x in source.columns and x not in keys:
            return F.when(do_update, c(f"s_{x}")).otherwise(c(f"t_{x}")).cast(target.schema[x].dataType).alias(x)
        if x in fill_cols:
            return F.when(do_update, F.coalesce(c(f"t_{x}"), c(f"s_{x}"))).otherwise(c(f"t_{x}")).cast(
                target.schema[x].dataType).alias(x)
        return c(f"t_{x}").alias(x)

    updated = j.select(*[kept_col(x) for x in tcols], F.when(do_update, F.lit("UPDATE")).alias("_action"))
    new_src = marked.where(c("_hit").isNull())

    def new_col(x: str) -> Column:
        if x in source.columns and (x in keys or x in insert_cols):
            return c(x).cast(target.schema[x].dataType).alias(x)
        return F.lit(None).cast(target.schema[x].dataType).alias(x)

    inserted = new_src.select(*[new_col(x) for x in tcols], F.lit("INSERT").alias("_action"))
    if id_col is not None and id_col in tcols:
        start = next_id(target, id_col) if start_id is None else start_id
        inserted = assign_ids(inserted.drop(id_col), list(id_order or keys), start, id_col).select(*tcols, "_action")
    merged = updated.unionByName(inserted)
    actions = merged.where(c("_action").isNotNull()).select(*keys, "_action")
    return merged.drop("_action"), actions


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str], id_col: str | None = "id",
                   id_order: Sequence[str] | None = None, start_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert-only merge: (new_target, inserted rows).

    The target's keys are first semi-joined to the (usually small) source keys,
    so only matching keys leave the target scan; the source is then
    anti-joined to that small set.
    """
    keys = list(keys)
    present = target.select(*keys).join(source.select(*keys), keys, "left_semi")
    new = source.join(present, keys, "left_anti")
    if id_col is not None and id_col in target.columns:
        start = next_id(target, id_col) if start_id is None else start_id
        new = assign_ids(new.drop(id_col) if id_col in new.columns else new, list(id_order or keys), start, id_col)
    for x in target.columns:
        if x not in new.columns:
            new = new.withColumn(x, F.lit(None).cast(target.schema[x].dataType))
    new = new.select(*[c(x).cast(target.schema[x].dataType).alias(x) for x in target.columns])
    return target.unionByName(new), new


def merge_outcome(actions: DataFrame) -> DataFrame:
    """C4: counts per merge action."""
    return actions.groupBy(c("_action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def earliest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row per key by ``order_by`` (ties: the remaining order columns).

    An aggregate (``min_by``) instead of a window: the partial aggregation
    collapses a hot key map-side.
    """
    others = [x for x in df.columns if x not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order_by)).alias("_b"))
    return best.select(*keys, *[c(f"_b.{x}").alias(x) for x in others]).select(*df.columns)


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str],
               date_fields: Sequence[str] = ()) -> DataFrame:
    """C11: (record_id, field, old_value, new_value) for fields whose value differs (dates by day)."""
    o = old.select(c(key).alias("record_id"), *[c(f).alias(f"o_{f}") for f in fields])
    n = new.select(c(key).alias("record_id"), *[c(f).alias(f"n_{f}") for f in fields])
    j = o.join(n, "record_id")

    def val(prefix: str, f: str) -> Column:
        v = c(f"{prefix}_{f}")
        return F.date_format(v, "yyyy-MM-dd") if f in date_fields else v.cast("string")

    longs = j.select("record_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), val("o", f).alias("old_value"), val("n", f).alias("new_value"))
        for f in fields])).alias("d"))
    return longs.select("record_id", "d.field", "d.old_value", "d.new_value").where(
        ~c("old_value").eqNullSafe(c("new_value")))


def next_seq_for_lot(codes: DataFrame, lots: DataFrame, code_col: str = "product_code",
                     lot_col: str = "lot_number") -> DataFrame:
    """Per lot, 1 + the largest sequence among the codes of its units (0 when none).

    ``codes`` carries each unit's own lot, so a sequence is what follows the
    lot in the code, whatever its number of digits: past 9999 units it goes on
    without repeating a code. Done for all lots at once, without a lock.
    """
    lot, code = c(lot_col), c(code_col)
    seq = F.expr(f"substring({code_col}, length({lot_col}) + 1)").try_cast("long")
    cand = (codes.where(F.startswith(code, lot)).groupBy(lot.alias("_lot")).agg(F.max(seq).alias("_max")))
    ls = lots.select(lot.alias("lot_number")).distinct()
    return (ls.join(cand, c("lot_number") == c("_lot"), "left")
            .select("lot_number", (F.coalesce(c("_max"), F.lit(0)) + 1).cast("long").alias("next_seq")))
