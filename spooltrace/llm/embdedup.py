"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the principal axes of a
bounded sample, so the leading coordinates carry the most. A tree of median
splits along the leading axes cuts the space into tiles of about ``tile_rows``
vectors; two tiles further apart than the linking radius are never compared,
and a vector visits another tile only if it lies within the radius of its box.

Inside a pair of tiles one matrix product over the leading coordinates, with
the norms of the rest as one more coordinate, gives an upper bound of every
cosine (Cauchy-Schwarz on the residual). Pairs whose bound cannot reach the
threshold stop there; the others accumulate the remaining coordinates in
slices, with the bound renewed after each, and what is left is decided by the
cosine in double precision. The sample steers the work only: every pair of
vectors that can reach the threshold is decided exactly.

The sample bounds the number of tiles, so a tile may hold far more than
``tile_rows`` vectors of a very large table. Pairs of tiles are counted, and those
with more than ``most_rows`` vectors on a side become pairs of chunks.

Equal vectors are one class with a weight, so copies are compared once. A pair
of tiles returns link counts and a spanning star per local component, never
its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, link with nothing (and are kept, being
their own component); vectors of different lengths never link; repeated rows
are separate vectors that link; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spooltrace.llm.common import map_batches, materialize
from spooltrace.llm.components import connected_components

_SLACK = 1e-4  # above the rounding of single-precision bounds


@dataclass
class Axes:
    """Principal axes of one vector length and the tree of tiles along the leading ones."""
    basis: np.ndarray
    # nodes: (axis, cut, below, above) or (-1, 0.0, tile, tile)
    nodes: list[tuple[int, float, int, int]] = field(default_factory=list)
    low: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    high: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (first by their largest component, against overflow)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_axes(sample: np.ndarray, tiles: int, lead: int = 16) -> Axes:
    """Axes of the sample's second moments, and median splits into ``tiles`` boxes."""
    unit = unit_rows(sample)
    values, vectors = np.linalg.eigh(unit.T @ unit / len(unit))
    axes = Axes(np.ascontiguousarray(vectors[:, np.argsort(-values)]))
    turned = unit @ axes.basis
    lead = min(lead, turned.shape[1])
    low, high = [], []

    def split(rows: np.ndarray, want: int, lo: np.ndarray, hi: np.ndarray) -> int:
        at = len(axes.nodes)
        axes.nodes.append((-1, 0.0, len(low), len(low)))
        part = turned[rows, :lead]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(rows) else 0
        cut = float(np.median(part[:, axis])) if len(rows) else 0.0
        below = part[:, axis] < cut
        if want < 2 or not below.any() or below.all():
            low.append(lo)
            high.append(hi)
            return at
        hi_below, lo_above = hi.copy(), lo.copy()
        hi_below[axis] = lo_above[axis] = cut
        b = split(rows[below], want // 2, lo, hi_below)
        a = split(rows[~below], want - want // 2, lo_above, hi)
        axes.nodes[at] = (axis, cut, b, a)
        return at

    split(np.arange(len(turned)), tiles, np.full(lead, -np.inf), np.full(lead, np.inf))
    axes.low, axes.high = np.array(low), np.array(high)
    return axes


def home_tiles(axes: Axes, turned: np.ndarray) -> np.ndarray:
    out = np.zeros(len(turned), np.int64)
    todo = [(0, np.arange(len(turned)))]
    while todo:
        node, rows = todo.pop()
        axis, cut, below, above = axes.nodes[node]
        if axis < 0:
            out[rows] = below
        else:
            low = turned[rows, axis] < cut
            todo += [(below, rows[low]), (above, rows[~low])]
    return out


def _gap(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Squared distance between boxes (or points as boxes) along the leading axes."""
    d = np.maximum(np.maximum(lo_b - hi_a, lo_a - hi_b), 0)
    return (d * d).sum(axis=-1)


def tile_visits(axes: Axes, turned: np.ndarray, radius2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, home tile, other tile) for every pair of tiles in which the row may link; a tile also meets itself."""
    home = home_tiles(axes, turned)
    lead = axes.low.shape[1]
    rows, own, other = [], [], []
    for h in np.unique(home):
        mine = np.flatnonzero(home == h)
        near = np.flatnonzero(_gap(axes.low[h], axes.high[h], axes.low, axes.high) <= radius2)
        point = turned[mine, :lead]
        for t in near:
            ok = mine if t == h else mine[_gap(point, point, axes.low[t], axes.high[t]) <= radius2]
            rows.append(ok)
            own.append(np.full(len(ok), h))
            other.append(np.full(len(ok), t))
    if not rows:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(own), np.concatenate(other)


def links_between(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool, lead: int = 16,
                  step: int = 16, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit rows with cosine >= threshold, block by block; ``same`` gives each pair of one set once."""
    ta, tb = a @ basis, b @ basis
    dim = a.shape[1]
    lead = min(lead, dim)

    def rest(t: np.ndarray, d: int) -> np.ndarray:
        return np.sqrt((t[:, d:] ** 2).sum(axis=1))

    fa = np.column_stack((ta[:, :lead], rest(ta, lead))).astype(np.float32)
    fb = np.column_stack((tb[:, :lead], rest(tb, lead))).astype(np.float32).T
    stops = [*range(lead, dim, step), dim]
    tails_a, tails_b = {d: rest(ta, d) for d in stops[1:]}, {d: rest(tb, d) for d in stops[1:]}
    least = np.float32(threshold - _SLACK)
    for r in range(0, len(a), block):
        first = r if same else 0
        i, j = np.nonzero(fa[r:r + block] @ fb[:, first:] >= least)
        i, j = i + r, j + first
        if same:
            i, j = i[j > i], j[j > i]
        for s in range(0, len(i), 1 << 18):
            p, q = i[s:s + (1 << 18)], j[s:s + (1 << 18)]
            dot = np.einsum("ij,ij->i", ta[p, :lead], tb[q, :lead])
            for d0, d1 in zip(stops, stops[1:]):
                dot += np.einsum("ij,ij->i", ta[p, d0:d1], tb[q, d0:d1])
                ok = dot + tails_a[d1][p] * tails_b[d1][q] >= threshold - _SLACK
                p, q, dot = p[ok], q[ok], dot[ok]
            ok = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
            if ok.any():
                yield p[ok], q[ok]


def _local_roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index of each component of the local links."""
    root = np.arange(n)
    if not pairs:
        return root
    p, q = np.concatenate([x[0] for x in pairs]), np.concatenate([x[1] for x in pairs])
    while True:
        m = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, root[p], m)
        np.minimum.at(new, root[q], m)
        np.minimum.at(new, p, m)
        np.minimum.at(new, q, m)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_LINKS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def compare_tiles(t: pa.Table, basis: dict[int, np.ndarray], threshold: float) -> pa.Table:
    """Link counts and local component roots of one pair of tiles."""
    t = t.sort_by("id")  # local roots are then smallest ids
    ids, weight = t.column("id").to_numpy(), t.column("weight").to_numpy()
    side = t.column("side").to_numpy()
    dim = t.column("dim")[0].as_py()
    x = unit_rows(np.frombuffer(b"".join(t.column("vec").to_pylist()), "<f8").reshape(len(ids), dim))
    q = basis.get(dim)
    q = np.eye(dim) if q is None else q
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = t.column("same")[0].as_py()  # a tile, or a chunk of one, with itself comes once
    if same:
        two = one
    elif not len(one) or not len(two):
        return _LINKS.empty_table()
    count = np.zeros(len(ids), np.int64)
    pairs = []
    for i, j in links_between(x[one], x[two], q, threshold, same):
        p, r = one[i], two[j]
        np.add.at(count, p, weight[r])
        np.add.at(count, r, weight[p])
        pairs.append((p, r))
        if sum(len(y[0]) for y in pairs) > 1 << 21:  # keep a star per component instead of the pairs
            root = _local_roots(len(ids), pairs)
            pairs = [(root, np.arange(len(ids)))]
    root = _local_roots(len(ids), pairs)
    hit = np.flatnonzero(count)
    return pa.table([pa.array(ids[hit]), pa.array(count[hit]), pa.array(ids[root[hit]])], schema=_LINKS)


def vector_classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with validity, classes of equal valid vectors with smallest id and weight), both written."""
    v = F.col("vec")
    fine = (F.col("vec_id").isNotNull() & v.isNotNull()
            & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    rows = materialize(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
                       .withColumn("fine", fine).withColumn("vec", F.when(F.col("fine"), v)), "vectors")
    classes = materialize(rows.where("fine").groupBy("vec").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")), "vectors")
    return rows, classes


def fit_sample(classes: DataFrame, sample_rows: int, tile_rows: int, max_values: int = 1 << 22) -> dict[int, Axes]:
    """Axes per vector length from at most ``sample_rows`` vectors in all (of each length the smallest hashes of the id).

    Sample and tiles also hold at most ``max_values`` components, whatever the length of the vectors.
    """
    size = F.size("vec").alias("d")
    lengths = {r.d: r.n for r in classes.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    most = max(64, max_values // max(lengths, default=1))
    each = max(1, min(sample_rows, most) // max(len(lengths), 1))
    rank = F.row_number().over(Window.partitionBy("d").orderBy("h", "id"))
    picked = (classes.select(size, F.xxhash64("id").alias("h"), "id", "vec").withColumn("k", rank).where(F.col("k") <= each)
              .select("vec").collect())
    by: dict[int, list] = {}
    for r in picked:
        by.setdefault(len(r.vec), []).append(r.vec)
    return {d: fit_axes(np.array(x), max(1, round(lengths[d] / min(tile_rows, most)))) for d, x in by.items()}


_TILES = ["dim", "low", "high"]


def chunked(dealt: DataFrame, most_rows: int) -> DataFrame:
    """``dealt`` with the chunks (``one``, ``two``) that a row is compared in, and whether they are the same rows.

    A pair of tiles with at most ``most_rows`` vectors a side is one pair of chunks. Of a larger one, each row goes to its
    chunk by hash, and meets every chunk of the other side; within one tile, every chunk meets itself and every later one.
    """
    whole = F.col("low") == F.col("high")
    sizes = materialize(dealt.groupBy(*_TILES).agg(F.count_if(F.col("side") == 0).alias("n0"),
                                                       F.count_if(F.col("side") == 1).alias("n1"))
                        .where((F.col("n0") > most_rows) | (F.col("n1") > most_rows)), "tiles")
    plain = dealt.withColumn("one", F.lit(0)).withColumn("two", F.lit(0)).withColumn("same", whole)
    if sizes.isEmpty():
        return plain

    def parts(n: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / most_rows), F.lit(1)).cast("int")

    split = sizes.select(*_TILES, parts("n0").alias("p0"), parts("n1").alias("p1"))
    met = dealt.join(split, _TILES, "left")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("p0")).otherwise(F.col("p1"))).cast("int")

    def to(one: Column, two: Column, side: Column, same: Column) -> Column:
        return F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"), side.cast("int").alias("side"), same.alias("same"))

    zero, no = F.lit(0), F.lit(False)
    within = F.transform(F.sequence(zero, F.col("p0") - 1), lambda j: to(
        F.least(j, mine), F.greatest(j, mine), F.when(mine <= j, 0).otherwise(1), j == mine))
    across = F.when(F.col("side") == 0, F.transform(F.sequence(zero, F.col("p1") - 1), lambda j: to(mine, j, zero, no))).otherwise(
        F.transform(F.sequence(zero, F.col("p0") - 1), lambda j: to(j, mine, F.lit(1), no)))
    goes = F.when(F.col("p0").isNull(), F.array(to(zero, zero, F.col("side"), whole))).when(whole, within).otherwise(across)
    rest = [c for c in dealt.columns if c != "side"]
    return met.select(*rest, F.explode(goes).alias("g")).select(*rest, "g.*")


def link_counts(classes: DataFrame, axes: dict[int, Axes], threshold: float, most_rows: int = 16384) -> DataFrame:
    """(id, n, root) per class and pair of tiles, for classes with links there."""
    radius2 = 2 - 2 * threshold + _SLACK

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, weight, vec = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            dims = np.diff(vec.offsets.to_numpy())
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                flat = vec.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), d)
                row, own, other = tile_visits(axes[d], unit_rows(flat) @ axes[d].basis, radius2)
                raw = [x.tobytes() for x in flat.astype("<f8")]
                low, high = np.minimum(own, other), np.maximum(own, other)
                for s in range(0, len(row), 20_000):
                    k = row[s:s + 20_000]
                    lo, hi = low[s:s + 20_000], high[s:s + 20_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(k), d, np.int32)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                        pa.array((own[s:s + 20_000] != lo).astype(np.int32)), pa.array(ids[rows[k]]),
                        pa.array(weight[rows[k]]), pa.array([raw[x] for x in k], pa.binary())],
                        names=["dim", "low", "high", "side", "id", "weight", "vec"])

    basis = {d: a.basis for d, a in axes.items()}
    dealt = map_batches(
        classes.select("id", "weight", "vec"), deal, "dim int, low int, high int, side int, id long, weight long, vec binary")
    return chunked(dealt, most_rows).groupBy(*_TILES, "one", "two").applyInArrow(
        lambda t: compare_tiles(t, basis, threshold), "id long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, sample_rows: int = 8192, tile_rows: int = 4096,
                    id_col: str = "vec_id", vec_col: str = "embedding", most_rows: int = 16384) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows, classes = vector_classes(vectors, id_col, vec_col)
    axes = fit_sample(classes, sample_rows, tile_rows)
    found = materialize(link_counts(classes, axes, threshold, most_rows), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct())
    per_class = materialize(
        classes.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select(
            "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
            F.coalesce("root", "id").alias("root")), "classes")
    out = rows.join(per_class, "vec", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def embedding_query(embeddings: DataFrame) -> DataFrame:
    """Links, component and verdict for every vector, whatever its label."""
    return near_duplicates(embeddings)


EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS x,
        embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        AND len(list_filter(embedding, lambda e: e <> 0)) > 0 AS fine
    FROM embeddings),
u AS (SELECT vec_id, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x FROM v WHERE fine),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_dot_product(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)
"""
