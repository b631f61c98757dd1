"""Whitening of embeddings from an exact bit-sliced scatter.

Entries become integers. Tasks take blocks of rows, shift every dimension by its
least value in the block and pack each bit plane of the rest into 64-bit words.
The number of rows with bit a of dimension i and bit b of dimension j set is the
popcount of the AND of two planes; weighted by 2^(a+b) and summed, these are the
block's exact cross-products. Sums over the table stay exact (two decimals, the
lower holding 60 bits), and n times the cross-product minus the product of the
sums is the centred scatter as an integer, turned into a double only for the
eigenvectors. What reaches the driver is one matrix a vector length, whatever the
number of rows.

Defined results: vectors that are null or hold null or non-finite entries are
dropped; equal rows count each; vectors of different lengths are separate fit
lists; an empty vector has no component and so no row; entries beyond 2^51 in size count
as that bound; a component without variance has no whitened value (null), and the
identity error covers the others (null if there is none); a deviation beyond 63
bits is null in ``deviation`` and whole in ``deviation_exact``; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.llm.common import map_batches, materialize

SCALE, OFFSET = 1024, 100000
MOST = 1 << 61
LOW_BITS = 60
_ROW = "vec_id long, x array<long>"


def to_integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 of finite doubles."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(SCALE))
    return np.clip(scaled, -float(MOST), float(MOST)).astype(np.int64) + OFFSET


def _integer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        flat = lists.flatten()
        finite = np.isfinite(values := flat.cast(pa.float64()).to_numpy(zero_copy_only=False))
        sizes = np.diff(lists.offsets.to_numpy())
        x = to_integers(np.where(finite, values, 0.0))
        bad = np.zeros(len(sizes), bool)
        bad[np.repeat(np.arange(len(sizes)), sizes)[~finite]] = True  # null entries are NaN here
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        out = pa.ListArray.from_arrays(offsets, pa.array(x))
        yield pa.RecordBatch.from_arrays([b.column(0), out], names=["vec_id", "x"]).filter(pa.array(~bad))


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that are whole."""
    rows = embeddings.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return map_batches(rows, _integer_rows, _ROW)


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes as words, dimension of each plane, bit of each plane) of an array (rows, dimensions) of uint64."""
    n, dims = shifted.shape
    words = -(-n // 64)
    planes, owner, bit = [], [], []
    for d in range(dims):
        column = shifted[:, d]
        for k in range(int(column.max()).bit_length()):
            marks = np.zeros(words * 64, np.uint8)
            marks[:n] = (column >> np.uint64(k)) & np.uint64(1)
            planes.append(np.packbits(marks, bitorder="little").view(np.uint64))
            owner.append(d)
            bit.append(k)
    return (np.array(planes, np.uint64).reshape(len(planes), words), np.array(owner, np.int64), np.array(bit, np.int64))


def plane_products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums and cross-products (rows i, columns from i on) of an integer array (rows, dimensions)."""
    n, dims = x.shape
    shift = x.min(axis=0)
    shifted = (x.astype(np.uint64) - shift.astype(np.uint64))  # differences are below 2^64
    planes, owner, bit = bit_planes(shifted)
    wide = int(bit.max()) + 1 if len(bit) else 1
    exact_long = 2 * wide + n.bit_length() < 62
    cross = np.zeros((dims, dims), np.int64 if exact_long else object)
    weight = (1 << bit) if exact_long else np.array([1 << int(b) for b in bit], object)
    sums = np.zeros(dims, object)
    # planes stand in order of dimension, so those of the dimensions from i on are a tail
    first = np.searchsorted(owner, np.arange(dims))
    for p in range(len(planes)):
        i = int(owner[p])
        ones = np.bitwise_count(planes[first[i]:] & planes[p]).sum(axis=1, dtype=np.int64)
        parts = (ones if exact_long else ones.astype(object)) * weight[first[i]:]
        edges = first[i:] - first[i]
        total = np.zeros(dims - i, cross.dtype)
        held = np.append(edges[1:], len(parts)) > edges  # a constant dimension has no plane
        if held.any():
            total[held] = np.add.reduceat(parts, edges[held])
        cross[i, i:] += total * weight[p]
        sums[i] += int(ones[p - first[i]]) << int(bit[p])
    a = [int(v) for v in shift]
    s = [int(v) for v in sums]
    full = [[int(cross[i, j]) + a[i] * s[j] + a[j] * s[i] + n * a[i] * a[j] for j in range(i, dims)] for i in range(dims)]
    return [s[i] + n * a[i] for i in range(dims)], full


def _split(total: int) -> dict[str, Decimal]:
    high = total >> LOW_BITS
    return {"high": Decimal(high), "low": Decimal(total - (high << LOW_BITS))}


_PART = pa.schema([("dims", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()),
                   ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])


def _scatter(block_rows: int):
    def emit(x: np.ndarray, totals: dict[int, tuple]) -> None:
        dims = x.shape[1]
        sums, cross = plane_products(x)
        if dims in totals:
            n, s, c = totals[dims]
            totals[dims] = (n + len(x), [a + b for a, b in zip(s, sums)],
                            [[a + b for a, b in zip(p, q)] for p, q in zip(c, cross)])
        else:
            totals[dims] = (len(x), sums, cross)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple] = {}
        waiting: dict[int, list[np.ndarray]] = {}
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes[sizes > 0]).tolist():
                rows = flat[starts[sizes == dims][:, None] + np.arange(dims)]
                held = waiting.setdefault(dims, [])
                held.append(rows)
                if sum(map(len, held)) >= block_rows:
                    whole = np.concatenate(held)
                    for k in range(0, len(whole) - block_rows + 1, block_rows):
                        emit(whole[k:k + block_rows], totals)
                    waiting[dims] = [whole[len(whole) // block_rows * block_rows:]]
        for dims, held in waiting.items():
            if len(rest := np.concatenate(held)):
                emit(rest, totals)
        for dims, (n, sums, cross) in totals.items():
            yield pa.RecordBatch.from_pylist(
                [{"dims": dims, "i": -1, "j": j, "n": n, **_split(v)} for j, v in enumerate(sums)]
                + [{"dims": dims, "i": i, "j": i + k, "n": n, **_split(v)} for i, row in enumerate(cross)
                   for k, v in enumerate(row)], schema=_PART)
    return run


@dataclass(frozen=True)
class Fit:
    """One fit list: rows, sums and the unit eigenvectors (columns) by falling eigenvalue."""
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def exact_totals(vectors: DataFrame, block_rows: int = 4096) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """By vector length: rows, sums, cross-products (upper triangle) as integers."""
    parts = map_batches(vectors, _scatter(block_rows), "dims int, i int, j int, n long, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("dims", "i", "j").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    out: dict[int, tuple[int, list[int], list[list[int]]]] = {}
    for r in rows.collect():  # (length + 3) * length / 2 rows for each vector length
        _, sums, cross = out.setdefault(r.dims, (r.n, [0] * r.dims, [[0] * r.dims for _ in range(r.dims)]))
        total = (int(r.high) << LOW_BITS) + int(r.low)
        if r.i < 0:
            sums[r.j] = total
        else:
            cross[r.i][r.j] = cross[r.j][r.i] = total
    return out


def fit_whitening(vectors: DataFrame, block_rows: int = 4096) -> dict[int, Fit]:
    """Fits by vector length; the scatter is centred as integers before the eigenvectors are taken."""
    fits = {}
    for dims, (n, sums, cross) in exact_totals(vectors, block_rows).items():
        v = np.array([[(n * cross[i][j] - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)])
        values, columns = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")
        values, columns = values[order], columns[:, order]
        flat = values <= max(values[0], 0.0) * dims * np.finfo(float).eps
        fits[dims] = Fit(n, tuple(sums), np.where(flat, 0.0, values), columns, float(np.trace(v)))
    return fits


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over dimensions of (n x - S)^2 of every row, exact."""
    mean = [s // n for s in sums]
    rest = np.array([s - m * n for s, m in zip(sums, mean)], object)
    near = x.astype(object) - np.array(mean, object)
    reach = int(np.abs(near).max()) * n + n
    if reach * reach * x.shape[1] < 1 << 62:
        d = near.astype(np.int64) * n - rest.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    d = near * n - rest
    return (d * d).sum(axis=1).tolist()


_OUT = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("deviation_exact", pa.string()),
                  ("white", pa.list_(pa.float64()))])


def whitened_vectors(vectors: DataFrame, fits: dict[int, Fit], components: int = 8) -> DataFrame:
    """(vec_id, dims, deviation_exact, white): projections on the first components over their standard deviations."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            ids = b.column(0)
            for dims in np.unique(sizes[sizes > 0]).tolist():
                which = np.flatnonzero(sizes == dims)
                x, fit = flat[starts[which][:, None] + np.arange(dims)], fits[dims]
                mean = [s // fit.n for s in fit.sums]
                part = np.array([(s - m * fit.n) / fit.n for s, m in zip(fit.sums, mean)])
                centred = (x - np.array(mean, np.int64)).astype(float) - part
                keep = fit.values[:components]
                scale = np.sqrt(np.where(keep > 0, keep, np.nan))
                white = centred @ fit.vectors[:, :components] / scale
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(which)), pa.array([dims] * len(which), pa.int32()),
                     pa.array(list(map(str, deviations(x, fit.n, fit.sums))), pa.string()),
                     pa.array([[None if v != v else v for v in row] for row in white.tolist()], pa.list_(pa.float64()))],
                    schema=_OUT)

    return map_batches(vectors, run, "vec_id long, dims int, deviation_exact string, white array<double>")


def identity_errors(white: DataFrame, fits: dict[int, Fit], components: int = 8) -> dict[int, float | None]:
    """By vector length, the largest absolute entry of the whitened rows' covariance minus the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    at = [F.get("white", F.lit(i)) for i in range(components)]
    rows = white.groupBy("dims").agg(*(F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs)).collect()
    out: dict[int, float | None] = {}
    for r in rows:  # one row a vector length
        use = int((fits[r.dims].values[:components] > 0).sum())
        errors = [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < use]
        out[r.dims] = max(errors, default=None)
    return out


def whitening_query(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: a row for every whole vector and each of its first 8 components."""
    spark = embeddings.sparkSession
    vectors = materialize(integer_vectors(embeddings), "vectors")
    fits = fit_whitening(vectors)
    white = materialize(whitened_vectors(vectors, fits), "whitened")
    errors = identity_errors(white, fits)
    facts = spark.createDataFrame(
        [(d, f.n, [float(v / f.trace) if f.trace else None for v in f.values[:8]], errors.get(d)) for d, f in fits.items()],
        "dims int, n long, shares array<double>, identity_error double")  # a row for each vector length
    rows = white.join(F.broadcast(facts), "dims").select(
        "vec_id", "n", "deviation_exact", "shares", "identity_error", F.posexplode("white").alias("k", "whitened"))
    return rows.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), "n",
        F.expr("try_cast(deviation_exact AS bigint)").alias("deviation"), "whitened",
        F.get("shares", F.col("k")).alias("explained"), "identity_error", "deviation_exact")
