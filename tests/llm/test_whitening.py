"""Whitening: exact products against plain integers, the contract's laws, edge vectors."""

import math

import numpy as np
import pytest

from spooltrace.llm import whitening

from conftest import SF_SMALL


@pytest.mark.parametrize("bound", [1, 600, 1 << 40, 1 << 60])
def test_plane_products_are_exact(bound):
    rng = np.random.default_rng(3)
    x = rng.integers(-bound, bound, (131, 5), endpoint=True)
    x[:, 2] = 7  # constant
    sums, cross = whitening.plane_products(x)
    big = x.astype(object)
    assert sums == big.sum(axis=0).tolist()
    assert cross == [[int((big[:, i] * big[:, j]).sum()) for j in range(i, 5)] for i in range(5)]


def plain(rows, components=8):
    """(vec_id, deviation) and the whitened rows up to sign, by plain integers and numpy."""
    good = [(i, [int(math.floor(1024 * c)) + 100000 for c in v]) for i, v in rows]
    n, dims = len(good), len(good[0][1])
    s = [sum(x[d] for _, x in good) for d in range(dims)]
    dev = [sum((n * x[d] - s[d]) ** 2 for d in range(dims)) for _, x in good]
    centred = np.array([[(n * x[d] - s[d]) / n for d in range(dims)] for _, x in good])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, dims)
    return n, dev, np.abs(centred @ u[:, :k] / np.sqrt(e[:k])), e[:k] / np.trace(v)


def check(spark, rows, out):
    n, dev, white, share = plain(rows)
    got = sorted(out.collect(), key=lambda r: (r.vec_id, r.component))
    k = white.shape[1]
    assert len(got) == n * k
    assert [r.component for r in got[:k]] == list(range(1, k + 1))
    assert {r.n for r in got} == {n}
    assert [r.deviation for r in got[::k]] == dev
    assert np.allclose(np.abs([r.whitened for r in got]), white.ravel(), atol=1e-8)
    assert np.allclose([r.explained for r in got[:k]], share, rtol=1e-9)
    w = np.array([r.whitened for r in got]).reshape(n, k)
    c = w - w.mean(axis=0)
    error = np.abs(c.T @ c / n - np.eye(k)).max()
    assert error < 1e-8 and {r.identity_error for r in got} == {got[0].identity_error}
    assert abs(got[0].identity_error - error) < 1e-9


def test_supplied_table(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    check(spark, rows, whitening.whitening_query(table))


@pytest.mark.parametrize("block_rows", [1, 7, 64, 4096])
def test_blocks_do_not_matter(spark, block_rows):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    vectors = whitening.integer_vectors(table)
    assert whitening.exact_totals(vectors, block_rows) == whitening.exact_totals(vectors, 100)


def test_edge_vectors(spark):
    good = [(i, [math.sin(i * 1.3), -0.0009765625 * i, 2.5 + i % 3]) for i in range(20)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [0.0, float("inf"), 1.0]), (104, [])]
    good += [(i + 30, v) for i, v in good[:2]]  # equal vectors count each
    frame = spark.createDataFrame([(i, v, 1, "w") for i, v in good + bad],
                                  "vec_id long, embedding array<double>, x int, white string")
    check(spark, good, whitening.whitening_query(frame))
    twice = whitening.whitening_query(frame.unionByName(frame)).collect()  # repeated rows stay
    assert len(twice) == 2 * 3 * len(good) and {r.n for r in twice} == {2 * len(good)}
    assert whitening.whitening_query(frame.limit(0)).count() == 0


def test_flat_dimensions_and_lengths(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0]), (None, [9.0])]
    out = {(r.vec_id, r.component): r for r in whitening.whitening_query(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert abs(abs(out[1, 1].whitened) - 1) < 1e-12 and out[1, 2].whitened is None and out[1, 1].n == 2
    assert out[3, 1].n == 2 and abs(out[None, 1].explained - 1) < 1e-12
    one = whitening.whitening_query(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")).collect()
    assert [(r.component, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, None, None), (2, 0, None, None)]


def test_huge_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.5, 2.0])]
    out = sorted(whitening.whitening_query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(),
                 key=lambda r: (r.vec_id, r.component))
    x = [[(1 << 61) + 100000, 100000], [-(1 << 61) + 100000, 101024], [100512, 102048]]
    s = [sum(c) for c in zip(*x)]
    want = [sum((3 * v - t) ** 2 for v, t in zip(row, s)) for row in x]
    assert [int(r.deviation_exact) for r in out[::2]] == want and out[0].deviation is None
