"""Embedding near-duplicates against brute force: clusters, copies, edge vectors and both pruning levels."""

import numpy as np
import pytest

from spooltrace.llm import embdedup

from test_simhash import brute_components


def brute(rows, t=0.95):
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    n = {i: 0 for i, _ in rows}
    links = []
    unit = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v in rows if i is not None and fine(v)]
    for k, (i, x) in enumerate(unit):
        for j, y in unit[k + 1:]:
            if len(x) == len(y) and x @ y >= t:
                n[i] += 1
                n[j] += 1
                links.append((i, j))
    comp = brute_components([i for i, _ in rows if i is not None], links)
    return {i: (n[i], comp[i], comp[i] == i) for i in comp}


def fixture():
    rng = np.random.default_rng(4)
    rows = [[float(x) for x in v] for v in rng.normal(size=(150, 24))]
    for c in rng.normal(size=(6, 24)):
        rows += [[float(x) for x in c + s * rng.normal(size=24)] for s in (0.02, 0.1, 0.2, 0.25, 0.3) for _ in range(8)]
    rows += [rows[0], rows[0], rows[5], [-x for x in rows[5]], [3 * x for x in rows[6]]]
    rows += [None, [], [0.0] * 24, [None] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0], [1.0, 2.1], [5.0]]
    return [(i * 7 % 1009, v) for i, v in enumerate(rows)]


@pytest.mark.parametrize("tile_rows,most_rows", [(16, 16384), (4096, 16384), (16, 5), (4096, 7)])
def test_against_brute_force(spark, tile_rows, most_rows):
    rows = fixture()
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, vec string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept)
           for r in embdedup.near_duplicates(frame, sample_rows=100, tile_rows=tile_rows, most_rows=most_rows).collect()}
    assert got == brute(rows)
    assert embdedup.near_duplicates(frame.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.99, 0.01])],
                                  "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embdedup.near_duplicates(frame).collect())
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_bounds_find_every_link_at_the_threshold():
    rng = np.random.default_rng(2)
    x = embdedup.unit_rows(np.repeat(rng.normal(size=(40, 32)), 5, axis=0) + 0.2 * rng.normal(size=(200, 32)))
    q, _ = np.linalg.qr(rng.normal(size=(32, 32)))
    for lead in (2, 16, 64):
        got = {(i, j) for p, r in embdedup.links_between(x, x, q, 0.95, True, lead, 8, 64) for i, j in zip(p.tolist(), r.tolist())}
        assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if x[i] @ x[j] >= 0.95}


def test_every_length_is_sampled(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(1000 + i, [1.0, 0.1 * i]) for i in range(3)]
    classes = embdedup.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")[1]
    axes = embdedup.fit_sample(classes, 40, 16)
    assert set(axes) == {8, 2}
