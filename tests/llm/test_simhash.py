"""SimHash fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from spooltrace.llm import simhash
from spooltrace.llm.components import connected_components

from conftest import SF_SMALL


def brute_fingerprint(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    hs = [xxhash.xxh64(" ".join(ws[i:i + n]).encode(), seed=42).intdigest() for i in range(max(1, len(ws) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_groups(fps, max_bits=4):
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= max_bits]
    return brute_components(fps, links)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = [(10_001, None), (10_002, ""), (10_003, "\x0b \t"), (10_004, "É È A a A a"), (10_005, "x " * 70_000),
             (10_006, "one"), (10_007, "One"), (10_008, "a b c d"), (10_009, "a\x1cb   c d")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_groups(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_query(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("chunk", [4, 4096])
def test_links_of_planted_neighbours(spark, chunk):
    rnd = random.Random(3)
    fps = {0: 0, 1: 0xF, 2: 0xFF}
    for c in range(20):
        base = rnd.getrandbits(64)
        for _ in range(15):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << b
            fps[len(fps)] = x
    rows = [(i, simhash._signed(x)) for i, x in fps.items()]
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    links = simhash.fingerprint_links(frame.select("fp").distinct(), chunk=chunk).collect()
    by_fp = {simhash._signed(x) for x in fps.values()}
    got = brute_components(by_fp, [(r.a, r.b) for r in links])
    want = brute_components(by_fp, [(a, b) for a in by_fp for b in by_fp
                                    if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    assert got == want


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, 1000, dtype=np.uint64), rng.integers(0, 2**64, 1000, dtype=np.uint64)
    d = simhash._manhattan(simhash._embed(a), simhash._embed(b))
    assert (d <= np.bitwise_count(a ^ b)).all()
    count = lambda x: [(int(x) >> 2 * s & 3).bit_count() for s in range(32)]
    assert [sum(abs(p - q) for p, q in zip(count(x), count(y))) for x, y in zip(a, b)] == d.tolist()


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    links += links[:3] + [(500, 500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links[:-1] for x in p}
    assert got == brute_components(nodes, links[:-1])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_per_group(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "a b c d e f g", "z"), (None, "q r s t u v", "n"),
            (3, None, "k"), (4, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.keep_one_per_group(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, "q r s t u v"), (1, "a b c d e f g"), (3, "")]
    assert simhash.keep_one_per_group(docs.limit(0)).count() == 0
