"""Packing: token ids against the tokenizers library, the plan's laws, and the query end to end."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from spooltrace.llm import packing, tokens

from conftest import SF_SMALL

PATH = tokens.vocabulary("byte_bpe_50k.json")


def test_safe_characters_encode_alike():
    enc = tokens.ByteLevelEncoder(PATH)
    chars = [c for c in map(chr, range(0x110000)) if regex.match(f"[{tokens.SAFE}]", c)]
    assert len(chars) > 20_000
    for i in range(0, len(chars), 50):
        text = "".join(f"a{c}b 1{c}2 !{c}? {c} {c}{c}\n" for c in chars[i:i + 50])
        assert not enc.unsafe(text)
        assert enc.encode(text) == np.array(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_odd_texts_encode_alike():
    enc = tokens.ByteLevelEncoder(PATH)
    for t in ["", "a<|endoftext|>b", "  x\u00a0 \u3000y\n\n \t z", "\U0001f600\u0558x", "it's they'LL", "e\u0301 \u03a3 \x1c\x00 "]:
        assert enc.encode(t) == np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("histogram", [
    {n: n % 7 for n in range(1, 1025)}, {700: 30, 400: 29, 300: 15, 30: 90}, {1: 5}, {1024: 3}, {513: 11}, {},
    {n: random.Random(5).randint(0, 4) for n in range(1, 200)}, {128: 9, 129: 9, 1023: 4, 3: 100}])
@pytest.mark.parametrize("groups", [3, 1024])
def test_plan_places_every_length_once(histogram, groups):
    plan, used = packing.make_plan(dict(histogram), groups=groups)
    ranks, filled = defaultdict(list), defaultdict(list)
    for length, rank, n, seq, offset in plan:
        ranks[length] += range(rank, rank + n)
        for s in range(seq, seq + n):
            filled[s].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items() if n}
    assert sorted(filled) == list(range(used))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_few_sequences():
    rnd = random.Random(1)
    histogram = {n: rnd.randint(100, 1000) for n in range(1, 1025)}
    _, used = packing.make_plan(histogram)
    assert used * 1024 < 1.02 * sum(n * c for n, c in histogram.items())


def test_query_packs_whole_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    extra = [(10_001, None, 1), (10_002, "", 2), (10_003, "x y " * 4000, 3), (None, "null id", 4),
             (10_004, "same", 5), (10_004, "same", 6)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, offset int"), allowMissingColumns=True)
    rows = packing.packing_query(docs).collect()
    tok = tokens.load_tokenizer(PATH)
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        start = 0
        for k, stop in enumerate(range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)):
            want[(r.doc_id, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes()))] += 1
            start = stop
        assert start == len(ids)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packing_query(docs.limit(0)).count() == 0


def test_grouping_may_win():
    rng = np.random.default_rng(8)
    histogram = {int(n): int(c) for n, c in zip(range(129, 1024), rng.integers(0, 40, 895)) if c}
    used = {g: packing.make_plan(dict(histogram), groups=g)[1] for g in packing.GROUPS}
    plan = packing.best_plan(histogram)
    assert max(p[3] + p[2] for p in plan) <= min(used.values())
    bound = -(-sum(n * c for n, c in histogram.items()) // 1024)
    assert bound <= min(used.values()) <= 1.03 * bound
