"""The pipeline's stages against brute-force versions of each on its own input."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from spooltrace.llm import langid, tokens

from conftest import SF_SMALL
from test_simhash import brute_fingerprint, brute_groups


def extra_rows(spark, docs):
    rows = [(10_001, None), (10_002, ""), (10_003, "12 34 !!"), (10_004, "password = hunter22 " + "le chat est la " * 60),
            (10_004, "password = hunter22 " + "le chat est la " * 60), (None, "the of and in to that this was " * 9)]
    return docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


def repeats_text(texts, length=cp.REPEAT_BYTES):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for t, x in zip(texts, raw):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(t if t is None else bytes(b for b, g in zip(x, gone) if not g).decode(errors="ignore"))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def redacted(t):
    spans = [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}", t)] + [m.span() for m in re.finditer("[0-9a-f]{24,}", t)]
    out, at = "", 0
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out, at = out + t[at:s] + "[secret]", e
    return out + t[at:]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def key(x):
    return (x[0] is None, x[0] or 0, x[1] or "")


def test_stages_in_order(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_dedup", "suffix_dedup", "secret_scan", "best_fit_packing"]
    docs = extra_rows(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet")).cache()
    stages = dict(cp.STAGES)

    one = stages["language_id"](spark, docs, SF_SMALL)
    assert one.columns == docs.columns
    model = langid.learn(docs)
    judged = [(r, langid.predict([r.text], model)) for r in docs.collect()]
    want = [((r.doc_id, r.text), lang[0]) for r, (lang, score) in judged if lang[0] != "und" and score[0] >= 0.001]
    assert sorted([((r.doc_id, r.text), r.lang) for r in one.collect()], key=lambda x: (key(x[0]), x[1])) == \
        sorted(want, key=lambda x: (key(x[0]), x[1]))
    assert all(not (t and langid.has_letter(t)) for t in [r[1] for r in set(rows_of(docs)) - set(rows_of(one))][:3])

    one = one.cache()
    two = stages["simhash_dedup"](spark, one, SF_SMALL)
    numbered = [r for r in rows_of(one) if r[0] is not None]
    groups = brute_groups({i: brute_fingerprint(t) for i, t in numbered})
    want = sorted({i: t for i, t in numbered if groups[i] == i}.items())
    got = rows_of(two)
    assert sorted(r for r in got if r[0] is not None) == want and len(got) == len(want) + 1

    two = two.cache()
    three = stages["suffix_dedup"](spark, two, SF_SMALL).cache()
    source = rows_of(two)
    assert sorted(rows_of(three), key=key) == sorted(zip([i for i, _ in source], repeats_text([t for _, t in source])), key=key)
    assert all(r.n_chars == len(r.text) for r in three.collect())

    four = stages["secret_scan"](spark, three, SF_SMALL).cache()
    assert sorted(rows_of(four), key=key) == sorted([(i, redacted(t)) for i, t in rows_of(three)], key=key)
    assert four.columns == docs.columns

    five = stages["best_fit_packing"](spark, four, SF_SMALL).collect()
    tok = tokens.load_tokenizer(tokens.vocabulary("byte_bpe_50k.json"))
    assert sum(r.length for r in five) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows_of(four))
    assert {r.doc_id for r in five} == {i for i, _ in rows_of(four)}


def test_run(spark):
    out = cp.run(spark, SF_SMALL)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 100


@pytest.mark.parametrize("stage", range(5))
def test_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    assert cp.STAGES[stage][1](spark, docs, SF_SMALL).count() == 0


def test_ambiguous_texts_are_dropped(spark):
    model = langid.Model((("en", b"the cat and the dog"), ("fr", b"le chat et le chien")))  # samples of equal length
    docs = spark.createDataFrame([(100, "q", None), (101, "the dog", None), (102, "le chien", "en"), (103, "7", "en")],
                                 "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in langid.keep_identified(docs, model=model).collect()}
    assert kept == {101: "en", 102: "fr"}


NAMES = ["_row", "_k1", "_k2", "_kept", "_lang_pred", "_lang_score", "_lang", "_score", "_rid", "_spans", "_doc", "rid",
         "fp", "component_id", "c0", "c3", "runs", "anchors", "core", "start"]


@pytest.mark.parametrize("stage", range(4))
def test_columns_of_any_name_pass_through(spark, stage):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    more = docs.selectExpr("*", *[f"concat('{n}:', doc_id) AS `{n}`" for n in NAMES])
    name, run = cp.STAGES[stage]
    out = run(spark, more, SF_SMALL)
    assert out.columns == more.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in NAMES)
    plain = run(spark, docs, SF_SMALL).select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted(map(tuple, plain))


@pytest.mark.parametrize("setting", [None, "7", "50000"])
def test_session_setting_is_left_alone(spark, setting):
    from spooltrace.llm import common
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, None)
    try:
        spark.conf.unset(key) if setting is None else spark.conf.set(key, setting)
        before = spark.conf.get(key, None)
        out = common.materialize(common.map_batches(spark.range(20).coalesce(1), lambda batches: batches, "id long"), "setting")
        assert out.count() == 20 and spark.conf.get(key, None) == before
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
