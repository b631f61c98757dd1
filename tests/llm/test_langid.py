"""Language identification: the parse against a plain one, edge texts and held-out accuracy."""

import zlib

from spooltrace.llm import langid

MODEL = langid.Model((("aa", b"the cat sat on the mat\nthe end"), ("bb", "le chat \u00e9tait l\u00e0".encode())))


def brute_phrases(text, sample, window):
    count = 0
    for w in range(0, len(text), window):
        cur = b""
        for b in text[w:w + window]:
            c = bytes([b])
            if cur + c in sample:
                cur += c
            else:
                count, cur = count + 1, c if c in sample else b""
        count += 1
    return count


def test_phrases_match_plain_parse():
    texts = [langid.normal_form(t) for t in ["The cat sat.", "le chat \u00e9tait", "zzz qqq", "the the the mat " * 200, "\u4e00\u4e8c"]]
    for window, lanes in ((8, 3), (1024, 8192)):
        got = langid.phrase_counts(texts, MODEL, window, lanes).tolist()
        assert got == [[brute_phrases(t, s, window) for _, s in MODEL.samples] for t in texts]


def test_edge_texts(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !? _ \u00b2", "x"), (4, "the cat", "y"), (None, "le chat \u00e9tait l\u00e0", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = langid.with_language(docs, MODEL).collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r.score <= 1 for r in out) and out[0].score == 0
    assert langid.predict(["the"], langid.Model(())) == (["und"], [0.0])
    assert langid.with_language(docs.limit(0), MODEL).count() == 0
    bare = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.language_query(bare).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in langid.language_query(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out]
    assert sum(out[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)


def test_prediction_ignores_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.with_language(docs, model).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.with_language(docs.drop("lang", "source"), model).collect()}
    assert a == b


def test_keep_identified_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12345 !!")], "doc_id long, text string")
    out = langid.keep_identified(docs.unionByName(junk, allowMissingColumns=True))
    assert out.columns == docs.columns and out.count() == docs.count()


def test_every_language_is_learned(spark):
    def text(k, i):  # each language has letters of its own
        return " ".join(chr(0x4e00 + 8 * k + (i + j) % 8) * 3 for j in range(40))
    rows = [(100 * k + i, text(k, i), f"l{k:03d}") for k in range(90) for i in range(9 if k < 70 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, slots=4, excerpt=64)
    assert [n for n, _ in model.samples] == sorted({r[2] for r in rows})
    assert all(s.count(b"\n") < 4 for _, s in model.samples)
    texts = [r[1] for r in rows]
    assert langid.predict(texts, model)[0] == [r[2] for r in rows]
    few = langid.learn(docs, slots=4, excerpt=64, full_languages=1)  # 256 characters for 90 languages
    assert len(few.samples) == 90 and sum(len(s.decode()) for _, s in few.samples) <= 256
