"""Toxicity: the noisy-or against brute force, edge texts, located sentences and held-out accuracy."""

import math
import zlib

import numpy as np
import pytest

from spooltrace.llm import toxicity

MODEL = toxicity.Model({"=rotten": 3.0, "rotte": 2.0, "nice": -1.0}, -3.0, 4)


def brute(text):
    keep = 1.0
    for part in [s for line in (text or "").split("\n") for s in line.replace("!", ".").replace("?", ".").split(".")]:
        words = "".join(c if c.isalnum() else " " for c in part).lower().split()
        for k in range(0, len(words), 4):
            z = -3.0
            for w in words[k:k + 4]:
                z += 3.0 * (w == "rotten") + 2.0 * (len(w) >= 5 and w[:5] == "rotte") - (len(w) >= 4 and w[:4] == "nice")
            keep *= 1 - 1 / (1 + math.exp(-z))
    return 1 - keep


TEXTS = ["", None, "...", "A day. Rotten!", "rotted and nice? nice day", "Rotter ROTTEN one two three rotten", "a b c d e f g h\n\ni",
         "İ rotten", "x " * 50000 + "rotten"]


@pytest.mark.parametrize("text", TEXTS)
def test_score_matches_brute_force(text):
    got, found = toxicity.score(text, MODEL, toxicity.WordWeights(MODEL.weights))
    assert abs(got - brute(text)) < 1e-9 and 0 <= got <= 1
    for start, end, p in found:
        assert p >= 0.5 and "rott" in text[start:end].lower()


def test_gradient_learns_the_offending_word():
    clean = ["the sky is blue. we walk home", "a quiet day in town. rain again", "books and tea. more tea"]
    words = ["alpha", "bravo", "delta", "gamma", "omega", "sigma"]
    sample = [(f"{t} {w}", 0) for t in clean for w in words] + [(f"{t} {w}. you vile {w}. bye {w}", 1) for t in clean for w in words]
    model = toxicity.fit(sample, least=2)
    table = toxicity.WordWeights(model.weights)
    assert all((toxicity.score(t, model, table)[0] >= 0.5) == y for t, y in sample)
    text = "a quiet day. you vile kappa. rain"
    _, found = toxicity.score(text, model, table)
    assert [text[i:j].strip() for i, j, _ in found] == ["you vile kappa"]


def test_edge_rows(spark):
    rows = [(1, None, "q"), (2, "", "q"), (3, "rotten rotten", "q"), (None, "nice", "q"), (3, "rotten rotten", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = toxicity.with_toxicity(docs, MODEL).collect()
    assert [r.predicted for r in out] == [0, 0, 1, 0, 1] and out[0].score == out[1].score == 0
    assert [r.held_out for r in out] == [zlib.crc32(str(i).encode()) % 5 == 0 if i else False for i, _, _ in rows]
    labels = spark.createDataFrame([(1, 1, 1), (2, None, 0), (None, 1, 1)], "doc_id long, toxic int, text int")
    none = toxicity.toxicity_query(docs, labels).collect()  # one label alone: nothing to learn
    assert {r.score for r in none} == {0.0} and len(none) == 5
    assert toxicity.toxicity_query(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity_query(docs, labels.limit(0)).count() == 5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity_query(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    toxic = [r for r in out if r.toxic == 1]
    clean = [r for r in out if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) >= 0.85 and np.mean([r.predicted for r in clean]) <= 0.02
    assert all(r.predicted == (r.score >= 0.5) for r in out)


def test_labels_are_not_inputs(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    a = {r.doc_id: r.score for r in toxicity.with_toxicity(docs, model).collect()}
    b = {r.doc_id: r.score for r in toxicity.with_toxicity(docs.drop("lang", "source", "n_chars"), model).collect()}
    assert a == b
    held = toxicity.labelled_sample(docs, labels.where(toxicity.held_out()))
    assert held == []
