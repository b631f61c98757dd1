"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only documents are labelled. A sentence's
logit is a bias plus the weights of its words; a word carries itself and its
leading letters as features, so that inflected forms share weight. A document is
toxic if any sentence is: noisy-or, 1 - product(1 - p(sentence)). The weights
maximise the likelihood of the document labels through that rule, so the model
learns which sentences offend without being told, and ``offending`` names them.

The learner sees a bounded sample of the labelled rows that are not held out: of
each label the ``per_label`` rows of smallest id hash among those with at most
``max_chars`` characters. Its features are the ``max_features`` that separate the
labels best, counted over distinct sentences (copies of a text count once).
Scores read the whole text and nothing else.

Defined results: null and empty texts, and texts without a word, have score 0; a
document labelled several times counts once per label row; null labels and null
ids are not learned from, and a null id is not held out; without both labels in
the sample every score is 0; repeated rows are scored alike; sentences of more
than ``longest`` words are cut into runs of that many; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spooltrace.llm.common import map_batches

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 1 << 18


def features(word: str) -> list[str]:
    """The word, marked, and its first three, four and five letters."""
    return ["=" + word, *(word[:k] for k in (3, 4, 5) if len(word) >= k)]


def sentences(text: str, longest: int = 64) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of every run of at most ``longest`` words that no sentence mark interrupts."""
    for m in _SENTENCE.finditer(text):
        words = _WORD.findall(m[0])
        if not words:
            continue
        if len(words) <= longest:
            yield m.start(), m.end(), words
            continue
        spans = [w.span() for w in _WORD.finditer(m[0])]
        for k in range(0, len(words), longest):
            last = min(k + longest, len(words)) - 1
            yield m.start() + spans[k][0], m.start() + spans[last][1], words[k:last + 1]


@dataclass(frozen=True)
class Model:
    """Feature weights and the logit of a sentence without any; no weights: nothing was learned."""
    weights: dict[str, float]
    bias: float
    longest: int = 64

    @property
    def learned(self) -> bool:
        return bool(self.weights)


class WordWeights(dict):
    """Weight by word, worked out when first asked for; emptied when it holds too many words."""

    def __init__(self, weights: dict[str, float]):
        self.of = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        get = self.of.get
        out = self[word] = sum(get(f, 0.0) for f in features(word.lower()))
        return out


def _survival(logit: float) -> float:
    """log(1 - p) of a sentence."""
    return -(max(logit, 0.0) + math.log1p(math.exp(-abs(logit))))


def score(text: str | None, model: Model, words: WordWeights) -> tuple[float, list[tuple[int, int, float]]]:
    """(noisy-or of the sentences, the offending sentences' spans and probabilities)."""
    if not text or not model.learned:
        return 0.0, []
    rest, plain, found = 0.0, 0, []
    weight = words.__getitem__
    for start, end, tokens in sentences(text, model.longest):
        z = sum(map(weight, tokens))
        if z == 0.0:
            plain += 1
            continue
        z += model.bias
        rest += _survival(z)
        if z >= 0.0:
            found.append((start, end, 1.0 / (1.0 + math.exp(-z))))
    rest += plain * _survival(model.bias)
    return -math.expm1(rest), found


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = 1536, max_chars: int = 20000) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_label`` rows of each label, in a fixed order."""
    marked = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"), F.xxhash64(F.lit("mil"), "doc_id").alias("h"))
    parts = [marked.where(F.col("y") == y).orderBy("h", "id").limit(per_label * 2) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 4 * per_label rows of three numbers
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).select(
        F.col("doc_id").alias("id"), "text")
    rows = [r for y in (0, 1) for r in texts.join(F.broadcast(chosen.where(F.col("y") == y)), "id")
            .orderBy("h", "id", "text").limit(per_label).collect()]
    return [(r.text, r.y) for r in rows]


def choose_features(bags: list[list[frozenset[str]]], labels: list[int], max_features: int, least: int) -> list[str]:
    """Features by the deviation of their log odds, counted over distinct sentences of each label."""
    seen: tuple[set, set] = (set(), set())
    for bag, y in zip(bags, labels):
        seen[y].update(bag)
    counts = [Counter(f for s in seen[y] for f in s) for y in (0, 1)]
    total = [len(seen[y]) + 1 for y in (0, 1)]
    ranked = []
    for f in counts[1].keys() | counts[0].keys():
        pos, neg = counts[1][f], counts[0][f]
        if pos + neg >= least:
            odds = math.log((pos + 0.5) / total[1]) - math.log((neg + 0.5) / total[0])
            ranked.append((-abs(odds) / math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)), f))
    return [f for _, f in sorted(ranked)[:max_features]]


def fit(sample: list[tuple[str, int]], max_features: int = 256, least: int = 4, rounds: int = 200,
        prior: float = 0.02, rate: float = 0.1, longest: int = 64) -> Model:
    """Weights that maximise the noisy-or likelihood of the document labels (Adam on the whole sample)."""
    labels = [y for _, y in sample]
    if len(set(labels)) < 2:
        return Model({}, 0.0, longest)
    tokens = [[[w.lower() for w in words] for _, _, words in sentences(t, longest)] for t, _ in sample]
    bags = [[frozenset(f for w in s for f in features(w)) for s in doc] for doc in tokens]
    names = choose_features(bags, labels, max_features, least)
    del bags
    index = {f: k for k, f in enumerate(names)}
    of, entry_sentence, entry_feature, n = [], [], [], 0
    for d, doc in enumerate(tokens):
        for s in doc:
            of.append(d)
            hits = [index[f] for w in s for f in features(w) if f in index]
            entry_feature += hits
            entry_sentence += [n] * len(hits)
            n += 1
    owner = np.array(of, np.int64)
    rows, cols = np.array(entry_sentence, np.int64), np.array(entry_feature, np.int64)
    y = np.array(labels, float)
    weights = np.zeros(len(names) + 1)
    weights[-1] = -4.0
    moment, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        z = np.bincount(rows, weights[cols], n) + weights[-1]
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(owner, -np.logaddexp(0, z), len(y))  # log of the product
        toxic = -np.expm1(clean)
        pull = np.where(y == 1, np.exp(clean) / np.maximum(toxic, 1e-12), -1.0)
        by_sentence = pull[owner] * p / len(y)
        grad = np.append(np.bincount(cols, by_sentence[rows], len(names)), by_sentence.sum())
        grad[:-1] -= prior / len(y) * weights[:-1]
        moment = 0.9 * moment + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        weights += rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return Model({f: float(w) for f, w in zip(names, weights)}, float(weights[-1]), longest)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()),
                  ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])


def with_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (spans of sentences with a score of 0.5 or more)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordWeights(model.weights)
        for b in batches:
            scores, spans = [], []
            for text in b.column(2):
                s, found = score(text.as_py(), model, words)
                scores.append(s)
                spans.append([{"start": i, "end": j, "score": p} for i, j, p in found])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                 pa.array(spans, _OUT.field("offending").type)], schema=_OUT)

    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int, "
                                  "offending array<struct<start:int,end:int,score:double>>")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document, then how many sentences offend and where the worst is."""
    out = with_toxicity(docs, fit(labelled_sample(docs, labels)))
    worst = F.get(F.array_sort("offending", lambda a, b: F.when(a["score"] > b["score"], -1).when(
        a["score"] < b["score"], 1).otherwise(F.when(a["start"] < b["start"], -1).otherwise(1))), F.lit(0))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"),
                      worst["start"].alias("worst_start"), worst["end"].alias("worst_end"))
