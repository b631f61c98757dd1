"""Quality rules by learned decision lists.

Whole-text statistics are computed with native functions. Sequential covering
(grow by information gain, prune on a held-back part) learns an ordered list of
threshold conjunctions from labelled statistics; the list becomes one Spark
``CASE WHEN`` expression.

The learner sees a bounded sample: at most ``max_labelled`` labelled documents
that pass the base rules, those with the smallest seeded hash of their id. The
statistics themselves, the base rules and the verdict cover every document.

Defined results: null and empty texts have zero words and fail the base rules;
without usable labels the list is empty and the base rules decide alone; a
document labelled several times counts once per label row; repeated documents
are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spooltrace.llm.common import let, materialize

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share")


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice in the text.

    Window hashes are sorted with their positions, equal neighbours mark
    repeated windows, and the marked positions' runs are measured: n log n in
    the length of the text.
    """
    def windows(ws: Column) -> Column:
        return F.transform(
            F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p")))

    def repeated(s: Column) -> Column:
        return F.sort_array(F.transform(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"), lambda a, x: a + x)

    return let(words, lambda ws: let(F.sort_array(windows(ws)), lambda s: let(repeated(s), covered)))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    counts = let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), _repeat_words(ws).alias("r")))
    return docs.select(
        F.col(id_col).alias("doc_id"), counts.alias("_c"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", F.col("_c.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
             F.col("_c.r").alias("n_repeat_words"))


def with_features(stats: DataFrame) -> DataFrame:
    """Ratios that the learned conditions test, and the base verdict."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (stats
            .withColumn("mean_word_chars", F.col("word_chars") / n)
            .withColumn("symbols_per_word", F.col("n_symbols") / n)
            .withColumn("dup_line_share", F.col("n_dup_lines") / n)
            .withColumn("repeat_share", F.col("n_repeat_words") / n)
            .withColumn("base_failed", (F.col("n_words") < 50)
                        | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        c = F.col(self.feature).cast("double")
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _gain(kept: list[dict], of: list[dict]) -> float:
    p0, p1 = sum(r["bad"] for r in of), sum(r["bad"] for r in kept)
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / len(kept)) - math.log2(p0 / len(of)))


def _thresholds(rows: list[dict], feature: str, steps: int) -> list[float]:
    values = sorted({r[feature] for r in rows})
    cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
    if len(cuts) <= steps:
        return cuts
    return [cuts[i * (len(cuts) - 1) // (steps - 1)] for i in range(steps)]


def _grow(rows: list[dict], features: tuple[str, ...], steps: int, max_conditions: int) -> Rule:
    rule: Rule = ()
    inside = rows
    while len(rule) < max_conditions and any(not r["bad"] for r in inside):
        options = [(Condition(f, above, t)) for f in features for t in _thresholds(inside, f, steps)
                   for above in (True, False)]
        scored = [(_gain(_covered((c,), inside), inside), c) for c in options]
        best = max(scored, key=lambda x: x[0], default=(0.0, None))
        if best[0] <= 0:
            break
        rule += (best[1],)
        inside = _covered((best[1],), inside)
    return rule


def _worth(rule: Rule, rows: list[dict]) -> float:
    inside = _covered(rule, rows)
    bad = sum(r["bad"] for r in inside)
    return (2 * bad - len(inside)) / len(inside) if inside else -1.0


def learn_decision_list(rows: list[dict], features: tuple[str, ...] = FEATURES, min_precision: float = 0.9,
                        max_rules: int = 8, max_conditions: int = 3, steps: int = 24) -> list[Rule]:
    """Ordered conjunctions that mark bad documents, learned by sequential covering.

    ``rows`` hold the features, ``bad`` (bool) and ``prune`` (bool: held back for
    pruning). A grown rule loses trailing conditions while that does not lower
    its worth on the pruning part; learning ends with the first rule whose
    precision there is below ``min_precision``.
    """
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        grow, prune = [r for r in left if not r["prune"]], [r for r in left if r["prune"]]
        if not any(r["bad"] for r in grow) or not any(not r["bad"] for r in grow):
            break
        rule = _grow(grow, features, steps, max_conditions)
        if not rule:
            break
        best = max(range(len(rule), 0, -1), key=lambda k: _worth(rule[:k], prune))
        rule = rule[:best]
        inside = _covered(rule, prune)
        if not inside or sum(r["bad"] for r in inside) < min_precision * len(inside):
            break
        rules.append(rule)
        left = _outside(rule, left)
    return rules


def _outside(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if not all(c.holds(r) for c in rule)]


def decision_column(rules: list[Rule]) -> Column:
    """1-based number of the first rule that holds, 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_sample(features: DataFrame, labels: DataFrame, max_labelled: int, seed: int,
                    label_col: str = "quality") -> list[dict]:
    """At most ``max_labelled`` labelled documents that pass the base rules (smallest seeded hashes of the id)."""
    lab = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IS NOT NULL")
    h = F.xxhash64(F.lit(seed), "doc_id")
    rows = (features.where(~F.col("base_failed")).join(lab, "doc_id")
            .select("label", h.alias("h"), "doc_id", *[F.col(f).cast("double").alias(f) for f in FEATURES])
            .orderBy("h", "doc_id", "label", *FEATURES).limit(max_labelled).collect())
    return [{**{f: r[f] for f in FEATURES}, "bad": r["label"] == 0, "prune": r["h"] % 3 == 0} for r in rows]


def quality_verdicts(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, seed: int = 7) -> DataFrame:
    """One row per document: statistics, base_failed, kept and the number of the rule that rejected it."""
    features = with_features(materialize(text_statistics(docs), "quality"))
    rules = learn_decision_list(labelled_sample(features, labels, max_labelled, seed))
    return (features.withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(decision_column(rules)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "rule"))
