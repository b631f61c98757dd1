"""Language identification by cross-parsing entropy.

For every language a suffix automaton holds its labelled sample. A text is
parsed greedily into the longest phrases that occur in that sample; few phrases
mean that text and sample share their statistics. A phrase costs about
log2(sample length) bits, so phrases times that, per byte of text, estimates
the cross entropy; the language with the least wins.

Whole texts are parsed, in windows of ``window`` bytes (a phrase ends at a
window's end) that advance together as array lanes: one table look-up per byte
and language.

The labelled sample is bounded, and every language has its share: ``slots``
labelled documents (the one with the smallest id hash in each of ``slots`` hash
classes), ``excerpt`` characters of each, for up to ``full_languages`` languages.
More languages divide the same total, first by fewer documents, then by shorter
excerpts. Only
``text`` and ``lang`` of rows that are not held out are learned from, and a
prediction reads the text alone.

Defined results: null texts and texts without a letter are ``und`` with score 0;
with nothing to learn from, every text is ``und``; ties go to the smaller
language name; a null id counts as not held out; repeated rows are predicted row
by row; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spooltrace.llm.common import at, map_batches, positional

UND = "und"
_WORDISH = re.compile(r"[^\W\d_]")
# ASCII other than letters becomes a space, so digits, marks and separators carry no language
_KEEP_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    """Labelled samples by language: excerpts in normal form, joined by line feeds (which no text contains)."""
    samples: tuple[tuple[str, bytes], ...]


def normal_form(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_KEEP_LETTERS).split())


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDISH.finditer(text))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, slots: int = 64, excerpt: int = 384, full_languages: int = 64, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> Model:
    """Bounded labelled sample of the rows that are not held out."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.lit("sample"), F.col(id_col)).alias("h"))
    share = full_languages * slots * excerpt // max(1, rows.select("lang").distinct().count())
    slots, excerpt = max(1, min(slots, share // excerpt)), max(1, min(excerpt, share))
    slot = F.pmod("h", F.lit(slots)).alias("slot")
    chosen = rows.groupBy("lang", slot).agg(F.min("h").alias("h")).collect()
    size = F.length("text")
    start = F.pmod(F.xxhash64("h"), F.greatest(size - excerpt, F.lit(1))).cast("int") + 1
    wanted = rows.where(F.col("h").isin([r.h for r in chosen]))
    texts = (wanted.groupBy("lang", "h").agg(F.min(F.substring("text", start, F.lit(excerpt))).alias("t")).collect())
    keep = {(r.lang, r.h) for r in chosen}
    by: dict[str, list[bytes]] = {}
    for r in sorted(texts, key=lambda r: (r.lang, r.h)):
        if (r.lang, r.h) in keep and (n := normal_form(r.t)):
            by.setdefault(r.lang, []).append(n)
    return Model(tuple((lang, b"\n".join(x)) for lang, x in sorted(by.items())))


def suffix_automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``sample``; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sample:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = cur
    return nxt


@functools.lru_cache(maxsize=1)
def _tables(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(byte codes, step table, root of each language, bits per phrase).

    An entry of the step table holds the next state's offset times two, plus one
    if the byte could not extend the phrase and a new one began.
    """
    seen = sorted({b for _, s in model.samples for b in s if b != 10})
    codes = np.zeros(256, np.int32)  # code 0: a byte that no sample has
    codes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    parts, roots, bits, base = [], [], [], 0
    for _, sample in model.samples:
        states = suffix_automaton(sample)
        table = np.zeros((len(states), width), np.int32)
        for s, moves in enumerate(states):
            for c, to in moves.items():
                if c != 10:
                    table[s, codes[c]] = to
        fresh = (table[0] * width + base) * 2 + 1  # a new phrase starts with this byte
        table = np.where(table > 0, (table * width + base) * 2, fresh).astype(np.int32)
        parts.append(table.ravel())
        roots.append(base)
        bits.append(np.log2(len(sample) + 1))
        base += table.size
    return codes, np.concatenate(parts), np.array(roots, np.int32), np.array(bits)


def phrase_counts(texts: list[bytes], model: Model, window: int = 1024, lanes: int = 8192) -> np.ndarray:
    """Phrases of every text against every language's sample: an array (texts, languages)."""
    codes, step, roots, _ = _tables(model)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    per = -(-sizes // window)
    owner = np.repeat(np.arange(len(texts)), per)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(np.cumsum(sizes) - sizes, per) + first * window
    size = np.minimum(sizes[owner] - first * window, window)
    flat = codes[np.frombuffer(b"".join(texts), np.uint8)]
    order = np.argsort(-size, kind="stable")
    lanes = max(1, min(lanes, lanes * 64 // len(roots)))  # many languages advance fewer windows together
    out = np.zeros((len(texts), len(roots)), np.int64)
    for i in range(0, len(order), lanes):
        w = order[i:i + lanes]
        n, at, of = size[w], begin[w], owner[w]
        state = np.repeat(roots[:, None], len(w), axis=1)
        count = np.zeros(state.shape, np.int32)
        for j in range(int(n[0])):
            live = np.searchsorted(-n, -j, side="left")  # windows longer than j, in order of size
            entry = step.take(state[:, :live] + flat[at[:live] + j])
            count[:, :live] += entry & 1
            state[:, :live] = entry >> 1
        count += 1  # the phrase that is open at the end
        for k in range(len(roots)):
            out[:, k] += np.bincount(of, weights=count[k], minlength=len(texts)).astype(np.int64)
    return out


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Language and score (relative margin to the next language, 0 to 1) of every text."""
    lang, score = [UND] * len(texts), [0.0] * len(texts)
    use = [i for i, t in enumerate(texts) if t and model.samples and has_letter(t)]
    if use:
        names = [n for n, _ in model.samples]
        forms = [normal_form(texts[i]) for i in use]
        cost = phrase_counts(forms, model) * _tables(model)[3]
        best = cost.argmin(axis=1)
        least = cost.min(axis=1)
        cost[np.arange(len(use)), best] = np.inf
        margin = 1 - least / cost.min(axis=1)  # one language alone: 1
        for i, b, m in zip(use, best.tolist(), margin.tolist()):
            lang[i], score[i] = names[b], m
    return lang, score


def with_language(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred",
                  score_col: str = "score", max_bytes: int = 1 << 22) -> DataFrame:
    """``docs`` with predicted language and score (columns of those names are replaced)."""
    rows = docs.drop(lang_col, score_col)
    names = [*rows.columns, lang_col, score_col]
    at = names.index(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(lang_col, T.StringType()),
                           T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = held = 0
            for hi, size in enumerate(pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist(), 1):
                held += size
                if held >= max_bytes or hi == len(b):
                    part = b.slice(lo, hi - lo)
                    lang, score = predict(part.column(at).to_pylist(), model)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                     names=names)
                    lo, held = hi, 0

    return map_batches(rows, run, schema)


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learned from those not held out."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return with_language(rows, learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.001, text_col: str = "text", lang_col: str = "lang",
                    model: Model | None = None) -> DataFrame:
    """Rows of ``docs`` whose language is identified with a score of at least ``min_score``, with that language in ``lang_col``.

    A lower score means that two languages explain the text equally well. Columns of any name pass through.
    """
    model = model or learn(docs, text_col=text_col, lang_col=lang_col)
    out = with_language(positional(docs), model, text_col=at(docs, text_col), lang_col="_lang", score_col="_score")
    out = out.where((F.col("_lang") != UND) & (F.col("_score") >= min_score)).withColumn(at(docs, lang_col), F.col("_lang"))
    return out.drop("_lang", "_score").toDF(*docs.columns)
