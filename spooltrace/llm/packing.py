"""Best-fit packing by linear grouping.

Documents become token ids (each ended by ``end_id``); longer ones are cut into
full sequences, with the shorter piece first. Lengths are integers up to the
sequence size, so the histogram of lengths says all that a packing needs to
know and is bounded by the sequence size. From it the driver makes a plan:

1. large lengths, in descending order, are cut into ``groups`` groups of equal
   cardinality and rounded up to the largest length of their group;
2. few-size configurations: the fullest combination of rounded lengths around
   the largest one left (subset sums in bit sets) is used as often as the
   groups allow, until they are empty;
3. the actual lengths take the places of the rounded ones, as runs of equal
   length over runs of sequences;
4. small lengths go, longest first, into the smallest gap that fits.

Several numbers of groups are tried, and the plan with the fewest sequences is
taken: with few, rounding costs room; with as many as there are lengths, nothing
is rounded. The plan has rows (length, ranks, first sequence, offset). Pieces are numbered
within their length by a skew-safe numbering and meet the plan by an interval
join. The plan's size depends on the sequence size and ``groups``, not on the
number of documents.

Defined results: null and empty texts are one ``end_id``; a document that fills
its pieces exactly has no shorter piece; repeated rows are packed row by row;
ties are placed in any order; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.llm.common import map_batches, materialize
from spooltrace.llm.tokens import byte_level_encoder, vocabulary
from spooltrace.operators.ranking import row_number_within

SEQUENCE = 1024
END_ID = 2

Placement = tuple[int, int, int, int, int]  # length, first rank (from 0), count, first sequence, offset


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_level_encoder(path)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = enc.encode(text.as_py() or "") + end
                n = len(raw) // 4
                start = 0
                for k, stop in enumerate(range(n % size or size, n + 1, size)):
                    for col, v in zip(out, (doc, k, start, stop - start, zlib.crc32(raw[4 * start:4 * stop]))):
                        col.append(v)
                    start = stop
            types = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _equal_groups(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int, int]]]:
    """Runs (length, first rank, count) in descending order, cut into groups of equal cardinality."""
    total = sum(n for _, n in large)
    out: list[list[tuple[int, int, int]]] = []
    done = 0
    for k in range(groups):
        stop = total * (k + 1) // groups
        if stop > done:
            out.append([])
        seen = 0
        for length, n in large:
            a, b = max(done, seen), min(stop, seen + n)
            if b > a:
                out[-1].append((length, a - seen, b - a))
            seen += n
        done = stop
    return out


def _fullest(sizes: list[int], left: list[int], first: int, size: int) -> dict[int, int]:
    """Configuration around group ``first``: the available sizes whose sum comes nearest to ``size``."""
    room = size - sizes[first]
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int]] = []  # (group, sums reachable before one more item of it)
    for k in range(first, len(sizes)):
        for _ in range(min(left[k] - (k == first), room // sizes[k])):
            more = (reach | (reach << sizes[k])) & mask
            if more == reach:
                break
            steps.append((k, reach))
            reach = more
        if reach >> room & 1:
            break
    use = {first: 1}
    at = reach.bit_length() - 1
    for k, before in reversed(steps):
        if not before >> at & 1:
            use[k] = use.get(k, 0) + 1
            at -= sizes[k]
    return use


def _substitute(slots: list[list[tuple[int, int, int]]], times: int, base: int, size: int,
                plan: list[Placement], gaps: dict[int, list[tuple[int, int]]]) -> None:
    """Put runs of actual lengths on the configuration's places in ``times`` sequences from ``base``."""
    cuts = {0, times}
    for runs in slots:
        at = 0
        for _, _, n in runs:
            at += n
            cuts.add(at)
    edges = sorted(cuts)
    at = [[0, 0] for _ in slots]  # run and place in it, per slot
    for lo, hi in zip(edges, edges[1:]):
        offset = 0
        for runs, pos in zip(slots, at):
            length, rank, n = runs[pos[0]]
            plan.append((length, rank + pos[1], hi - lo, base + lo, offset))
            offset += length
            pos[1] += hi - lo
            if pos[1] == n:
                pos[0], pos[1] = pos[0] + 1, 0
        if offset < size:
            gaps.setdefault(size - offset, []).append((base + lo, hi - lo))


def _take(runs: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """The first ``n`` pieces of a group's runs, which lose them."""
    out = []
    while n:
        length, rank, have = runs[0]
        m = min(n, have)
        out.append((length, rank, m))
        n -= m
        if m == have:
            runs.pop(0)
        else:
            runs[0] = (length, rank + m, have - m)
    return out


def make_plan(histogram: dict[int, int], size: int = SEQUENCE, groups: int = 1024,
              small_share: int = 8) -> tuple[list[Placement], int]:
    """Placements for every length of the histogram, and the number of sequences."""
    plan: list[Placement] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    used = histogram.get(size, 0)
    if used:
        plan.append((size, 0, used, 0, 0))
    small_to = size // small_share
    large = sorted(((n, c) for n, c in histogram.items() if small_to < n < size and c), reverse=True)
    members = _equal_groups(large, groups)
    sizes = [runs[0][0] for runs in members]  # rounded up: the largest length of the group
    left = [sum(r[2] for r in runs) for runs in members]
    for first in range(len(sizes)):
        while left[first]:
            config = _fullest(sizes, left, first, size)
            times = min(left[k] // n for k, n in config.items())
            slots = [_take(members[k], times) for k, n in sorted(config.items()) for _ in range(n)]
            for k, n in config.items():
                left[k] -= times * n
            _substitute(slots, times, used, size, plan, gaps)
            used += times
    for length in sorted((n for n in histogram if n <= small_to), reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:  # new sequences, filled one layer after the other
                times = -(-todo // (size // length))
                gaps[size] = [(used, times)]
                used += times
                continue
            start, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            m = min(n, todo)
            plan.append((length, rank, m, start, size - gap))
            if m < n:
                gaps.setdefault(gap, []).append((start + m, n - m))
            if gap > length:
                gaps.setdefault(gap - length, []).append((start, m))
            rank, todo = rank + m, todo - m
    return plan, used


GROUPS = (128, 256, 512, 1024)


def best_plan(histogram: dict[int, int], size: int = SEQUENCE, groups: tuple[int, ...] = GROUPS) -> list[Placement]:
    """The plan with the fewest sequences among some numbers of groups (the coarser grouping wins a tie).

    More groups round less; fewer leave the configurations more pieces of one size to choose from.
    """
    plans = [make_plan(dict(histogram), size, g) for g in groups]
    return min(plans, key=lambda p: p[1])[0]


def pack(cut: DataFrame, size: int = SEQUENCE, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """``cut`` (see ``pieces``) with sequence_id and offset."""
    cut = materialize(cut, "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    plan = best_plan(histogram, size, groups)
    spark = cut.sparkSession
    placed = spark.createDataFrame(plan, "plan_length long, first_rank long, places long, first_sequence long, offset long")
    ranked = row_number_within(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], col="_rank")
    rank = F.col("_rank") - 1
    # the plan is bounded by the sequence size and the number of groups
    out = ranked.join(F.broadcast(placed), (F.col("length") == F.col("plan_length")) & (rank >= F.col("first_rank"))
                      & (rank < F.col("first_rank") + F.col("places")))
    return out.withColumn("sequence_id", F.col("first_sequence") + rank - F.col("first_rank")) \
        .select(*cut.columns, "sequence_id", "offset")


def packing_query(docs: DataFrame) -> DataFrame:
    """Every piece of every document with its place."""
    return pack(pieces(docs, vocabulary("byte_bpe_50k.json")))
