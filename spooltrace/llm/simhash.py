"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits; the vector of
their bit counts is the embedding. Changing one bit moves one coordinate by
one, so the Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints. Links have at most ``max_bits`` differing bits,
so over ``groups`` groups of coordinates at least ``groups - max_bits`` groups
agree exactly: the grid join meets each pair in the cell of some choice of that
many groups. Inside a cell the Manhattan bound is tested first, then the exact
bit distance.

Equal fingerprints are collapsed before the grid, so copies cost nothing. Cells
with more than ``chunk`` different fingerprints are cut into pairs of chunks,
each a task of bounded size. A cell returns a spanning forest of its links, not
all pairs, and components are found by star rounds.

Defined results: null and empty texts (and texts of white space only) have
fingerprint zero and link like any other; repeated rows each get their row; a
null id is ignored when the smallest id of a component is taken; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.llm.common import at, map_batches, materialize, positional
from spooltrace.llm.components import connected_components

SEED = 42
_PAIRS = 0x5555555555555555
_BLOCK = 1 << 16  # shingles counted at a time


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the whole text, as a signed integer."""
    words = (text or "").encode().lower().split()  # lower-cases A-Z, splits on \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    first, last = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(first), _BLOCK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(first[i:i + _BLOCK], last[i:i + _BLOCK])], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0]
    return int(value.astype(np.int64))


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def grid_masks(max_bits: int, groups: int) -> list[int]:
    """Bit masks of the embedding's coordinates for every choice of ``groups - max_bits`` coordinate groups."""
    if not max_bits < groups <= 32:
        raise ValueError("groups must exceed max_bits and not exceed the 32 segments")
    cuts = [32 * g // groups for g in range(groups + 1)]
    masks = [sum(3 << (2 * s) for s in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(masks, groups - max_bits)]


def _embed(fp: np.ndarray) -> np.ndarray:
    """Packed embedding: 32 two-bit counts."""
    m = np.uint64(_PAIRS)
    return (fp & m) + ((fp >> np.uint64(1)) & m)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings (counts 0 to 2)."""
    m = np.uint64(_PAIRS)
    one = np.uint64(1)
    # a count c is turned to thermometer code of c ones; differing ones then add up to the distance
    ta = ((a | (a >> one)) & m) | ((a & ~m))
    tb = ((b | (b >> one)) & m) | ((b & ~m))
    return np.bitwise_count(ta ^ tb)


def _linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs within ``max_bits``: the lower bound first, the exact distance on what it leaves."""
    ok = _manhattan(_embed(a), _embed(b)) <= max_bits
    a, b = np.broadcast_arrays(a, b)
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= max_bits
    return ok


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among one cell's fingerprints, by search among those not yet reached."""
    out, left = [], fp
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            node = front.pop()
            hit = _linked(np.uint64(node), left, max_bits)
            if hit.any():
                found, left = left[hit], left[~hit]
                out.append((np.full(len(found), node, np.uint64), found))
                front.extend(found)
    return out


def _cell_links(batches: Iterator[pa.RecordBatch], max_bits: int, small: int = 8) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal ``cell`` in a sorted partition; a run may span batches."""
    def solve(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        sizes = np.diff(np.append(starts, len(cell)))
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        run_size = np.repeat(sizes, sizes)
        place = np.arange(len(cell)) - np.repeat(starts, sizes)
        for k in range(1, small):  # all pairs of small cells, k places apart
            i = np.flatnonzero((run_size <= small) & (place + k < run_size))
            if len(i):
                ok = _linked(fp[i], fp[i + k], max_bits)
                pairs.append((fp[i][ok], fp[i + k][ok]))
        for s, n in zip(starts[sizes > small], sizes[sizes > small]):
            pairs.extend(_forest(np.unique(fp[s:s + n]), max_bits))
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.uint64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])

    cell, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        cell = np.concatenate((cell, batch.column(0).to_numpy()))
        fp = np.concatenate((fp, batch.column(1).to_numpy().astype(np.uint64)))
        if not len(cell) or cell[0] == cell[-1]:
            continue
        cut = np.searchsorted(cell, cell[-1])  # sorted: the last run may go on
        yield solve(cell[:cut], fp[:cut])
        cell, fp = cell[cut:], fp[cut:]
    if len(cell):
        yield solve(cell, fp)


def fingerprint_links(distinct: DataFrame, max_bits: int = 4, groups: int = 7, chunk: int = 4096) -> DataFrame:
    """(a, b): links that connect every component of ``distinct.fp`` under the bit distance."""
    x, y = f"(fp & {_PAIRS}L)", f"(shiftrightunsigned(fp, 1) & {_PAIRS}L)"
    embedding = F.expr(f"({x} ^ {y}) | shiftleft({x} & {y}, 1)")  # the two-bit sums, without carries
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("emb").bitwiseAND(F.lit(_signed(m))))
                     for i, m in enumerate(grid_masks(max_bits, groups))])
    cells = distinct.select("fp", embedding.alias("emb")).select("fp", F.explode(keys).alias("cell"))
    large = (cells.groupBy("cell").count().where(F.col("count") > chunk)
             .select("cell", F.ceil(F.col("count") / chunk).cast("int").alias("parts")))
    marked = cells.join(large, "cell", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1),
                         lambda j: F.xxhash64("cell", F.least(j, mine), F.greatest(j, mine)))
    units = marked.select("fp", F.explode(F.when(F.col("parts").isNull(), F.array("cell")).otherwise(others))
                          .alias("cell")).select("cell", "fp")
    placed = units.repartition("cell").sortWithinPartitions("cell", "fp")
    return map_batches(placed, lambda it: _cell_links(it, max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, groups: int = 7,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable by links of at most ``max_bits`` bits."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(fingerprint_links(distinct, max_bits, groups))
    owned = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("root", F.coalesce("root", "fp")))
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialize(owned.join(least, "root").select("fp", "component_id"), "simhash")
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in 16 hex digits, component_id for every document."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without near-duplicates: each component keeps one row (of its smallest id).

    Equal ids are told apart by a row key, so repeated rows leave one row too. Columns of any name pass through.
    """
    doc, text = at(docs, id_col), at(docs, text_col)
    keyed = materialize(positional(docs).withColumn("_row", F.struct(
        F.col(doc).isNull().alias("n"), F.col(doc).alias("i"), F.monotonically_increasing_id().alias("r"))), "dedup")
    groups = near_duplicates(keyed, shingle, max_bits, id_col="_row", text_col=text)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.r").alias("_keep"))
    left = keyed.join(kept.hint("shuffle_hash"), F.col("_row.r") == F.col("_keep"), "left_semi")
    return left.drop("_row").toDF(*docs.columns)
