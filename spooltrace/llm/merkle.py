"""Merkle manifest of a table in a van Emde Boas layout.

Each row is a leaf. The leaves of a group (a language) stand in id order and are
cut into aligned subtrees of ``height`` levels. A subtree is one row of a stored
table, its nodes one binary array in van Emde Boas order: the top half of the
levels first, then the lower subtrees left to right, each laid out likewise.
``address`` finds a node by arithmetic alone, so neither building a subtree nor
reading a leaf's siblings needs pointers or an index. The roots of the subtrees
are the leaves of the next level of subtrees, until a group has one node left;
the groups' roots form one more such forest. Siblings are read top down: a
subtree's own path is known before those of its leaves.

Work per task is one subtree (``2 ** height`` leaves); a level needs one
shuffle on (group, subtree), so a group may hold any share of the rows.

Defined results: null values count as ``-``; among equal ids leaves ascend by
digest, null ids come first; equal rows are leaves of their own; rows with a
null group form the first group; a null id is never altered; ``n_chars`` that
is null stays null when altered; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spooltrace.llm.common import map_batches, materialize
from spooltrace.operators.ranking import row_number_global, row_number_within

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIZE = 32  # bytes of a digest
NONE, RIGHT, LEFT = 0, 1, 2  # where a step's sibling stands


def join_digests(*nodes: bytes) -> bytes:
    """Digest of the nodes' hexadecimal texts, one after another."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def address(depth: np.ndarray, index: np.ndarray, levels: int) -> np.ndarray:
    """Place of node ``index`` of ``depth`` (the root has 0) in the layout of a tree of ``levels`` levels."""
    depth, index = np.asarray(depth), np.asarray(index)
    if levels <= 1:
        return np.zeros(np.broadcast(depth, index).shape, np.int64)
    top = levels // 2
    low = levels - top
    below = np.maximum(depth - top, 0)
    subtree = index >> below
    start = (1 << top) - 1 + subtree * ((1 << low) - 1)
    inner = index & ((1 << below) - 1)
    return np.where(depth < top,
                    address(np.minimum(depth, top - 1), np.where(depth < top, index, 0), top),
                    start + address(below, inner, low))


@functools.lru_cache(maxsize=64)
def layout(bits: int) -> list[list[int]]:
    """Addresses by height over the leaves (0: the leaves, ``bits``: the root) and index."""
    return [address(np.full(1 << (bits - up), bits - up), np.arange(1 << (bits - up)), bits + 1).tolist()
            for up in range(bits + 1)]


def build_subtree(leaves: list[bytes], bits: int) -> bytearray:
    """Nodes of a subtree of ``bits`` steps from leaf to root; a run's lone last node is digested alone."""
    nodes = bytearray(SIZE * ((2 << bits) - 1))
    row = leaves
    for up, places in enumerate(layout(bits)):
        if up:
            row = [join_digests(*row[i:i + 2]) for i in range(0, len(row), 2)]
        for at, node in zip(places, row):
            nodes[SIZE * at:SIZE * (at + 1)] = node
    return nodes


def siblings(nodes: bytes, n_leaves: int, bits: int, leaf: int) -> bytes:
    """Steps from a leaf to the subtree's root: a byte that says where the sibling stands, then the sibling."""
    steps, index, count = [], leaf, n_leaves
    for places in layout(bits)[:bits]:
        other = index ^ 1
        if other < count:
            at = SIZE * places[other]
            steps.append(bytes((LEFT if index & 1 else RIGHT,)) + nodes[at:at + SIZE])
        else:
            steps.append(bytes((NONE,)) + bytes(SIZE))
        index, count = index >> 1, (count + 1) >> 1
    return b"".join(steps)


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for i in range(0, len(path), SIZE + 1):
        side, other = path[i], path[i + 1:i + 1 + SIZE]
        node = join_digests(node) if side == NONE else join_digests(node, other) if side == RIGHT else join_digests(other, node)
    return node


def proof_digest(path: bytes) -> bytes:
    return join_digests(*(path[i + 1:i + 1 + SIZE] for i in range(0, len(path), SIZE + 1) if path[i] != NONE))


@dataclass(frozen=True)
class Forest:
    """Stored subtrees by level, the leaves' level first, and each group's root."""
    levels: list[DataFrame]  # grp, block, ids, altered, n_leaves, bits, nodes, is_top
    roots: DataFrame  # grp, root
    height: int


_LEVEL = ("grp string, block long, ids array<long>, altered array<binary>, "
          "n_leaves int, bits int, nodes binary, root binary, is_top boolean")


def _build(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grp, block, items in zip(*(c.to_pylist() for c in b.columns)):
                leaves = [x["node"] for x in items]
                whole = block > 0 or len(leaves) == 1 << height  # the group may go on above
                bits = height if whole else (len(leaves) - 1).bit_length()
                nodes = build_subtree(leaves, bits)
                at = SIZE * layout(bits)[bits][0]
                yield pa.RecordBatch.from_pylist([{
                    "grp": grp, "block": block, "ids": [x["id"] for x in items],
                    "altered": [x["altered"] for x in items], "n_leaves": len(leaves), "bits": bits,
                    "nodes": bytes(nodes), "root": bytes(nodes[at:at + SIZE]), "is_top": not whole}], schema=_ARROW)
    return run


_ARROW = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())),
                    ("altered", pa.list_(pa.binary())), ("n_leaves", pa.int32()), ("bits", pa.int32()),
                    ("nodes", pa.binary()), ("root", pa.binary()), ("is_top", pa.bool_())])


def build_forest(leaves: DataFrame, height: int = 10) -> Forest:
    """Subtrees over (grp, pos, node, id, altered), where ``pos`` counts a group's leaves from 0."""
    levels, current = [], leaves
    while True:
        blocks = current.groupBy("grp", F.shiftright("pos", height).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "node", "id", "altered"))).alias("items"))  # at most 2 ** height
        level = materialize(map_batches(blocks, _build(height), _LEVEL), "merkle")
        levels.append(level)
        rest = level.where("NOT is_top")
        if rest.isEmpty():
            break
        current = rest.select("grp", F.col("block").alias("pos"), F.col("root").alias("node"),
                              F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("altered"))
    tops = [level.where("is_top").select("grp", "root") for level in levels]
    return Forest(levels, functools.reduce(DataFrame.unionByName, tops), height)


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path of every leaf of every subtree: its siblings here, then the subtree's own path."""
    for b in batches:
        for r in b.to_pylist():
            base = r["block"] << r["height"]
            yield pa.RecordBatch.from_pylist(
                [{"grp": r["grp"], "pos": base + i, "id": r["ids"][i],
                  "path": siblings(r["nodes"], r["n_leaves"], r["bits"], i) + r["path"],
                  "subroot": r["subroot"], "root": r["root"]} for i in range(r["n_leaves"])], schema=_PATHS)


_PATHS = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("id", pa.int64()), ("path", pa.binary()),
                    ("subroot", pa.binary()), ("root", pa.binary())])
_PATHS_DDL = "grp string, pos long, id long, path binary, subroot binary, root binary"


def with_paths(forest: Forest, above: DataFrame) -> DataFrame:
    """The leaves' subtrees with the path from each subtree's root: ``above`` gives (grp, path, subroot, root)."""
    below = None
    for level in reversed(forest.levels):
        top = level.where("is_top").drop("root").join(above, "grp")  # one subtree a group
        mid = level.where("NOT is_top").drop("root")
        rows = top if below is None else top.unionByName(
            mid.join(below.select("grp", F.col("pos").alias("block"), "path", "subroot", "root"), ["grp", "block"]))
        rows = rows.withColumn("height", F.lit(forest.height))
        if level is forest.levels[0]:
            return rows
        below = materialize(map_batches(rows, _descend, _PATHS_DDL), "paths")
    raise AssertionError("a forest has a level")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            out = []
            root = r["root"].hex()
            leaf_places = layout(r["bits"])[0]
            for i, (doc, altered) in enumerate(zip(r["ids"], r["altered"])):
                at = SIZE * leaf_places[i]
                leaf = r["nodes"][at:at + SIZE]
                path = siblings(r["nodes"], r["n_leaves"], r["bits"], i) + r["path"]
                folded = fold(leaf if altered is None else altered, path).hex()
                out.append({"doc_id": doc, "leaf": leaf.hex(), "subroot": r["subroot"].hex(), "root": root,
                            "proof_sha256": proof_digest(path).hex(), "folded_root": folded,
                            "verified": folded == root, "position": (r["block"] << r["height"]) + i,
                            "n_steps": len(path) // (SIZE + 1)})
            yield pa.RecordBatch.from_pylist(out, schema=_VERDICT)


_VERDICT = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                      ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()),
                      ("position", pa.int64()), ("n_steps", pa.int32())])
_VERDICT_DDL = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
                "verified boolean, position long, n_steps int")


def leaf_digest(values: list[Column]) -> Column:
    """Digest of the values: ``-`` for null, else byte count, colon, value."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(part, values)).cast("binary"), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(grp, id, node, altered): one leaf a row; ``altered`` is the digest after tampering, where there is any."""
    c = {f: F.col(f) for f in FIELDS}
    more = c | {"n_chars": c["n_chars"].cast("decimal(20,0)") + 1}
    tampered = F.crc32(c["doc_id"].cast("string").cast("binary")) % 7 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"),  # null first, then by the bytes of lang
        c["doc_id"].cast("long").alias("id"), leaf_digest(list(c.values())).alias("node"),
        F.when(tampered, leaf_digest(list(more.values()))).alias("altered"))


@dataclass(frozen=True)
class Manifest:
    documents: Forest  # one group a language
    languages: Forest  # one group, whose leaves are the languages' roots


def build_manifest(docs: DataFrame, height: int = 10) -> tuple[Manifest, DataFrame]:
    """The stored forests and the languages' leaves (grp, pos, node) of the upper one."""
    leaves = row_number_within(document_leaves(docs), ["grp"], ["id", "node"], col="pos")
    lower = build_forest(leaves.withColumn("pos", F.col("pos") - 1), height)
    named = row_number_global(lower.roots, ["grp"], col="pos", start=0)
    upper = build_forest(named.select(F.lit("").alias("grp"), "pos", F.col("root").alias("node"), F.col("pos").alias("id"),
                                      F.lit(None).cast("binary").alias("altered")), height)
    return Manifest(lower, upper), named


def verify_documents(docs: DataFrame, height: int = 10) -> DataFrame:
    """Every document's leaf, roots, proof digest and the root that its (perhaps altered) leaf folds to."""
    manifest, named = build_manifest(docs, height)
    start = manifest.languages.roots.select("grp", F.lit(b"").alias("path"), F.col("root").alias("subroot"), "root")
    paths = map_batches(with_paths(manifest.languages, start), _descend, _PATHS_DDL)
    above = named.join(paths.select(F.col("id").alias("pos"), "path", F.col("root").alias("whole")), "pos").select(
        "grp", "path", F.col("root").alias("subroot"), F.col("whole").alias("root"))
    return map_batches(with_paths(manifest.documents, materialize(above, "groups")), _verify, _VERDICT_DDL)


def manifest_query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document, then its position and the steps of its proof."""
    return verify_documents(docs)


MERKLE_SQL = """
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
parts AS (
    SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
        || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
        || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
        CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail
    FROM documents),
leaves AS (
    SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % 7 = 0
            THEN sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END || tail) END AS altered
    FROM parts, crc),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
tree AS (
    SELECT lang, 0 AS up, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM placed
    UNION ALL
    SELECT lang, any_value(up) + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2
    FROM tree WHERE n > 1 GROUP BY lang, pos // 2),
groups AS (
    SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang COLLATE "binary" NULLS FIRST) - 1 AS gpos FROM tree WHERE n = 1),
crown AS (
    SELECT 0 AS up, gpos AS pos, subroot AS node, count(*) OVER () AS n FROM groups
    UNION ALL
    SELECT any_value(up) + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2
    FROM crown WHERE n > 1 GROUP BY pos // 2),
steps AS (
    SELECT p.lang, p.pos AS leaf_pos, t.up AS k, (p.pos >> t.up) & 1 AS right_hand, s.node AS other
    FROM placed p JOIN (SELECT DISTINCT lang, up FROM tree WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.up = t.up AND s.pos = xor(p.pos >> t.up, 1)
    UNION ALL
    SELECT p.lang, p.pos, 1000 + c.up, (g.gpos >> c.up) & 1, s.node
    FROM placed p JOIN groups g ON g.lang IS NOT DISTINCT FROM p.lang
    JOIN (SELECT DISTINCT up FROM crown WHERE n > 1) c ON true
    LEFT JOIN crown s ON s.up = c.up AND s.pos = xor(g.gpos >> c.up, 1)),
paths AS (
    SELECT lang, leaf_pos, sha256(coalesce(string_agg(other, '' ORDER BY k), '')) AS proof_sha256, count(*) AS n_steps,
        list({'r': right_hand, 'o': other} ORDER BY k) AS path
    FROM steps GROUP BY lang, leaf_pos),
folded AS (
    SELECT lang, pos AS leaf_pos, 0 AS i, coalesce(altered, leaf) AS node FROM placed
    UNION ALL
    SELECT f.lang, f.leaf_pos, f.i + 1, sha256(CASE WHEN s.r = 1 THEN coalesce(s.o, '') || f.node ELSE f.node || coalesce(s.o, '') END)
    FROM (SELECT f.*, p.path[f.i + 1] AS s FROM folded f JOIN paths p
        ON p.lang IS NOT DISTINCT FROM f.lang AND p.leaf_pos = f.leaf_pos WHERE f.i < p.n_steps) f)
SELECT p.doc_id, p.leaf, g.subroot, r.node AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
    f.node AS folded_root, f.node = r.node AS verified, p.pos AS position, coalesce(q.n_steps, 0)::INTEGER AS n_steps
FROM placed p JOIN groups g ON g.lang IS NOT DISTINCT FROM p.lang
LEFT JOIN paths q ON q.lang IS NOT DISTINCT FROM p.lang AND q.leaf_pos = p.pos
JOIN folded f ON f.lang IS NOT DISTINCT FROM p.lang AND f.leaf_pos = p.pos AND f.i = coalesce(q.n_steps, 0)
CROSS JOIN (SELECT node FROM crown WHERE n = 1) r
"""
