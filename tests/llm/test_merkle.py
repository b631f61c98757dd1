"""Merkle manifest: layout arithmetic, a plain tree on small fixtures, and SQL."""

import hashlib
import zlib

import pytest

from spooltrace.llm import merkle
from spooltrace.oracle.check import compare, duck_connect

from conftest import SF_SMALL


def digest(*hexes):
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def recursive_order(levels):
    """Nodes (depth, index) of a tree in van Emde Boas order, by the definition."""
    if levels == 1:
        return [(0, 0)]
    top = levels // 2
    out = recursive_order(top)
    for sub in range(1 << top):
        out += [(top + d, (sub << d) + i) for d, i in recursive_order(levels - top)]
    return out


@pytest.mark.parametrize("levels", range(1, 10))
def test_address_is_recursive_layout(levels):
    for place, (depth, index) in enumerate(recursive_order(levels)):
        assert merkle.address(depth, index, levels) == place


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_leaf(doc_id, source, lang, n_chars, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join(parts))


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r, plain_leaf(*r)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[lang] = plain_levels([leaf for _, leaf in by[lang]])
    crown = plain_levels([trees[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for p, (row, leaf) in enumerate(by[lang]):
            doc, source, _, n_chars, text = row
            bad = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n_chars is not None
            node = plain_leaf(doc, source, lang, n_chars + 1, text) if bad else leaf
            proof = []
            for at, tree in ((p, trees[lang]), (g, crown)):
                for level in tree[:-1]:
                    run = list(range(at & ~1, min((at & ~1) + 2, len(level))))
                    proof += [level[i] for i in run if i != at]
                    node = digest(*(node if i == at else level[i] for i in run))
                    at >>= 1
            out.append((doc, leaf, trees[lang][-1][0], crown[-1][0], digest(*proof), node, node == crown[-1][0]))
    return sorted(out, key=repr)


def fixture(n):
    langs = ["en", "en", "en", "ét", None, "de", ""]
    rows = [(i * 3, f"s{i % 4}" if i % 5 else None, langs[i % 7], None if i % 11 == 0 else i, "tü" * i if i % 6 else None)
            for i in range(n)]
    return rows + rows[:3] + [(None, "s", "en", 5, "x"), (3, "other", "en", 1, "x"), (10**18, None, "xx", 7, "long " * 20000)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_matches_plain_tree(spark, height):
    rows = fixture(60)
    out = merkle.verify_documents(spark.createDataFrame(rows, SCHEMA), height)
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r[c] for c in cols) for r in out.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_small_single_group(spark, n):
    rows = [(i, "s", "en", i, "t") for i in range(n)]
    out = merkle.verify_documents(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert [r.proof_sha256 for r in sorted(out, key=lambda r: r.doc_id)] == [r[4] for r in sorted(brute(rows))]


def test_many_groups_need_a_taller_crown(spark):
    rows = [(i, "s", f"l{i % 9}", i, "t") for i in range(30)]
    out = merkle.verify_documents(spark.createDataFrame(rows, SCHEMA), 1)
    assert sorted((r.doc_id, r.proof_sha256, r.folded_root) for r in out.collect()) == [(r[0], r[4], r[5]) for r in sorted(brute(rows))]


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame(fixture(5), SCHEMA)
    assert merkle.manifest_query(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS grp", "2 AS pos", "'x' AS node", "'y' AS root", "0 AS id", "0 AS block", "'z' AS leaf")
    assert sorted(map(str, merkle.manifest_query(clash).collect())) == sorted(map(str, merkle.manifest_query(docs).collect()))


def test_sql_agrees(spark):
    con = duck_connect(SF_SMALL)
    docs = spark.createDataFrame(fixture(40), SCHEMA)
    con.register("fixture", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    ok, msg = compare(merkle.manifest_query(docs), merkle.MERKLE_SQL.replace("FROM documents", "FROM fixture"), con)
    assert ok, msg
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    ok, msg = compare(merkle.manifest_query(docs), merkle.MERKLE_SQL, con)
    assert ok, msg
