"""BPE by distinct words against the tokenizers library, texts of all kinds."""

import hashlib

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from spooltrace.llm import bpe, tokens

from conftest import SF_SMALL

PATH = tokens.vocabulary("word_bpe_49k.json")
TOK = tokens.load_tokenizer(PATH)
SPLIT, WORDS = bpe.WordSplitter(PATH), bpe.WordEncoder(PATH)


def by_words(text):
    return [i for e in WORDS.encode(SPLIT.split(text)) for i in e]


def whole(text):
    return TOK.encode(text, add_special_tokens=False).ids


def test_safe_characters_split_alike():
    chars = [c for c in map(chr, range(0x110000)) if regex.match(f"[{tokens.SAFE}]", c)]
    for i in range(0, len(chars), 50):
        text = "".join(f"A{c}b 1{c}2 !{c}? {c} {c}{c} e{c}\n" for c in chars[i:i + 50])
        assert not SPLIT.unsafe(text)
        assert by_words(text) == whole(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAeE'́Σİ <|>sS1\n’"))))
def test_any_text(text):
    assert by_words(text) == whole(text)


def test_special_strings():
    for t in ["a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", " <|endoftext|> x", "it's <|endof text|>"]:
        assert by_words(t) == whole(t)


def test_query_against_library(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    extra = [(10_001, None, b"k"), (10_002, "", b"k"), (10_003, "WordΣ ՘ café " * 3000, b"k"), (None, "null id", b"k"),
             (10_004, "same", b"k"), (10_004, "same", b"k"), (10_005, " \n ", b"k")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, ids binary"), allowMissingColumns=True)
    got = sorted(map(tuple, bpe.bpe_query(docs).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = whole(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.bpe_query(docs.limit(0)).count() == 0


def test_small_blocks_and_unknown_ids(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(40)
    out = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs, PATH, block_chars=2000).collect()}
    assert out == {r.doc_id: whole(r.text) for r in docs.collect()}
    odd = spark.createDataFrame([(1, np.array([0, 10**6, 1], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert [r.text for r in bpe.decode(odd, PATH).collect()] == [TOK.decode([0, 1], skip_special_tokens=False), ""]
