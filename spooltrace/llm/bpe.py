"""BPE encoding and decoding through a table of distinct words.

Encoding: every text is split into words by the vocabulary's own normal form
and pattern; the words of a block of documents are numbered, and a document
becomes the sequence of its words' numbers. The blocks' words, dealt by hash,
form the table of distinct words: each is encoded once. Its ids go back to the
blocks and take the places of the numbers, position by position.

Decoding: ids meet the table of pieces (bounded by the vocabulary) by a join on
the id, and a document's pieces are put together in order.

A block holds about ``block_chars`` characters, whatever the partitions are
like; a word comes once per block however frequent it is, so hot words cost no
more than others. Word lists and numbers travel compressed.

Defined results: null and empty texts have no ids and decode to the empty text;
special strings in a text become their special ids; ids outside the vocabulary
are skipped when decoding; repeated rows are encoded row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.llm.common import keep_table, map_batches, release_memory, ship_package, shuffle_partitions
from spooltrace.llm.tokens import SAFE, load_tokenizer, vocabulary


class WordSplitter:
    """Words of a text, in order, as the vocabulary's normal form and pattern give them."""

    def __init__(self, path: str):
        import regex

        self.tok = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.unsafe = regex.compile(f"[^{SAFE}]").search
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = set(special)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split

    def _plain(self, text: str) -> list[str]:
        if self.unsafe(text):  # characters whose class or case the installed tables may see differently
            norm = self.tok.normalizer.normalize_str(text)
            return [norm[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(norm)]
        return self.words(unicodedata.normalize("NFC", text).lower())

    def split(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self._plain(text)
        return [w for part in self.cut(text) for w in ([part] if part in self.special else self._plain(part))]


class WordEncoder:
    """Ids of single words in normal form."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["normalizer"] = spec["truncation"] = spec["padding"] = None  # the words are normal already
        self.tok = Tokenizer.from_str(json.dumps(spec))

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(words), 50_000)
                for e in self.tok.encode_batch_fast(words[i:i + 50_000], add_special_tokens=False)]


def _pack(x: np.ndarray) -> bytes:
    """Compressed unsigned 32-bit numbers, as byte planes."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


class _Numbers(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


@functools.lru_cache(maxsize=2)
def _splitter(path: str) -> WordSplitter:
    return WordSplitter(path)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    """Piece of every id, null where there is none."""
    vocab = load_tokenizer(path).get_vocab(with_added_tokens=True)
    table = [None] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        table[i] = piece
    return pa.array(table, pa.string())


_PARTS = ["block", "bucket", "docs", "sizes", "data"]


def _block_rows(batches: Iterator[pa.RecordBatch], path: str, buckets: int, block_chars: int) -> Iterator[pa.RecordBatch]:
    """Per block, a row with its documents' word numbers, and per bucket a row with the block's words there.

    Words are numbered by falling frequency in the block, which packs best; a
    word row holds the words in order, and their numbers.
    """
    splitter = _splitter(path)
    part, k = TaskContext.get().partitionId(), 0
    seen, ids, held, kind = _Numbers(), [], 0, None
    numbers: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        flat = np.concatenate(numbers)
        order = np.argsort(-np.bincount(flat, minlength=len(seen)), kind="stable")
        rank = np.empty(len(seen), np.uint32)
        rank[order] = np.arange(len(seen), dtype=np.uint32)
        dealt: list[list[str]] = [[] for _ in range(buckets)]
        for w in sorted(seen):
            dealt[zlib.crc32(w.encode()) % buckets].append(w)
        used = [b for b in range(buckets) if dealt[b]]
        lists = [zstandard.compress("\n".join(dealt[b]).encode(), 3) for b in used]
        places = [_pack(rank[[seen[w] for w in dealt[b]]]) for b in used]
        m = len(used)
        return pa.RecordBatch.from_arrays([
            pa.array([(part << 32) + k] * (m + 1), pa.int64()), pa.array([-1, *used], pa.int32()),
            pa.array([ids] + [None] * m, pa.list_(kind)),
            pa.array([_pack(np.fromiter(map(len, numbers), np.uint32, len(numbers))), *places], pa.binary()),
            pa.array([_pack(rank[flat]), *lists], pa.binary())], names=_PARTS)

    for batch in batches:
        kind = batch.column(0).type
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            words = splitter.split(text)
            ids.append(doc)
            numbers.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
            held += len(text) + 64
            if held >= block_chars:
                yield flush()
                k += 1
                seen, ids, held, numbers = _Numbers(), [], 0, []
    if ids:
        yield flush()


def _encode_bucket(t: pa.Table, path: str) -> pa.Table:
    """Encode each distinct word of a bucket once; per block, the ids of its words there, with their counts."""
    lists = [zstandard.decompress(x.as_py()).decode().split("\n") for x in t.column("data")]
    table: dict[str, int] = {}
    for words in lists:
        for w in words:
            table.setdefault(w, len(table))
    encoded = _encoder(path).encode(list(table))
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    flat = np.fromiter((i for e in encoded for i in e), np.uint32, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    ids, counts = [], []
    for words in lists:
        at = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
        ids.append(_pack(_gather(flat, first[at], sizes[at])))
        counts.append(_pack(sizes[at]))
    if len(table) > 20_000:  # a small bucket leaves little to give back
        release_memory()
    return pa.table({"block": t.column("block"), "places": t.column("sizes"),
                     "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of flat[first : first + size] over all pairs."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _join_back(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Ids of a block's documents: the ids of each word in the place of its number."""
    place = [_unpack(x.as_py()) for x in words.column("places")]
    total = sum(map(len, place))
    sizes, first = np.zeros(total, np.int64), np.zeros(total, np.int64)
    flats, base = [], 0
    for p, data, counts in zip(place, words.column("ids"), words.column("counts")):
        n = _unpack(counts.as_py()).astype(np.int64)
        sizes[p] = n
        first[p] = base + np.cumsum(n) - n
        flats.append(_unpack(data.as_py()))
        base += len(flats[-1])
    flat = np.concatenate(flats) if flats else np.empty(0, np.uint32)
    out = []
    for lengths, numbers in zip(docs.column("sizes"), docs.column("data")):
        seq = _unpack(numbers.as_py())
        ends = np.cumsum(_unpack(lengths.as_py()).astype(np.int64))
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
            out.append(_gather(flat, first[seq[lo:hi]], sizes[seq[lo:hi]]).astype("<u4").tobytes())
    release_memory()
    return pa.table({"doc_id": pa.chunked_array([x.values for x in docs.column("docs")], docs.schema.field("docs").type.value_type),
                     "ids": pa.array(out, pa.binary())})


def encode(docs: DataFrame, path: str, block_chars: int = 1 << 23, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    ship_package(spark)
    buckets = 2 * shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = keep_table(map_batches(
        rows, lambda it: _block_rows(it, path, buckets, block_chars),
        f"block long, bucket int, docs array<{kind}>, sizes binary, data binary"), "words", ["block"])
    encoded = parts.where("bucket >= 0").select("block", "bucket", "sizes", "data").groupBy("bucket").applyInArrow(
        lambda t: _encode_bucket(t, path), "block long, places binary, ids binary, counts binary")
    # the table is bucketed by block: only the encoded words move
    numbers = parts.where("bucket < 0").select("block", "docs", "sizes", "data")
    return numbers.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_join_back, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str, sep: str = " ", step: int = 1 << 19) -> DataFrame:
    """``encoded`` with the decoded ``text`` of its ids (the vocabulary has no decoder: pieces joined by ``sep``)."""
    columns = [c for c in encoded.columns if c != "text"]
    at = columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        known = pieces.is_valid().to_numpy(zero_copy_only=False)

        def text(raw: bytes) -> str:
            ids = np.frombuffer(raw, "<u4")
            ids = ids[ids < len(known)]
            ids = ids[known[ids]]
            found = [pc.binary_join(pa.ListArray.from_arrays([0, len(c)], pieces.take(pa.array(c))), sep)[0].as_py()
                     for c in np.split(ids, range(step, len(ids), step)) if len(c)]
            return sep.join(found)

        for b in batches:
            lo = held = 0
            for hi, size in enumerate(pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist(), 1):
                held += size
                if held >= 4 * step or hi == len(b):
                    part = b.slice(lo, hi - lo)
                    texts = pa.array([text(x.as_py() or b"") for x in part.column(at)], pa.string())
                    yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*columns, "text"])
                    lo, held = hi, 0

    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in columns)
    return map_batches(encoded.select(*columns), run, f"{fields}, text string")


def bpe_query(docs: DataFrame) -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the text decoded from them."""
    path = vocabulary("word_bpe_49k.json")
    return decode(encode(docs, path), path).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
