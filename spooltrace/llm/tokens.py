"""Text to token ids with a public byte-level vocabulary, exactly as the tokenizers library gives them.

tiktoken applies the same split pattern and merges several times faster, so it
encodes texts whose characters both libraries classify alike; texts with other
characters, or with the vocabulary's special strings, go to the tokenizers
library.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

# ranges in which both libraries and the regex module agree on every character (tests/llm checks them all)
SAFE = "\\x00-\u036f\u0400-\u04ff\u1e00-\u1eff\u2010-\u205f\u3041-\u3096\u4e00-\u9fa5"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def load_tokenizer(path: str):
    """The tokenizers library's tokenizer, without truncation, padding or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread per task: Spark spreads the work
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class ByteLevelEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        self.tok = load_tokenizer(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(map(letters.__getitem__, w)): i for w, i in vocab.items() if w not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})
        self.unsafe = regex.compile(f"[^{SAFE}]").search

    def encode(self, text: str) -> bytes:
        if self.unsafe(text) or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@functools.lru_cache(maxsize=1)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)
