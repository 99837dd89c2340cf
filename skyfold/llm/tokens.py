"""Public byte-level tokenizers inside tasks."""

from __future__ import annotations

import base64
import sys
import types

import numpy as np

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before merging; belongs to the file (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int64)


def tokenizer(path: str = TOKENIZER, pattern: str = PATTERN) -> Tokenizer:
    """One per worker process: task functions are shipped by value, so the cache lives in a module of its own."""
    cache = sys.modules.setdefault("_skyfold_tokenizers", types.ModuleType("_skyfold_tokenizers")).__dict__
    key = f"{path}|{pattern}"
    if key not in cache:
        cache[key] = Tokenizer(path, pattern)
    return cache[key]
