"""Token counts and offsets with the vocabulary file of a public tokenizer (a parameter, never copied here)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.environ.get("TEXTLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the usual pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, "Tokenizer"] = {}


class Tokenizer:
    """``vocabulary`` is a .tiktoken file of ranks, or 'bytes' for one token per UTF-8 byte."""

    def __init__(self, vocabulary: str):
        self.encoding = None
        if vocabulary != "bytes":
            import tiktoken

            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                self.size[rank] = len(token)

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(text.encode("utf-8", "surrogatepass")) if self.encoding is None else len(self.ids(text))

    def byte_ends(self, text: str) -> np.ndarray:
        """The byte offset behind every token."""
        if self.encoding is None:
            return np.arange(1, len(text.encode("utf-8", "surrogatepass")) + 1)
        return np.cumsum(self.size[np.asarray(self.ids(text), np.int64)])


def tokenizer(vocabulary: str) -> Tokenizer:
    """The worker's own copy, loaded once."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Tokenizer(vocabulary)
    return _loaded[vocabulary]


def token_count(column, vocabulary: str = DEFAULT_VOCABULARY):
    """Tokens of a text column; null stays null. One token per byte is counted in the JVM."""
    if vocabulary == "bytes":
        return F.octet_length(column).cast("long")

    @F.pandas_udf("long")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(vocabulary)
        for s in values:
            yield pd.Series([None if x is None else t.count(x) for x in s], index=s.index, dtype="Int64")

    return run(column)
