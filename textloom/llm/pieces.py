"""Problem 8: texts over a token limit, cut into pieces under it at natural boundaries, with a set overlap.

Token offsets are prefix sums over the text; natural boundaries (headings and paragraphs, lines, sentences, clauses,
words) are sorted arrays of offsets. The end of a piece is the last boundary under the limit, found by binary
search, of the strongest kind that fills at least part of the piece; without any boundary it is a hard cut between
characters. The next piece begins the overlap before that end, at a word boundary if one is near.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.tokens import DEFAULT_VOCABULARY, Tokenizer, tokenizer
from textloom.session import table

LIMIT = 4096
OVERLAP = 256
#: Characters of pieces held before they are handed on.
OUTPUT_CHARS = 8_000_000
#: The part of the limit that a boundary of a kind must fill, from the strongest kind to the weakest.
FILL = (0.6, 0.5, 0.4, 0.25, 0.05)

_FENCE = re.compile(r"^(```|~~~).*?(?:^\1[^\n]*$|\Z)", re.M | re.S)
_KINDS = (
    re.compile(r"\n\s*\n|\n(?=#{1,6} )"),  # paragraphs and headings
    re.compile(r"\n"),
    re.compile(r"[。！？!?؟।…]+[」』”\"'）)]*\s*|\.[\"')\]]*\s+(?=\S)"),
    re.compile(r"[，、；：,;:،]\s*"),
    re.compile(r"\s+"),
)


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted offsets at which a piece may begin, strongest kind first; kinds inside code fences count as lines."""
    fences = [m.span() for m in _FENCE.finditer(text)] if "```" in text or "~~~" in text else []
    starts, ends = np.array([a for a, _ in fences], np.int64), np.array([b for _, b in fences], np.int64)
    out = []
    for kind, pattern in enumerate(_KINDS):
        at = np.array([m.end() for m in pattern.finditer(text)], np.int64)
        if fences and kind in (0, 2, 3):
            i = np.searchsorted(starts, at, "right") - 1
            at = at[(i < 0) | (at >= ends[i])]
        out.append(at)
    return out


def _char_ends(text: str, byte_ends: np.ndarray) -> np.ndarray:
    """The number of whole characters up to each byte offset."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.cumsum(np.append((raw[1:] & 0xC0) != 0x80, True))[byte_ends - 1]


def split_text(text: str, limit: int, overlap: int, t: Tokenizer) -> list[tuple[int, int, int]]:
    """Pieces (start, end, tokens) of a text, offsets in code points. One piece if it fits."""
    if len(text) <= limit and (n := t.count(text)) <= limit:
        return [(0, len(text), n)]
    ends = _char_ends(text, t.byte_ends(text)) if text else np.zeros(0, np.int64)
    n = len(ends)
    if n <= limit:
        return [(0, len(text), n)]
    kinds, out, start, done = boundaries(text), [], 0, 0
    while True:
        first = int(np.searchsorted(ends, start, "right"))  # tokens before ``start``
        if n - first <= limit and (tokens := t.count(text[start:])) <= limit:
            out.append((start, len(text), tokens))
            return out
        room = limit
        while True:
            last = int(ends[min(n, first + room) - 1])  # the most characters that fit
            if last <= done and start < done:  # the overlap leaves no room for anything new
                start, first, room = done, int(np.searchsorted(ends, done, "right")), limit
                continue
            last = max(last, start + 1)
            cut = last
            for at, fill in zip(kinds, FILL):
                i = int(np.searchsorted(at, last, "right")) - 1
                if i >= 0 and at[i] > max(start, done) and at[i] >= ends[min(n, first + max(1, int(room * fill))) - 1]:
                    cut = int(at[i])
                    break
            tokens = t.count(text[start:cut])  # a piece's own tokens may be cut differently at its edges
            if tokens <= limit or cut == start + 1:
                break
            room = max(1, room - (tokens - limit))
        out.append((start, cut, tokens))
        done = cut
        back = int(np.searchsorted(ends, cut, "right")) - overlap
        begin = int(ends[back - 1]) if back > 0 and overlap else cut if not overlap else 0
        for at in (kinds[2], kinds[3], kinds[4]):
            i = int(np.searchsorted(at, begin, "right")) - 1
            if overlap and i >= 0 and at[i] > start and begin - at[i] <= max(8, overlap // 8):
                begin = int(at[i])
                break
        start = begin if start < begin < cut else cut


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Rows (key, piece, char_start, char_end, n_tokens, text) of all texts, in pieces of at most ``limit`` tokens.

    The tokens of every text are counted, also of those that fit. Null texts give no rows, an empty text one empty piece,
    repeated rows their pieces each; a single character of more tokens than the limit is a piece of its own. Other
    columns play no part. ``0 <= overlap < limit`` is required.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    kind = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, columns = tokenizer(vocabulary), ["key", "piece", "char_start", "char_end", "n_tokens", "text"]
        for pdf in batches:
            out, held = [], 0
            for k, s in zip(pdf["key"], pdf["text"]):
                if held > OUTPUT_CHARS:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
                out += [(k, n, a, b, tokens, s[a:b]) for n, (a, b, tokens) in enumerate(split_text(s, limit, overlap, t))]
                held += len(s)
            yield pd.DataFrame(out, columns=columns)

    schema = f"key {kind}, piece int, char_start bigint, char_end bigint, n_tokens bigint, text string"
    return rows.mapInPandas(run, schema)


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), "piece", "char_start", "char_end", "n_tokens")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that came out as more than one piece."""
    return p8_pieces(spark, sf_dir).where("piece = 1").select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p8_found": p8_found, "p8_pieces": p8_pieces}
ORACLES: dict[str, str] = {"p8_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096"}  # one token a byte gives the same
