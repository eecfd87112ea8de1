"""Problem 6: documents that contain evaluation items or long passages of them.

Spaced-seed hashing: texts are folded to bare tokens (a word, or a character of a script without spaces; layout,
punctuation, width, case, accents and look-alikes aside) and the tokens at every position are hashed through fixed masks
that ignore some of them, so that a changed token under a hole does not hide a match. The hashes of the items are
joined with those of the documents. A pair is a candidate if it shares as many hashes as any passage of half the item
with the allowed changes must leave (``least_hits``); hits on neighbouring diagonals are chained into passages, and an
edit distance over the passage confirms it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.lookalike import _FOLD, _TO_LATIN, is_invisible
from textloom.llm.overlaps import edit_distance
from textloom.session import cut_lineage, table

#: Masks over tokens by the least number of tokens of the items they serve; 0 is a token that is ignored. Short items
#: have shorter masks, so that every item has hashes.
MASKS = ((41, "110111"), (7, "1101"), (5, "111"), (3, "11"), (1, "1"))
#: A mask over letters, for words whose spaces or letters are changed all over.
LETTERS = "1111110111111"
#: The least share of an item that must stand in one running passage, and the most of it that may be changed.
MIN_SHARE = 0.5
MAX_CHANGED = 0.15
#: Hashes of items that are sent to the tasks (16 bytes each); of more, hashes of both sides are joined by shuffle.
BROADCAST_SEEDS = 2_000_000
#: Characters of documents hashed at a time.
BLOCK_CHARS = 1_000_000

_LIMIT = 0x32000
_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _folded(ch: str) -> str:
    out = unicodedata.normalize("NFKD", "".join(_TO_LATIN.get(c, c) for c in _FOLD[ord(ch)])).casefold()
    return "".join(c for c in out if c.isalnum())


def _fold_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code point -> folded code point (0: dropped), those that fold to several characters, and those that end a word."""
    global _tables
    if _tables is None:
        table_, several, ends = np.zeros(_LIMIT, np.uint32), np.zeros(_LIMIT, bool), np.zeros(_LIMIT, bool)
        for o in range(_LIMIT):
            if 0xAC00 <= o < 0xD7A4 or 0x3400 <= o < 0xA000 or 0x20000 <= o < 0x2F800:
                table_[o] = o  # syllables and Han characters are themselves
            elif not 0xD800 <= o < 0xF8FF:
                f = _folded(chr(o))
                table_[o] = ord(f[0]) if f else 0
                several[o] = len(f) > 1
                ends[o] = not f and not is_invisible(chr(o)) and not unicodedata.category(chr(o)).startswith("M")
        _tables = table_, several, ends
    return _tables


def _dense(points: np.ndarray) -> np.ndarray:
    """Characters of scripts without spaces: each is a token."""
    return (points >= 0x0E00) & (points < 0x0F00) | (points >= 0x2E80)


def bare_tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of a text, and where in them its tokens begin."""
    single, several, ends = _fold_table()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < _LIMIT, points, 0)
    if ((points >= 0x1100) & (points < 0x1200)).any():  # conjoining jamo: compose, syllables are kept as they are
        text = unicodedata.normalize("NFC", text)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(points < _LIMIT, points, 0)
    if several[points].any():
        text = "".join(_folded(c) if several[min(ord(c), _LIMIT - 1)] else c for c in text)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(points < _LIMIT, points, 0)
    out = single[points]
    kept = out != 0
    out, word = out[kept], np.cumsum(ends[points])[kept]
    if not len(out):
        return out, np.zeros(0, np.int64)
    dense = _dense(out)
    first = dense.copy()
    first[0] = True
    first[1:] |= dense[:-1] | (word[1:] != word[:-1])
    return out, np.flatnonzero(first)


def bare(text: str) -> np.ndarray:
    """The folded code points of a text."""
    return bare_tokens(text)[0]


def token_hashes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of every token: a polynomial of its characters."""
    if not len(first):
        return np.zeros(0, np.uint64)
    power = np.full(len(points) + 1, _BASE, np.uint64)
    back = np.full(len(points) + 1, _INVERSE, np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(points) * power[:-1])])
    return (sums[np.append(first[1:], len(points))] - sums[first]) * back[first]


def _mix(points: np.ndarray) -> np.ndarray:
    x = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash under the mask at every position where the mask fits, of the hashes of tokens."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed, out = _mix(tokens), np.full(n, len(mask), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += mixed[i : i + n]
    return out ^ (out >> np.uint64(32))


def mask_of(tokens: int) -> str:
    """The mask that serves an item of so many tokens."""
    return next(m for least, m in MASKS if tokens >= least or least == 1)


def least_hits(tokens: int, min_share: float, max_changed: float) -> int:
    """The hits that every passage of ``min_share`` of an item leaves if ``max_changed`` of its tokens are replaced:
    each of them spoils as many hashes as the mask has ones. At least 1."""
    mask = mask_of(tokens)
    ones, first = mask.count("1"), max(1, math.ceil(tokens * min_share))
    period = math.ceil(1 / max_changed) + 1 if max_changed else 1  # behind it the number of changes has gone up again
    return max(1, min(n - len(mask) + 1 - ones * int(n * max_changed + 1e-9) for n in range(first, first + period)))


def least_letter_hits(characters: int, min_share: float) -> int:
    """The hits under the mask over letters that make a candidate: one for each length of it in ``min_share`` of an item,
    what is left if every seventh letter is replaced. Not a proof for other placements; the recall is tested."""
    return max(3, int(characters * min_share) // len(LETTERS))


class Seeds:
    """The hashes of a text: arrays of hash, start and end in its folded characters, by family. A family is the index of a
    mask over tokens, or ``len(MASKS)`` for the one over letters."""

    @staticmethod
    def of(points: np.ndarray, first: np.ndarray, row: np.ndarray | None, families: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``row`` tells texts apart that are hashed together, by character; no hash spans two of them."""
        hashed, edges = token_hashes(points, first), np.append(first, len(points))
        for family in families:
            letters = family == len(MASKS)
            mask = LETTERS if letters else MASKS[family][1]
            h = seed_hashes(_mix(points) if letters else hashed, mask) ^ np.uint64(family * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)
            at = np.arange(len(h))
            a, b = (at, at + len(mask)) if letters else (edges[at], edges[at + len(mask)])
            use = np.ones(len(h), bool) if row is None else row[a] == row[b - 1]
            if letters:
                use &= ~_dense(points[a])
            yield family, h[use], a[use], b[use]


class Items:
    """The seeds of some items, sorted by hash, with (family, item, start, end) of each."""

    def __init__(self, keys: list[int], texts: list[str], min_share: float, max_changed: float):
        self.keys = keys
        bare_ = [bare_tokens(t) for t in texts]
        self.texts = [_text(p) for p, _ in bare_]
        self.tokens = np.fromiter((len(f) for _, f in bare_), np.int64, len(bare_))
        self.least = np.fromiter((least_hits(int(n), min_share, max_changed) for n in self.tokens), np.int64, len(bare_))
        # The diagonals of the hits of one passage are at most this far apart, and not less than a few changed words.
        self.drift = np.fromiter((max(12, int(max_changed * len(t))) for t in self.texts), np.int64, len(bare_))
        self.least_letters = np.fromiter((least_letter_hits(len(t), min_share) for t in self.texts), np.int64, len(bare_))
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for i, (p, f) in enumerate(bare_):
            for family, h, a, b in Seeds.of(p, f, None, families(len(f))):
                for column, values in zip(columns, (h, np.full(len(h), family), np.full(len(h), i), a, b)):
                    column.append(values)
        h, self.family, self.item, self.start, self.end = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
        order = np.argsort(h, kind="stable")
        self.hash, self.family, self.item, self.start, self.end = (x[order] for x in (h.astype(np.uint64), self.family, self.item, self.start, self.end))
        self.families = sorted(set(self.family.tolist()))
        self.some = np.zeros(1 << 22, bool)
        self.some[(self.hash & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, points: np.ndarray, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document start and end, seed) of every seed that matches."""
        out = []
        for _, h, a, b in Seeds.of(points, first, row, self.families):
            where = np.flatnonzero(self.some[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hash, h[where], "left"), np.searchsorted(self.hash, h[where], "right")
            n = hi - lo
            seed = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            out.append(np.stack([np.repeat(a[where], n), np.repeat(b[where], n), seed]))
        return tuple(np.concatenate(out, axis=1)) if out else tuple(np.zeros((3, 0), np.int64))


def families(tokens: int) -> list[int]:
    """The families of an item of so many tokens."""
    return [next(i for i, (least, _) in enumerate(MASKS) if tokens >= least), len(MASKS)] if tokens else []


def _chains(d: np.ndarray, d_end: np.ndarray, q: np.ndarray, q_end: np.ndarray, letters: np.ndarray, drift: int, gap: int) -> list[tuple[int, int, int, int, int, int]]:
    """Chains of hits of one document and item: (doc start, doc end, item start, item end, hits of tokens, of letters).

    A hit continues the chain whose last diagonal and item position are near; the newest such chain is taken.
    """
    open_, done = [], []
    order = np.lexsort((q, d))
    for di, de, qi, qe, of_letters in zip(*(x[order].tolist() for x in (d, d_end, q, q_end, letters))):
        best, at = None, di - qi
        for c in reversed(open_):
            if di - c[1] <= gap and abs(at - c[6]) <= drift and qi - qe <= qi - c[3] <= gap and qi >= c[2] and (best is None or abs(at - c[6]) < abs(at - best[6])):
                best = c
        if best is None:
            open_.append([di, de, qi, qe, not of_letters, of_letters, at])
        else:
            best[1], best[3], best[4 + of_letters], best[6] = max(best[1], de), max(best[3], qe), best[4 + of_letters] + 1, at
        if len(open_) > 64:
            done += [c for c in open_ if di - c[1] > gap]
            open_ = [c for c in open_ if di - c[1] <= gap]
    return [tuple(c[:6]) for c in done + open_]


def _text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class Scanner:
    def __init__(self, keys: list[int], texts: list[str], min_share: float, max_changed: float):
        self.items = Items(keys, texts, min_share, max_changed)
        self.min_share, self.max_changed = min_share, max_changed

    def scan(self, texts: list[str]) -> list[tuple[int, int, float, float]]:
        """(row, item key, share of the item in the passage, changed share) of the items found in the texts."""
        items, parts = self.items, [bare_tokens(t) for t in texts]
        sizes = np.fromiter((len(p) for p, _ in parts), np.int64, len(parts))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        joined = np.concatenate([p for p, _ in parts] or [np.zeros(0, np.uint32)])
        first = np.concatenate([f + s for (_, f), s in zip(parts, starts)] or [np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(parts)), sizes)
        d, d_end, seed = items.hits(joined, first, row)
        if not len(d):
            return []
        pair = row[d] * len(items.keys) + items.item[seed]
        letters = items.family[seed] == len(MASKS)
        kept = _banded(pair, letters, d - items.start[seed], items.drift[items.item[seed]], np.where(letters, items.least_letters[items.item[seed]], items.least[items.item[seed]]))
        found, text = [], _text(joined)
        for hits in np.split(kept, np.flatnonzero(np.diff(pair[kept])) + 1):
            if len(hits):
                i, r = int(pair[hits[0]]) % len(items.keys), int(pair[hits[0]]) // len(items.keys)
                best = self._best(i, text, d[hits], d_end[hits], items.start[seed[hits]], items.end[seed[hits]], letters[hits], int(starts[r]), int(starts[r + 1]))
                if best:
                    found.append((r, items.keys[i], *best))
        return found

    def _best(self, i: int, text: str, d: np.ndarray, d_end: np.ndarray, q: np.ndarray, q_end: np.ndarray, letters: np.ndarray, start: int, end: int) -> tuple[float, float] | None:
        p, best = self.items.texts[i], None
        size, least, least_letters = len(p), int(self.items.least[i]), int(self.items.least_letters[i])
        drift, gap = int(self.items.drift[i]), max(40, size // 2)
        for d0, d1, q0, q1, of_tokens, of_letters in _chains(d, d_end, q, q_end, letters, drift, gap):
            if of_tokens < least and of_letters < least_letters:
                continue
            # A word changed at either end hides the ends' seeds: extend to where the text goes on alike.
            q0, d0 = _extend(p, text, q0, d0, start, -1)
            q1, d1 = _extend(p, text, q1, d1, end, 1)
            run = q1 - q0
            if run < self.min_share * size - 1:
                continue
            limit = int(self.max_changed * run)
            changed = edit_distance(p[q0:q1], text[d0:d1], limit)
            if changed <= limit and (best is None or run / size > best[0]):
                best = (run / size, changed / run)
        return best


def _banded(pair: np.ndarray, letters: np.ndarray, diagonal: np.ndarray, drift: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The hits, ordered by pair, with ``least`` of their pair and kind on diagonals at most twice ``drift`` apart."""
    _, rank = np.unique(pair, return_inverse=True)
    key = (rank * 2 + letters << 34) + diagonal + (1 << 33)
    order = np.argsort(key, kind="stable")
    along = key[order]
    last = np.searchsorted(along, along + 2 * drift[order], "right")
    full = np.flatnonzero(last - np.arange(len(along)) >= least[order])
    edges = np.bincount(full, minlength=len(along) + 1) - np.bincount(last[full], minlength=len(along) + 1)
    return order[np.cumsum(edges[:-1]) > 0]


#: What may be skipped at the end of a passage: characters of the item and of the text, short changes first.
_SKIPS = [(size - a, size - b) for size in range(1, 7) for a, b in ((0, 0), (0, 1), (1, 0), (0, size), (size, 0))]


def _extend(p: str, text: str, q: int, d: int, edge: int, step: int) -> tuple[int, int]:
    """Goes on over equal characters, and over one short change behind which the texts agree again."""
    while True:
        if step > 0:
            while q < len(p) and d < edge and p[q] == text[d]:
                q, d = q + 1, d + 1
            skip = next(((x, y) for x, y in _SKIPS if q + x + 4 <= len(p) and d + y + 4 <= edge and p[q + x : q + x + 4] == text[d + y : d + y + 4]), None)
        else:
            while q and d > edge and p[q - 1] == text[d - 1]:
                q, d = q - 1, d - 1
            skip = next(((x, y) for x, y in _SKIPS if q - x >= 4 and d - y >= edge + 4 and p[q - x - 4 : q - x] == text[d - y - 4 : d - y]), None)
        if skip is None:
            return q, d
        q, d = q + step * skip[0], d + step * skip[1]


_INSTRUCTION = r"^[^:：\n]{2,60}[:：]\s*"


def without_instruction(items: DataFrame, key: str, text: str, min_items: int = 3) -> DataFrame:
    """Rows (key, text) of the items without the task instruction that some of them open with: words up to a colon
    that open at least ``min_items`` items."""
    rows = items.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("lead", F.regexp_extract("text", _INSTRUCTION, 0))
    shared = rows.where("lead <> ''").groupBy("lead").agg(F.countDistinct("text").alias("n")).where(F.col("n") >= min_items).select("lead", F.lit(True).alias("shared"))
    rows = rows.join(shared, "lead", "left")
    return rows.select("key", F.when(F.col("shared"), F.expr("substring(text, length(lead) + 1)")).otherwise(F.col("text")).alias("text"))


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_share: float = MIN_SHARE, max_changed: float = MAX_CHANGED, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Rows (key, item_id, share, changed): the documents that contain an item or a running passage of at least
    ``min_share`` of it, of which at most ``max_changed`` of the characters are changed.

    The hashes of the items are counted first. Up to ``broadcast_seeds`` they are sent to the tasks, and documents are
    scanned where they lie, once, whole and without a shuffle; of more, the hashes of both sides are joined by shuffle,
    and the documents of the candidates meet their items' texts. Both ways find the same. Null keys and texts play
    no part; repeated rows are reported each; empty tables give no rows; other columns play no part.
    """
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    schema = f"key {kind}, item_id bigint, share double, changed double"
    bare_items = cut_lineage(without_instruction(items, item_key, item_text).where("text <> ''"))
    most = bare_items.agg(F.sum(2 * F.length("text"))).first()[0] or 0  # no more hashes than two a character
    if most <= broadcast_seeds:
        rows = bare_items.orderBy("key").collect()
        return source.mapInPandas(_scan([r["key"] for r in rows], [r["text"] for r in rows], min_share, max_changed), schema)
    seeds = bare_items.mapInPandas(_item_seeds(min_share, max_changed), "item_id bigint, least int, letters boolean, h bigint")
    seeds = cut_lineage(seeds.groupBy("item_id", "least", "letters", "h").agg(F.count(F.lit(1)).alias("times")))
    shared = source.mapInPandas(_document_seeds, f"key {kind}, h bigint").join(seeds, "h").groupBy("key", "item_id", "letters").agg(F.sum("times").alias("hits"), F.first("least").alias("least"))
    pairs = shared.where("hits >= least").select("key", "item_id").distinct().join(bare_items.select(F.col("key").alias("item_id"), F.col("text").alias("item_text")), "item_id")
    asked = pairs.groupBy(F.col("key").alias("asked")).agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))  # the candidates of one document
    return source.join(asked, F.col("key") == F.col("asked")).select("key", "text", "items").mapInPandas(_verify(min_share, max_changed), schema)


def _item_seeds(min_share: float, max_changed: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, t in zip(pdf["key"], pdf["text"]):
                points, first = bare_tokens(t)
                for family, h, _, _ in Seeds.of(points, first, None, families(len(first))):
                    letters = family == len(MASKS)
                    yield pd.DataFrame({"item_id": k, "least": least_letter_hits(len(points), min_share) if letters else least_hits(len(first), min_share, max_changed), "letters": letters, "h": h.view(np.int64)})

    return run


def _document_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    every = list(range(len(MASKS) + 1))
    for pdf in batches:
        size = pdf["text"].str.len().cumsum() // BLOCK_CHARS
        for _, block in pdf.groupby(size, sort=False):
            found = [np.concatenate([h for _, h, _, _ in Seeds.of(*bare_tokens(t), None, every)]) for t in block["text"]]
            keys = block["key"].repeat([len(h) for h in found]).reset_index(drop=True)
            yield pd.DataFrame({"key": keys, "h": np.concatenate(found).view(np.int64)})


def _verify(min_share: float, max_changed: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, t, asked in zip(pdf["key"], pdf["text"], pdf["items"]):
                found = Scanner([r["item_id"] for r in asked], [r["item_text"] for r in asked], min_share, max_changed).scan([t])
                yield pd.DataFrame({"key": [k] * len(found), "item_id": [f[1] for f in found], "share": [float(f[2]) for f in found], "changed": [float(f[3]) for f in found]})

    return run


def _scan(keys: list[int], texts: list[str], min_share: float, max_changed: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(keys, texts, min_share, max_changed)
        for pdf in batches:
            size = pdf["text"].str.len().cumsum() // BLOCK_CHARS
            for _, block in pdf.groupby(size, sort=False):
                found = scanner.scan(block["text"].tolist())
                ids = block["key"].iloc[[f[0] for f in found]].reset_index(drop=True)
                yield pd.DataFrame({"key": ids, "item_id": [f[1] for f in found], "share": [float(f[2]) for f in found], "changed": [float(f[3]) for f in found]})

    return run


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(F.col("key").alias("doc_id"), "item_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: the documents that leak it, and the largest share found."""
    found = leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    counts = found.groupBy("item_id").agg(F.countDistinct("key").alias("documents"), F.round(F.max("share"), 4).alias("largest_share"))
    return table(spark, sf_dir, "benchmark").select("item_id", "task", "split").join(counts, "item_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p6_found": p6_found, "p6_items": p6_items}
ORACLES: dict[str, str] = {}
