"""Punctuation restoration: labelled boundaries, features, a count model, constrained decoding, rendering, metrics.

A text is read as pieces, each with the run of restorable symbols before it, by one regular expression; labels are expressions
over the two arrays, so that nothing leaves the JVM but for NFC and the decoder.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions.text import chars, hash_bucket, norm_nfc

MARKS, QUOTES = len(spec.MARK_GLYPHS["full"]), 3
_ANY_QUOTE = spec.OPEN_QUOTES + spec.CLOSE_QUOTES + '"'
_SYMBOL = "[" + "".join(spec.PUNCTUATION).replace(".", "\\.") + _ANY_QUOTE + "]"
_SAFE = "|".join(spec.PROTECTED_PUNCTUATION)
# Group 1: symbols before a piece; group 2: a protected span (two characters or more) or one other character.
_PIECE = f"(?s)({_SYMBOL}*+)({_SAFE}|.)"
_END = "\x00"


def _pieces(text: Column) -> tuple[Column, Column]:
    ended = F.concat(text, F.lit(_END))
    return F.regexp_extract_all(ended, F.lit(_PIECE), F.lit(1)), F.regexp_extract_all(ended, F.lit(_PIECE), F.lit(2))


def _units(piece: Column) -> Column:
    return F.when(F.length(piece) == 1, F.array(piece)).otherwise(chars(piece))


def protected_count(text: Column) -> Column:
    """Characters inside addresses, acronyms and grouped numbers."""
    return (F.length(text) - F.length(F.regexp_replace(text, F.lit(_SAFE), F.lit("")))).cast("long")


def labelled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, units, punctuation, quotes, allowed, error): the characters of each text that are not restorable, a label of each kind
    and a permission for each of the boundaries before, between and behind them, or the reason for which the text is rejected.

    Quotation marks open and close in turn, plain ones as it comes; two quotes or different marks at one boundary, a quote that
    is open at the end and a text without units are errors. No mark may stand inside protected spans, Latin words or
    behind white space. Null and empty texts are the error ``null``.
    """
    t = df.select(F.col(key), norm_nfc(F.col(text)).alias("_t"))
    runs, pieces = _pieces(F.col("_t"))
    t = t.select(key, "_t", runs.alias("_runs"), pieces.alias("_pieces"))
    mark_of = F.create_map(*[F.lit(x) for kv in spec.PUNCTUATION.items() for x in kv])
    # Most runs are empty and most pieces one character: nothing is matched for them.
    none = F.array().cast("array<string>")
    marks = F.transform("_runs", lambda r: F.when(r == "", F.array().cast("array<int>")).otherwise(F.array_distinct(F.filter(F.transform(chars(r), lambda c: mark_of[c]), lambda m: m.isNotNull()))))
    quotes = F.transform("_runs", lambda r: F.when(r == "", none).otherwise(F.regexp_extract_all(r, F.lit(f"[{_ANY_QUOTE}]"), F.lit(0))))
    t = t.select(key, "_t", "_pieces", marks.alias("_marks"), quotes.alias("_quotes"))
    events = F.flatten("_quotes")
    wrong = F.transform(events, lambda c, i: F.when((i % 2 == 1) & F.contains(F.lit(spec.OPEN_QUOTES), c), "nested_quotes").when((i % 2 == 0) & F.contains(F.lit(spec.CLOSE_QUOTES), c), "unmatched_quote"))
    wrong = F.get(F.filter(wrong, lambda x: x.isNotNull()), F.lit(0))
    error = (
        F.when(F.col("_t").isNull() | (F.col("_t") == ""), "null")
        .when(F.exists("_marks", lambda m: F.size(m) > 1), "conflicting_punctuation")
        .when(wrong.isNotNull(), wrong)
        .when(F.exists("_quotes", lambda x: F.size(x) > 1), "conflicting_quotes")
        .when(F.size(events) % 2 == 1, "unclosed_quote")
        .when(F.size("_pieces") < 2, "empty")
    )
    t = t.withColumn("error", error)
    places = F.filter(F.transform("_quotes", lambda x, i: F.when(F.size(x) > 0, i)), lambda i: i.isNotNull())
    action = F.map_from_arrays(places, F.transform(places, lambda p, k: F.when(k % 2 == 0, 1).otherwise(2)))
    ok = F.col("error").isNull()
    wide = lambda first: F.flatten(F.zip_with(first, "_pieces", lambda m, p: F.concat(F.array(m), F.array_repeat(F.lit(0), F.length(p) - 1))))
    t = t.select(
        key, "error",
        F.when(ok, F.flatten(F.transform(F.slice("_pieces", 1, F.size("_pieces") - 1), _units))).alias("units"),
        F.when(ok, wide(F.transform("_marks", lambda m: F.coalesce(F.get(m, F.lit(0)), F.lit(0))))).alias("punctuation"),
        F.when(ok, wide(F.transform("_quotes", lambda x, i: F.when(F.size(x) == 0, 0).otherwise(F.coalesce(F.try_element_at(action, i), F.lit(0)))))).alias("quotes"),
        F.when(ok, F.flatten(F.transform(F.slice("_pieces", 1, F.size("_pieces") - 1), lambda p: F.array_repeat(F.length(p) > 1, F.length(p))))).alias("_safe"),
    )
    latin = lambda c: c.rlike("^[A-Za-z0-9_]")
    pairs = F.arrays_zip(F.col("units").alias("u"), F.col("_safe").alias("s"), F.concat(F.slice("units", 2, 1 << 30), F.array(F.lit(""))).alias("v"), F.concat(F.slice("_safe", 2, 1 << 30), F.array(F.lit(False))).alias("w"))
    allowed = F.concat(F.array(F.lit(False)), F.transform(pairs, lambda x: ~(x["s"] | x["w"]) & ~(latin(x["u"]) & latin(x["v"])) & ~x["u"].rlike(f"^[{spec.SPACE}]")))
    return t.select(key, "units", "punctuation", "quotes", F.when(F.col("units").isNotNull(), allowed).alias("allowed"), F.coalesce("error", F.lit(None).cast("string")).alias("error"))


def token_features(df: DataFrame, key: str, units: str, tokens: str) -> DataFrame:
    """(key, bmes, word_lengths) of every unit by the tokens (an array of texts): 1 B, 2 M, 3 E, 4 S, 5 unknown, and lengths up to 5, 6 unknown.
    All are unknown if there are no tokens, or if without restorable symbols they do not join to the units."""
    t = df.select(key, units, F.col(tokens).alias("_w")).withColumn("_n", F.transform("_w", _strip))
    word = lambda u: F.exists(u, lambda c: c.rlike(r"^[\p{IsAlphabetic}\p{N}]"))
    shape = lambda u: F.when(~word(u), F.array_repeat(F.lit(5), F.size(u))).when(F.size(u) == 1, F.array(F.lit(4))).otherwise(F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(2), F.size(u) - 2), F.array(F.lit(3))))
    length = lambda u: F.array_repeat(F.when(word(u), F.least(F.size(u), F.lit(5))).otherwise(6), F.size(u))
    some = F.filter("_n", lambda u: F.size(u) > 0)
    good = F.coalesce((F.flatten("_n") == F.col(units)) & ~F.exists("_w", lambda w: w.isNull()), F.lit(False))
    unknown = lambda v: F.transform(units, lambda _: F.lit(v))
    return t.select(key, F.when(good, F.flatten(F.transform(some, shape))).otherwise(unknown(5)).alias("bmes"), F.when(good, F.flatten(F.transform(some, length))).otherwise(unknown(6)).alias("word_lengths"))


def _strip(text: Column) -> Column:
    _, pieces = _pieces(text)
    return F.flatten(F.transform(F.slice(pieces, 1, F.size(pieces) - 1), _units))


@lru_cache(1 << 16)
def char_type(c: str) -> int:
    """2 Han, 3 and 4 ASCII lower and upper case, 5 digit, 6 white space, 7 mark, 8 punctuation or symbol, 9 other."""
    if "㐀" <= c <= "鿿" or "豈" <= c <= "﫿":
        return 2
    if c.isascii() and c.isalpha():
        return 3 if c.islower() else 4
    if c.isdigit() or c.isspace():
        return 5 if c.isdigit() else 6
    return {"M": 7, "P": 8, "S": 8}.get(unicodedata.category(c)[0], 9)


def char_types(column) -> Column:
    """``char_type`` of every element of an array."""

    @F.pandas_udf("array<int>")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([None if x is None else [char_type(c) for c in x] for x in s], index=s.index, dtype=object)

    return run(column)


def encoded(examples: DataFrame, key: str, vocabulary: DataFrame, buckets: int) -> DataFrame:
    """(key, char_ids, hash_ids, type_ids) of the units, each behind a start symbol. ``vocabulary`` (ch, rank) has as many rows as its
    size says (a parameter of a few thousand), so it is sent to the tasks as a map."""
    ranks = {r["ch"]: r["rank"] for r in vocabulary.select("ch", "rank").collect()}

    @F.pandas_udf("array<int>")
    def ids(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([None if x is None else [2, *(ranks.get(c, 1) for c in x)] for x in s], index=s.index, dtype=object)

    hashes = F.concat(F.array(F.lit(1).cast("long")), F.transform("units", lambda c: hash_bucket(c, buckets).cast("long")))
    return examples.select(key, ids("units").alias("char_ids"), hashes.alias("hash_ids"), F.concat(F.array(F.lit(1)), char_types("units")).alias("type_ids"))


# ---------------------------------------------------------------- model and decoding
def boundaries(examples: DataFrame, key: str) -> DataFrame:
    """(key, b, left, right, mark, quote, allowed): one row for each boundary; texts begin and end with an empty unit."""
    x = F.arrays_zip(F.concat(F.array(F.lit("")), "units").alias("left"), F.concat("units", F.array(F.lit(""))).alias("right"), F.col("punctuation").alias("mark"), F.col("quotes").alias("quote"), F.col("allowed").alias("allowed"))
    return examples.where("error IS NULL").select(key, F.posexplode(x).alias("b", "x")).select(key, "b", "x.left", "x.right", "x.mark", "x.quote", "x.allowed")


def boundary_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Boundaries by their neighbours, with the number of each mark (m) and quote (q)."""
    several = lambda c, k: F.array(*[F.count(F.when(F.col(c) == i, 1)) for i in range(k)])
    return rows.groupBy(*by).agg(several("mark", MARKS).alias("m"), several("quote", QUOTES).alias("q"))


def scored(rows: DataFrame, training: DataFrame, weight: float = 4.0) -> DataFrame:
    """``rows`` with (marks, quotes): log probabilities of the labels given both neighbours, smoothed by those given the left one and by
    all. The tables join on the neighbours; Spark broadcasts them if their measured size allows."""
    both, left, whole = (boundary_counts(training, by).select(*by, F.col("m").alias(f"m{k}"), F.col("q").alias(f"q{k}")) for k, by in enumerate((["left", "right"], ["left"], [])))
    r = rows.join(both, ["left", "right"], "left").join(left, "left", "left").crossJoin(F.broadcast(whole))  # one row

    def logs(name: str, size: int) -> Column:
        share = F.transform(f"{name}2", lambda n: (n + 0.5) / (F.aggregate(f"{name}2", F.lit(0).cast("long"), lambda a, x: a + x) + 0.5 * size))
        for k in (1, 0):
            column = F.coalesce(f"{name}{k}", F.array_repeat(F.lit(0).cast("long"), size))
            total = F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
            share = F.transform(F.zip_with(column, share, lambda n, p: n + p * weight), lambda n: n / (total + weight))
        return F.transform(share, lambda x: F.log(x))

    return r.select(*rows.columns, logs("m", MARKS).alias("marks"), logs("q", QUOTES).alias("quote_scores"))


def constrained_decode(marks: np.ndarray, quotes: np.ndarray, pairs: np.ndarray | None = None, allowed: np.ndarray | None = None) -> tuple[list[int], list[int], float]:
    """(marks, quotes, score): the labels of the best sum of scores whose quotes open and close in turn and are closed at the end.

    ``pairs`` scores a mark with a quote; where ``allowed`` is false there is no mark. A boundary either keeps the state
    or flips it, so the best way to each state is a choice of two. Raises ValueError if no way is closed.
    """
    if len(marks) != len(quotes) or allowed is not None and len(allowed) != len(marks):
        raise ValueError("scores of different lengths")
    joint = marks[:, :, None] + quotes[:, None, :] + (0.0 if pairs is None else pairs[None])
    if allowed is not None:
        joint = np.where(np.asarray(allowed, bool)[:, None, None] | (np.arange(marks.shape[1]) == 0)[None, :, None], joint, -np.inf)
    top, mark = joint.max(axis=1), joint.argmax(axis=1)  # by boundary and quote
    flip = np.array([1, 2])  # the quote that leaves state 0, and that which leaves state 1
    ways, flipped = np.array([0.0, -np.inf]), np.zeros((len(marks), 2), bool)
    for t, row in enumerate(top):
        keep, cross = ways + row[0], (ways + row[flip])[::-1]
        flipped[t] = cross > keep
        ways = np.maximum(keep, cross)
    if not np.isfinite(ways[0]):
        raise ValueError("no balanced way")
    state, labels = 0, []
    for t in reversed(range(len(marks))):
        if flipped[t, state]:
            state = 1 - state
            labels.append(int(flip[state]))
        else:
            labels.append(0)
    labels.reverse()
    return [int(mark[t, k]) for t, k in enumerate(labels)], labels, float(ways[0])


def restored(rows: DataFrame, key: str) -> DataFrame:
    """(key, units, gold_marks, gold_quotes, marks, quotes, greedy_unclosed) of scored boundaries, decoded text by text."""
    x = F.array_sort(F.collect_list(F.struct("b", "right", "mark", "quote", "allowed", "marks", "quote_scores")))
    packed = rows.groupBy(key).agg(x.alias("x"))
    kind = packed.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf["x"]):
                m, q = np.array([r["marks"] for r in x]), np.array([r["quote_scores"] for r in x])
                marks, quotes, _ = constrained_decode(m, q, None, np.array([r["allowed"] for r in x]))
                alone = "".join(map(str, q.argmax(axis=1)[q.argmax(axis=1) > 0]))
                out.append((k, [r["right"] for r in x[:-1]], [r["mark"] for r in x], [r["quote"] for r in x], marks, quotes, alone != "12" * (len(alone) // 2)))
            yield pd.DataFrame(out, columns=[key, "units", "gold_marks", "gold_quotes", "marks", "quotes", "greedy_unclosed"])

    return packed.mapInPandas(run, f"{key} {kind}, units array<string>, gold_marks array<int>, gold_quotes array<int>, marks array<int>, quotes array<int>, greedy_unclosed boolean")


def rendered(units: str, marks: str, quotes: str, style: str = "full") -> Column:
    """The text of units and labels; styles ``full`` and ``half`` of marks and quotes. A closing quote stands before, an
    opening one behind its mark."""
    glyph = F.array(*[F.lit(g) for g in spec.MARK_GLYPHS[style]])
    open_, close = spec.QUOTE_GLYPHS[style]
    side = lambda kind, g: F.transform(quotes, lambda x: F.when(x == kind, g).otherwise(""))
    boundary = F.zip_with(F.zip_with(side(2, close), F.transform(marks, lambda m: F.element_at(glyph, m + 1)), lambda a, b: F.concat(a, b)), side(1, open_), lambda a, b: F.concat(a, b))
    return F.array_join(F.zip_with(boundary, units, lambda b, u: F.concat(b, F.coalesce(u, F.lit("")))), "")


def unclosed(labels: Column) -> Column:
    """Whether a text of quotation marks leaves the depths 0 and 1, or ends at another than 0."""
    only = F.regexp_replace(labels, F.lit(f"[^{spec.OPEN_QUOTES}{spec.CLOSE_QUOTES}]+"), F.lit(""))
    return ~only.rlike(f"^(?:[{spec.OPEN_QUOTES}][{spec.CLOSE_QUOTES}])*\\z")


# ---------------------------------------------------------------- augmentation, vocabulary, weights, metrics
def augmented(examples: DataFrame, key: str) -> DataFrame:
    """(key, part, units, punctuation, quotes): every example whole (part 0), and those with a mark inside also cut behind their
    middle mark, as two more examples; quotes must be closed there."""
    ok = examples.where("error IS NULL").select(key, "units", "punctuation", "quotes")
    n = F.size("units")
    # One pass: the place, whether a quote is open behind it, and the places where a text may be cut so far.
    begin = F.struct(F.lit(-1).alias("i"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("at"))

    def step(a: Column, x: Column) -> Column:
        i, open_ = a["i"] + 1, a["open"] != (x["q"] > 0)
        cut = (x["m"] > 0) & (i > 0) & (i < n) & ~open_
        return F.struct(i.alias("i"), open_.alias("open"), F.when(cut, F.array_append(a["at"], i)).otherwise(a["at"]).alias("at"))

    places = F.aggregate(F.arrays_zip(F.col("punctuation").alias("m"), F.col("quotes").alias("q")), begin, step)["at"]
    middle = F.transform(F.array(places), lambda at: F.get(at, F.floor(F.size(at) / 2).cast("int")))  # bound once
    part = lambda k, u, m, q: F.struct(F.lit(k).alias("part"), u.alias("units"), m.alias("punctuation"), q.alias("quotes"))

    def parts(at: Column) -> Column:
        head = lambda c, size: F.slice(c, F.lit(1), size)
        tail = lambda c: F.concat(F.array(F.lit(0)), F.slice(c, at + 2, n - at))
        whole = part(0, F.col("units"), F.col("punctuation"), F.col("quotes"))
        halves = F.array(whole, part(1, head("units", at), head("punctuation", at + 1), head("quotes", at + 1)), part(2, F.slice("units", at + 1, n - at), tail("punctuation"), tail("quotes")))
        return F.when(at.isNull(), F.array(whole)).otherwise(halves)

    return ok.select(key, F.inline(F.flatten(F.transform(middle, parts))))


def vocabulary(texts: DataFrame, text: str, max_size: int) -> DataFrame:
    """(ch, n, rank): the most frequent characters, ties by code point, after three reserved places."""
    counts = texts.select(F.explode(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "ch").limit(max_size - 3).select("ch", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "ch")) + 2).cast("long").alias("rank"))


def balanced_weights(counts: DataFrame, cap: float = 8.0) -> DataFrame:
    """(label, n, weight): capped square roots of inverse shares, scaled to a mean of one."""
    w = Window.partitionBy(F.lit(1))  # a handful of labels
    raw = F.least(F.lit(cap), F.sqrt(F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))))
    return counts.withColumn("raw", raw).select("label", "n", F.round(F.col("raw") / F.avg("raw").over(w), 6).alias("weight"))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) of label pairs (g, p)."""
    gold = pairs.groupBy(F.col("g").alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count(F.when(F.col("g") == F.col("p"), 1)).alias("correct"))
    predicted = pairs.groupBy(F.col("p").alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    m = gold.join(predicted, "label", "full_outer").fillna(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return m.select("label", "support", F.round(share("correct", "predicted"), 6).alias("precision"), F.round(share("correct", "support"), 6).alias("recall"), F.round(F.when(F.col("correct") > 0, 2 * F.col("correct") / (F.col("predicted") + F.col("support"))).otherwise(0.0), 6).alias("f1"))


def boundary_metrics(rows: DataFrame) -> DataFrame:
    """One row over (key, gm, gq, pm, pq): accuracies of boundaries, insertions, events found, and whole quote sequences."""
    event, found = (F.col("gm") > 0) | (F.col("gq") > 0), (F.col("pm") > 0) | (F.col("pq") > 0)
    exact = (F.col("gm") == F.col("pm")) & (F.col("gq") == F.col("pq"))
    n = lambda c: F.count(F.when(c, 1))
    texts = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("b"), n(exact).alias("x"), n(event).alias("e"), n(event & exact).alias("ex"), n(~event & found).alias("ins"), n(event & found).alias("tp"), n(found).alias("f"), F.min((F.col("gq") == F.col("pq")).cast("int")).alias("same")
    )
    total = texts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("b", "x", "e", "ex", "ins", "tp", "f", "same")], F.count(F.lit(1)).alias("texts"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    c = F.col
    return total.select(
        "texts", c("b").alias("boundaries"), share(c("x"), c("b")).alias("accuracy"), share(c("ex"), c("e")).alias("event_accuracy"), share(c("ins"), c("b") - c("e")).alias("insertion_rate"),
        share(c("tp"), c("f")).alias("event_precision"), share(c("tp"), c("e")).alias("event_recall"), share(2 * c("tp"), c("f") + c("e")).alias("event_f1"), share(c("same"), c("texts")).alias("quotes_exact"),
    )

