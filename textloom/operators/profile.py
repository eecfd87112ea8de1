"""The second summary profile: tag-based signals, compact text, enumerations kept whole, its own weights. Tokens are (rid, i, word, tag)
and cover their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions.signals import discourse_score, signal_count

PUNCTUATION_TAG = "CATEGORY$"
#: Weights of the signals, of the clauses of a long block, and the size from which a block is long.
TAG_WEIGHTS = {"proper_tag": 0.55, "money": 0.35, "date": 0.30, "quantity": 0.25, "number": 0.20, "acronym": 0.10, "object": 0.05, "proper": 0.05}
CLAUSE_WEIGHTS, LONG_CHARS, LONG_WORDS = (0.35, 0.50, 0.15), 80, 60
BLOCK_WEIGHTS = {"relevance": (0.7, 0.3), "final": (0.35, 0.30, 0.10, 0.05, 0.20)}


def removable(word: Column, tag: Column) -> Column:
    """Adverbs, conjunctions, interjections and particles of emotion, but for function words that carry meaning."""
    short = tag.rlike("^(?:D|Da|Dfa|Dfb|Di|Dk|Caa|Cab|Cba|Cbb|I)$") | ((tag == "T") & word.isin(*spec.INTERJECTIONS))
    return F.coalesce(short & ~word.isin(*spec.MEANING_WORDS), F.lit(False))


def compacted(tokens: DataFrame) -> DataFrame:
    """(rid, text, removed): texts without removable tokens, runs of blanks made one; what would be left blank stays as it is."""
    t = tokens.withColumn("gone", removable(F.col("word"), F.col("tag")))
    joined = lambda keep: F.array_join(F.transform(F.filter("x", keep), lambda r: r["word"]), "")
    p = t.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("i", "word", "gone"))).alias("x"))
    p = p.select("rid", joined(lambda r: F.lit(True)).alias("whole"), F.regexp_replace(joined(lambda r: ~r["gone"]), r"[ \t]{2,}", " ").alias("short"), F.size(F.filter("x", lambda r: r["gone"])).alias("n"))
    blank = F.col("short").rlike(f"^[{spec.SPACE}]*\\z") | (F.col("n") == 0)
    return p.select("rid", F.when(blank, F.col("whole")).otherwise(F.col("short")).alias("text"), F.when(blank, 0).otherwise(F.col("n")).cast("long").alias("removed"))


def clause_parts(tokens: DataFrame) -> DataFrame:
    """(rid, part, text, nominal): tokens up to and with a comma, semicolon or full stop; nominal parts are of 1 to 8 characters before the
    punctuation, all nouns, numbers or foreign words."""
    w = Window.partitionBy("rid").orderBy("i")
    ends = F.col("word").rlike("[，,、；;。！？!?]$")
    t = tokens.withColumn("part", F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    p = t.groupBy("rid", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda r: r["word"]), "").alias("text"),
        F.min(F.when(~F.coalesce(F.col("tag").rlike(PUNCTUATION_TAG), F.lit(False)), F.coalesce(F.col("tag").rlike("^(?:N|FW)"), F.lit(False)).cast("int"))).alias("nouns"),
    )
    body = F.length(F.regexp_replace("text", r"[，,、；;。！？!?…\s]+\z", ""))
    return p.select("rid", "part", "text", (F.coalesce(F.col("nouns") == 1, F.lit(False)) & body.between(1, 8)).alias("nominal"))


def merged_enumerations(parts: DataFrame) -> DataFrame:
    """(rid, first, last, text): runs of two or more nominal parts with the part before them are one part. Ranges that touch are one:
    the islands of parts that are in any range."""
    w = Window.partitionBy("rid").orderBy("part")
    p = parts.withColumn("run", F.sum((~F.col("nominal")).cast("int")).over(w))
    p = p.withColumn("long", F.col("nominal") & (F.sum(F.col("nominal").cast("int")).over(Window.partitionBy("rid", "run")) >= 2))
    p = p.withColumn("inside", F.col("long") | F.coalesce(F.lead("long").over(w), F.lit(False)))
    fresh = (~F.col("inside")) | ~F.coalesce(F.lag("inside").over(w), F.lit(False))
    p = p.withColumn("island", F.sum(fresh.cast("int")).over(w))
    g = p.groupBy("rid", "island").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("x"))
    return g.select("rid", "first", "last", F.array_join(F.transform("x", lambda r: r["text"]), "").alias("text"))


def tag_signal_score(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(rid, score): the weights of the signals found by pattern in a text (rid, text) or by tag among its tokens, at most 1."""
    has = lambda p: F.max(F.coalesce(F.col("tag").rlike(p), F.lit(False)).cast("int"))
    tags = tokens.groupBy("rid").agg(has("^N[bc]").alias("proper_tag"), has("^Nd").alias("date"), has("^Neu").alias("number"), has("^Neq").alias("quantity"))
    t = texts.join(tags, "rid", "left")
    text = F.col("text")
    found = {n: (signal_count(text, n) > 0) for n in ("money", "date", "quantity", "number", "acronym", "object")}
    found["proper"] = (signal_count(text, "proper_en") > 0) | (signal_count(text, "proper_cjk") > 0) | (F.col("proper_tag") == 1)
    found["proper_tag"] = F.lit(False)
    for n in ("proper_tag", "date", "number", "quantity"):
        found[n] = found[n] | F.coalesce(F.col(n) == 1, F.lit(False))
    score = sum((F.coalesce(found[n], F.lit(False)).cast("int") * F.lit(w) for n, w in TAG_WEIGHTS.items()), F.lit(0.0))
    return t.select("rid", F.round(F.least(F.lit(1.0), score), 6).alias("score"))


def compressed(parts: DataFrame, limit: int = 2) -> DataFrame:
    """(rid, part, score, kept) of the parts of long texts (rid, part, text, signal): at least three parts, and over 80 characters or 60 Latin
    words; the best ``limit``, but at most half of them, are kept."""
    whole = Window.partitionBy("rid")
    words = F.sum(F.regexp_count("text", F.lit("[A-Za-z][A-Za-z'-]*"))).over(whole)
    p = parts.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("chars", F.sum(F.length("text")).over(whole)).withColumn("words", words)
    p = p.where((F.col("n") >= 3) & ((F.col("chars") > LONG_CHARS) | (F.col("words") > LONG_WORDS)))
    place = F.row_number().over(whole.orderBy("part")) - 1
    d, s, q = CLAUSE_WEIGHTS
    p = p.withColumn("place", place).withColumn("score", F.round(d * discourse_score(F.col("text")) + s * F.col("signal") + q * (1 - F.col("place") / F.col("n") * 0.25), 6))
    best = F.row_number().over(whole.orderBy(F.desc("score"), "place"))
    return p.select("rid", "part", "score", (best <= F.greatest(F.lit(1), F.least(F.lit(limit), F.ceil(F.col("n") / 2)))).alias("kept"))
