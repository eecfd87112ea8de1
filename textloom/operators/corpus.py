"""Corpus preparation, validation and evaluation as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions.text import dedupe_key, divide0, record_id, stable_digest, stable_mod

PII = spec.PII


def quality_rejection(text: Column, min_chars: int = 4, min_han_ratio: float = 0.35) -> Column:
    """The first reason to reject a text, or null."""
    visible = F.length(F.regexp_replace(text, F.lit(f"[{spec.SPACE}]"), F.lit("")))
    han = F.length(F.regexp_replace(text, F.lit(f"[^{spec.HAN_PIPE}]"), F.lit("")))
    lower = F.lower(text)
    return (
        F.when(F.length(text) < min_chars, "too_short")
        .when(F.contains(text, F.lit("�")), "replacement_character")
        .when(text.rlike(PII), "suspected_pii")
        .when(F.contains(text, F.lit("```")) | F.contains(lower, F.lit("<script")) | F.contains(lower, F.lit("function(")), "code_like")
        .when(visible == 0, "empty")
        .when(han / visible < min_han_ratio, "low_han_ratio")
    )


def dedup(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row by ``order`` of every key, with the number of copies. One aggregate, combined before the
    shuffle, so that a text that makes up a third of all rows is no hot group."""
    return df.groupBy(F.md5(key).alias("k")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies")).drop("k")


def assign_split(seed: int, source: Column, document: Column) -> Column:
    bucket = stable_mod([F.lit(str(seed)), source, document], 1000)
    return F.when(bucket < 980, "train").when(bucket < 990, "dev").otherwise("test")


def text_split(text: Column) -> Column:
    """By the first eight bytes of the text's SHA-256, modulo 10,000."""
    h = F.sha2(text, 256)
    part = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    bucket = (part(1) % 10000 * 4294967296 + part(9)) % 10000
    return F.when(bucket < 9800, "train").when(bucket < 9900, "dev").otherwise("test")


def stable_sample(df: DataFrame, group: str, parts: list[Column], tie: str, limit: int) -> DataFrame:
    """The ``limit`` rows of every group with the lowest hashes (a top-k of a window, limited before the shuffle)."""
    ranked = df.withColumn("__h", stable_digest(parts)).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("__h", tie)).cast("long"))
    return ranked.where(F.col("rank") <= limit).drop("__h")


def select_records(df: DataFrame, seed: int, limit: int) -> DataFrame:
    """Quality filter, keep-first deduplication, stable sample per source and split of (row_id, source_id,
    document_id, id, text)."""
    ok = df.where(quality_rejection(F.col("text")).isNull())
    first = dedup(ok, dedupe_key(F.col("text")), "row_id").select("row_id")
    kept = ok.join(first, "row_id", "left_semi").drop("text")
    sample = stable_sample(kept, "source_id", [F.lit(str(seed)), F.col("source_id"), F.col("id")], "row_id", limit)
    return sample.withColumn("split", assign_split(seed, F.col("source_id"), F.col("document_id")))


def make_records(df: DataFrame, seed: int) -> DataFrame:
    """Adds ``id`` and ``split`` to (source_id, document_id, segment_index, text)."""
    parts = [F.col("source_id"), F.col("document_id"), F.col("segment_index").cast("string"), F.col("text")]
    return df.withColumn("id", record_id(parts)).withColumn("split", assign_split(seed, F.col("source_id"), F.col("document_id")))


def unpivot_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per non-blank field: (key, field, text)."""
    return df.unpivot(key, fields, "field", "text").where("trim(text) <> ''")


def validate_records(df: DataFrame) -> DataFrame:
    """Rows (row_id, error) of every violated rule; one pass and one window by id."""
    tokens = F.col("review.tokens")
    accepted = F.coalesce(F.col("review.status") == "accepted", F.lit(False))
    texts = F.transform(F.coalesce(tokens, F.array().cast("array<struct<text:string,pos:string>>")), lambda k: k["text"])
    has = F.coalesce(F.size(tokens) > 0, F.lit(False))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("row_id"))
    rules = {
        "schema_version": ~F.coalesce(F.col("schema_version") == 1, F.lit(False)),
        "duplicate_id": F.col("__nth") > 1,
        "split": ~F.coalesce(F.col("split").isin("train", "dev", "test"), F.lit(False)),
        "text": F.coalesce(F.col("text"), F.lit("")) == "",
        "status": ~F.coalesce(F.col("review.status").isin("pending", "accepted", "rejected"), F.lit(False)),
        "tokens": accepted & ~has,
        "token_text": accepted & has & F.exists(texts, lambda t: F.coalesce(t, F.lit("")) == ""),
        "han_pos": accepted & has & F.exists(tokens, lambda k: F.coalesce(k["text"].rlike(f"^[{spec.HAN_PIPE}]+\\z"), F.lit(False)) & (F.coalesce(F.trim(k["pos"]), F.lit("")) == "")),
        "reconstruct": accepted & has & (F.array_join(texts, "") != F.col("text")),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("__nth", nth).select("row_id", F.explode(found).alias("error"))


def split_max(df: DataFrame, key: str, text: str, max_chars: int = 500) -> DataFrame:
    """Sentences by closing punctuation and lines, stripped, wrapped hard at ``max_chars``: (key, sent_no, part, text)."""
    found = F.regexp_extract_all(text, F.lit(r"[^。！？!?；;\n]*[。！？!?；;\n]+|[^。！？!?；;\n]+"), F.lit(0))
    s = df.select(key, F.posexplode(found).alias("sent_no", "t"))
    s = s.select(key, F.col("sent_no").cast("long").alias("sent_no"), F.regexp_replace(F.regexp_replace("t", r"^[ \t\r\f\n]+", ""), r"[ \t\r\f\n]+\z", "").alias("t")).where("t <> ''")
    parts = F.sequence(F.lit(0), F.ceil(F.length("t") / max_chars).cast("int") - 1)
    return s.select(key, "sent_no", "t", F.explode(parts).alias("part")).select(key, "sent_no", F.col("part").cast("long").alias("part"), F.expr(f"substring(t, part * {max_chars} + 1, {max_chars})").alias("text"))


# ---------------------------------------------------------------- evaluation
def token_spans(df: DataFrame) -> DataFrame:
    """(id, i, word, pos, a, b) of non-empty tokens with their offsets in the joined text."""
    t = df.select("id", F.posexplode("tokens").alias("i", "k")).select("id", "i", F.col("k.text").alias("word"), F.col("k.pos").alias("pos")).where("word <> ''")
    end = F.sum(F.length("word")).over(Window.partitionBy("id").orderBy("i")).cast("long")
    return t.withColumn("b", end).withColumn("a", F.col("b") - F.length("word"))


def comparable(gold: DataFrame, predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their tool, of the records whose tokens join to the same text. ``gold``: (id, i, word, pos, a, b),
    ``predicted`` with a ``tool`` as well."""
    text = lambda x, *keys: x.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda w: w["word"]), "").alias("t"))
    same = text(predicted, "tool", "id").join(text(gold, "id"), ["id", "t"]).select("tool", "id")
    return gold.join(same, "id"), predicted.join(same, ["tool", "id"], "left_semi")


def segmentation_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row for each tool of word and boundary precision, recall and F1 and the share of exact records, over the records whose
    tokens join to the same text. ``gold``: (id, i, word, pos, a, b), ``predicted`` with a ``tool`` as well."""
    g, p = (x.select("tool", "id", "a", "b") for x in comparable(gold, predicted))
    both = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), ["tool", "id", "a", "b"], "full_outer")
    ends = g.join(p, ["tool", "id", "b"]).groupBy("tool", "id").agg(F.count(F.lit(1)).alias("ends"))
    each = both.groupBy("tool", "id").agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("correct")).join(ends, ["tool", "id"], "left")
    exact = F.count(F.when((F.col("gold") == F.col("predicted")) & (F.col("gold") == F.col("correct")), 1))
    t = each.groupBy("tool").agg(F.count(F.lit(1)).alias("records"), F.sum("gold").alias("gold"), F.sum("predicted").alias("predicted"), F.sum("correct").alias("correct"), F.sum("ends").alias("ends"), exact.alias("exact"))
    c, n = F.col, F.col("records")  # the end of a text is no boundary
    share = lambda a, b: F.round(divide0(a, b), 6)
    return t.select(
        "tool", "records", share(c("correct"), c("predicted")).alias("word_precision"), share(c("correct"), c("gold")).alias("word_recall"), share(2 * c("correct"), c("gold") + c("predicted")).alias("word_f1"),
        share(c("ends") - n, c("predicted") - n).alias("boundary_precision"), share(c("ends") - n, c("gold") - n).alias("boundary_recall"), share(2 * (c("ends") - n), c("gold") + c("predicted") - 2 * n).alias("boundary_f1"), share(c("exact"), n).alias("exact_share"),
    )


def tag_accuracy(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(tool, total, correct, accuracy) of the tags on spans that both sides have; gold tokens without a tag are left out."""
    hit = gold.where("pos IS NOT NULL").select("id", "a", "b", F.col("pos").alias("g")).join(predicted.select("tool", "id", "a", "b", F.col("pos").alias("p")), ["id", "a", "b"])
    t = hit.groupBy("tool").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("g") == F.col("p"), 1)).alias("correct"))
    return t.select("tool", "total", "correct", F.round(divide0(F.col("correct"), F.col("total")), 6).alias("accuracy"))


def segmentation_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row for each tool of the counts behind ``segmentation_metrics``."""
    g, p = (x.select("tool", "id", "a", "b") for x in comparable(gold, predicted))
    both = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), ["tool", "id", "a", "b"], "full_outer")
    each = both.groupBy("tool", "id").agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("correct"))
    exact = F.count(F.when((F.col("gold") == F.col("predicted")) & (F.col("gold") == F.col("correct")), 1))
    return each.groupBy("tool").agg(F.count(F.lit(1)).alias("records"), *[F.sum(c).alias(c) for c in ("gold", "predicted", "correct")], exact.alias("exact"))


def median_speed(runs: DataFrame, sentences: int) -> DataFrame:
    """(tool, runs, median_seconds, sentences_per_second) of runs (tool, seconds) over as many sentences each."""
    t = runs.groupBy("tool").agg(F.count(F.lit(1)).alias("runs"), F.percentile("seconds", 0.5).alias("m"))
    return t.select("tool", "runs", F.round("m", 6).alias("median_seconds"), F.round(sentences / F.col("m"), 4).alias("sentences_per_second"))
