"""Dictionaries, lexicons and affect: lookups, overrides and validation as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import norm_text


def dict_matches(df: DataFrame, key: str, text: str, dictionary: DataFrame, least: int = 2) -> DataFrame:
    """All occurrences, overlapping ones included, of the words of ``least`` characters or more of a dictionary:
    (key, start, word and the dictionary's columns).

    Positions meet the dictionary by their first ``least`` characters; only the lengths of words that begin with them are
    tried. Spark broadcasts either table if its measured size allows, else both sides are shuffled. Null texts
    and words give no rows; a word that the dictionary has twice gives its rows twice.
    """
    longest = dictionary.agg(F.max(F.length("word"))).first()[0] or least
    longest = max(longest, least)
    heads = dictionary.where(F.length("word") >= least).groupBy(F.substring("word", 1, least).alias("head")).agg(F.array_sort(F.collect_set(F.length("word"))).alias("lengths"))  # at most one entry a length
    # A look-ahead matches at every position, so one linear scan gives the windows; their prefixes are the candidates.
    windows = F.regexp_extract_all(norm_text(F.col(text)), F.lit(f"(?s)(?=(.{{{least},{longest}}}))"), F.lit(1))
    at = df.select(F.col(key).alias("_key"), F.posexplode(windows).alias("_at", "_window")).withColumn("head", F.substring("_window", 1, least))
    tried = at.join(heads, "head").select("_key", "_at", "_window", F.explode(F.filter("lengths", lambda n: n <= F.length("_window"))).alias("_size"))
    hits = tried.select("_key", F.col("_at").cast("long").alias("start"), F.expr("substring(_window, 1, _size)").alias("word"))
    return hits.join(dictionary, "word").withColumnRenamed("_key", key)


def install_user(base: DataFrame, user: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Base dictionary (word, freq, tag) overlaid by user entries (line, word, freq, tag): the last valid line wins
    (2 to 255 characters, a finite positive frequency; tag Na by default) and log probabilities are taken over the
    new total. ``keep`` names columns that stay besides."""
    u = user.withColumn("word", norm_text(F.col("word"))).where((F.length("word").between(2, 255)) & (F.col("freq") > 0) & ~F.isnan("freq") & (F.col("freq") < float("inf")))
    u = u.groupBy("word").agg(F.max_by(F.struct("freq", "tag"), "line").alias("e")).select("word", F.col("e.freq").cast("double").alias("freq"), F.coalesce("e.tag", F.lit("Na")).alias("tag"), F.lit(True).alias("is_user"))
    kept = base.join(u.select("word"), "word", "left_anti").select("word", F.col("freq").cast("double").alias("freq"), "tag", F.lit(False).alias("is_user"))
    both = kept.unionByName(u)
    total = both.agg(F.sum("freq").alias("total"))
    return both.crossJoin(F.broadcast(total)).select("word", *keep, "tag", "is_user", F.round(F.log("freq") - F.log("total"), 6).alias("logp"))  # one row


def install_lexicons(entries: DataFrame) -> DataFrame:
    """Winning entry of every word among enabled lexicons (lexicon, load_order, priority, enabled, word): higher
    priority, then later load; its bias is 6 + priority / 2."""
    e = entries.where("enabled").withColumn("word", norm_text(F.col("word")))
    w = Window.partitionBy("word").orderBy(F.desc("priority"), F.desc("load_order"))
    e = e.withColumn("r", F.row_number().over(w)).withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("word")))
    return e.where("r = 1").select("word", "lexicon", F.col("candidates").cast("long").alias("candidates"), (6.0 + F.col("priority") * 0.5).cast("double").alias("bias"))


def polarity(entries: DataFrame, taxonomy: DataFrame, override: str | None = None) -> DataFrame:
    """(word, polarity) of entries (word, emotions, context_dependent): the greatest value of the column ``override`` if there is one, else positive and negative labels give mixed, one
    kind gives itself, a contextual label or a context-dependent entry contextual, nothing neutral."""
    given = F.col(override) if override else F.lit(None).cast("string")
    e = entries.select("word", given.alias("given"), F.coalesce("context_dependent", F.lit(False)).alias("ctx"), F.explode_outer("emotions").alias("id"))
    j = e.join(taxonomy.select("id", F.col("default_polarity").alias("p")), "id", "left")
    has = lambda p: F.coalesce(F.bool_or(F.col("p") == p), F.lit(False))
    a = j.groupBy("word").agg(F.max("given").alias("given"), has("positive").alias("pos"), has("negative").alias("neg"), (has("contextual") | F.bool_or("ctx")).alias("ctx"))
    return a.select("word", F.when(F.col("given").isNotNull(), F.col("given")).when(F.col("pos") & F.col("neg"), "mixed").when(F.col("ctx"), "contextual").when(F.col("pos"), "positive").when(F.col("neg"), "negative").otherwise("neutral").alias("polarity"))


def affect_errors(entries: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Rows (word, error): duplicate words, unknown and disabled labels, no labels."""
    labels = entries.select("word", F.explode("emotions").alias("id")).join(taxonomy.select("id", "enabled"), "id", "left")
    unknown = labels.where("enabled IS NULL").select("word", F.lit("unknown_label").alias("error"))
    disabled = labels.where("NOT enabled").select("word", F.lit("disabled_label").alias("error"))
    duplicate = entries.groupBy("word").count().where("count > 1").select("word", F.lit("duplicate_word").alias("error"))
    empty = entries.where("emotions IS NULL OR size(emotions) = 0").select("word", F.lit("no_label").alias("error"))
    return unknown.unionByName(disabled).unionByName(duplicate).unionByName(empty).distinct()


def frequency_job(state: DataFrame, targets: DataFrame, threshold: int) -> DataFrame:
    """(pending, threshold, runs, targets, known) of a job over (canonical) targets: it runs from ``threshold`` targets that the
    state does not know; one row."""
    pending = targets.join(state.select("canonical"), "canonical", "left_anti").agg(F.count(F.lit(1)).alias("pending"))
    known = state.agg(F.count(F.lit(1)).alias("known"))
    out = pending.crossJoin(targets.agg(F.count(F.lit(1)).alias("targets"))).crossJoin(known)  # one row each
    return out.select("pending", F.lit(threshold).cast("long").alias("threshold"), (F.col("pending") >= threshold).alias("runs"), "targets", "known")
