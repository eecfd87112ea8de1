"""Model training as aggregates: sequences, first- and second-order counts, smoothing, dictionary evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions.text import bmes_shape

# Which state may follow which.
LEGAL_NEXT = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}
MIN_LOG = -3.14e100


def sequences(tokens: DataFrame, keys: list[str], is_word: Column) -> DataFrame:
    """Maximal runs of words: adds ``seq``, a number that is the same within a run. Other tokens are dropped.

    A run is found by its distance to the count of breaks before it (gaps and islands) within one text.
    """
    order = Window.partitionBy(*keys).orderBy("i")
    breaks = F.sum((~F.coalesce(is_word, F.lit(False))).cast("int")).over(order)
    return tokens.withColumn("seq", breaks).where(is_word)


def states(seq: DataFrame, keys: list[str]) -> DataFrame:
    """Characters of the sequences with state, tag and the two states before: one row a character."""
    word = seq.select(*keys, "seq", "i", "word", "tag", F.posexplode(F.split(bmes_shape(F.col("word")), "")).alias("n", "state")).where("state <> ''")
    ch = word.withColumn("ch", F.expr("substring(word, n + 1, 1)"))
    w = Window.partitionBy(*keys, "seq").orderBy("i", "n")
    return ch.withColumn("s1", F.lag("state", 1).over(w)).withColumn("s2", F.lag("state", 2).over(w)).withColumn("joint", F.concat_ws("-", "state", "tag")).withColumn("j1", F.lag("joint", 1).over(w)).withColumn("j2", F.lag("joint", 2).over(w))


def counts(st: DataFrame, *columns: str) -> DataFrame:
    """Counts of combinations of columns without nulls."""
    keep = st
    for c in columns:
        keep = keep.where(F.col(c).isNotNull())
    return keep.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def starts(st: DataFrame, state: str = "state", before: str = "s1") -> DataFrame:
    return st.where(F.col(before).isNull()).groupBy(state).agg(F.count(F.lit(1)).alias("n"))


def smooth_transitions(trans: DataFrame, alpha: float = 0.1) -> DataFrame:
    """log P(state | s1) over the legal next states, additively smoothed: (s1, state, n, logp)."""
    spark = trans.sparkSession
    legal = spark.createDataFrame([(a, b) for a, bs in LEGAL_NEXT.items() for b in bs], "s1 string, state string")
    full = legal.join(trans, ["s1", "state"], "left").fillna(0, ["n"])
    row = Window.partitionBy("s1")
    return full.select("s1", "state", "n", F.round(F.log((F.col("n") + alpha) / (F.sum("n").over(row) + alpha * F.count(F.lit(1)).over(row))), 6).alias("logp"))


def smooth_emissions(emit: DataFrame, alpha: float = 0.1) -> DataFrame:
    """log P(ch | state) over the vocabulary and one unknown: rows of seen pairs and '<UNK>' for each state."""
    vocabulary = emit.agg(F.countDistinct("ch").alias("v"))
    totals = emit.groupBy("state").agg(F.sum("n").alias("total"))
    seen = emit.select("state", "ch", "n").unionByName(totals.select("state", F.lit("<UNK>").alias("ch"), F.lit(0).cast("long").alias("n")))
    out = seen.join(totals, "state").crossJoin(F.broadcast(vocabulary))  # one row
    return out.select("state", "ch", "n", F.round(F.log((F.col("n") + alpha) / (F.col("total") + alpha * (F.col("v") + 1))), 6).alias("logp"))


def grouped(counts_: DataFrame, word: str, key: str) -> DataFrame:
    """(word, map of key to count)."""
    return counts_.groupBy(word).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"))


def evidence(word_pos: DataFrame, word_entity: DataFrame) -> DataFrame:
    """Support, primary tag, confidence and margin of every word, and the same for its entity labels; a word without
    tags takes the default tags of its labels. Full outer join of two aggregates."""
    inferred = word_entity.join(word_pos.select("word").distinct(), "word", "left_anti")
    default = F.create_map(*[F.lit(x) for kv in spec.ENTITY_TAG.items() for x in kv])
    inferred = inferred.select("word", F.coalesce(default[F.col("label")], F.when(F.col("label").isin(*spec.NAMED_ENTITIES), F.lit("Na"))).alias("pos"), "n").where("pos IS NOT NULL").groupBy("word", "pos").agg(F.sum("n").alias("n"))
    pos = word_pos.select("word", "pos", "n").unionByName(inferred)
    ranked = pos.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "pos")))
    p = ranked.groupBy("word").agg(F.sum("n").alias("support"), F.max(F.when(F.col("r") == 1, F.col("pos"))).alias("primary_pos"), F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n1"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("n"))), F.lit(0)).alias("n2"))
    e = word_entity.groupBy("word").agg(F.sum("n").alias("entity_support"), F.max("n").alias("e1"))
    j = p.join(e, "word", "full_outer").where("support IS NOT NULL")
    return j.select(
        "word", "support", "primary_pos", F.round(F.col("n1") / F.col("support"), 6).alias("confidence"), F.round((F.col("n1") - F.col("n2")) / F.col("support"), 6).alias("margin"),
        F.coalesce("entity_support", F.lit(0)).cast("long").alias("entity_support"), F.coalesce(F.round(F.col("e1") / F.col("entity_support"), 6), F.lit(0.0)).alias("entity_confidence"),
    )


def dictionary_reason(min_support: int = 10, pos_confidence: float = 0.8, pos_margin: float = 0.2, entity_support: int = 2, entity_confidence: float = 0.8) -> Column:
    c = F.col
    return (
        F.when(c("support") < min_support, "insufficient-support")
        .when((c("confidence") >= pos_confidence) & (c("margin") >= pos_margin), "accepted-general")
        .when((c("entity_support") >= entity_support) & (c("entity_confidence") >= entity_confidence) & (c("confidence") >= pos_confidence), "accepted-entity")
        .when(c("confidence") < pos_confidence, "ambiguous-pos")
        .when((c("margin") < pos_margin) & (c("entity_support") < entity_support), "small-pos-margin")
        .otherwise("ambiguous-entity")
    )


def clamp_log(v: Column) -> Column:
    """A log probability as a float; what is not finite or below -1e29 is the sentinel -1e30."""
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < -1e29), F.lit(-1e30)).otherwise(v).cast("float")


def quantise(df: DataFrame, value: str) -> DataFrame:
    """16-bit codes of log probabilities: adds ``code`` and the ``decoded`` value; the impossible is -32768. The scale is one
    aggregate of all rows, joined back as one row."""
    finite = F.when(F.col(value) > -1e29, F.col(value))
    scale = F.col("_scale")
    code = F.when(finite.isNull(), -32768).when(scale == 0, 0).otherwise(F.greatest(F.lit(-32767), F.least(F.lit(32767), F.round(finite / scale))))
    top = df.agg((F.max(F.abs(finite)) / 32767).alias("_scale"))
    out = df.crossJoin(F.broadcast(top)).withColumn("code", code.cast("int"))  # one row
    return out.withColumn("decoded", F.round(F.when(F.col("code") == -32768, F.lit(-1e30)).otherwise(F.col("code") * scale), 6)).drop("_scale")


def dense_transitions(trans2: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(s2, s1, state, logp): all 64 second-order transitions as floats, smoothed over the legal ones, the others the sentinel."""
    spark = trans2.sparkSession
    legal = lambda a, b: b in LEGAL_NEXT[a]
    every = [(a, b, c, legal(a, b) and legal(b, c)) for a in LEGAL_NEXT for b in LEGAL_NEXT for c in LEGAL_NEXT]
    full = spark.createDataFrame(every, "s2 string, s1 string, state string, legal boolean").join(trans2, ["s2", "s1", "state"], "left").fillna(0, ["n"])
    row = Window.partitionBy("s2", "s1")
    value = F.log((F.col("n") + alpha) / (F.sum("n").over(row) + 2 * alpha))
    return full.select("s2", "s1", "state", clamp_log(F.when(F.col("legal"), F.round(value, 5)).otherwise(F.lit(-1e30))).alias("logp"))


def emission_rows(emit: DataFrame, key: str, alpha: float = 0.1) -> DataFrame:
    """(ch, states, logps): for every character the states it is emitted from and their log probabilities, in the order of the states.
    What is not listed is unknown to the state."""
    vocabulary = emit.agg(F.countDistinct("ch").alias("v"))
    totals = emit.groupBy(key).agg(F.sum("n").alias("total"))
    e = emit.join(totals, key).crossJoin(F.broadcast(vocabulary))  # one row
    e = e.withColumn("logp", F.round(F.log((F.col("n") + alpha) / (F.col("total") + alpha * (F.col("v") + 1))), 4))
    g = e.groupBy("ch").agg(F.array_sort(F.collect_list(F.struct(key, "logp"))).alias("x"))
    return g.select("ch", F.transform("x", lambda r: r[key]).alias("states"), F.transform("x", lambda r: r["logp"]).alias("logps"))
