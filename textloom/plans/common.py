"""Shared inputs of the queries and helpers for their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import norm_text
from textloom.session import table


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviewed").select("row_id", "text")


def gold_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of accepted review records: row_id, i, word, pos."""
    t = table(spark, d, "reviewed").where("review.status = 'accepted'").select("row_id", F.posexplode("review.tokens").alias("i", "k"))
    return t.select("row_id", F.col("i").cast("long").alias("i"), F.col("k.text").alias("word"), F.col("k.pos").alias("pos")).where("word <> ''")


GOLD = "(SELECT row_id, i, k.text AS word, k.pos AS pos FROM (SELECT row_id, unnest(review.tokens) AS k, generate_subscripts(review.tokens, 1) - 1 AS i FROM reviewed WHERE review.status = 'accepted') WHERE k.text <> '')"


def silver(spark: SparkSession, d: str) -> DataFrame:
    """Annotation records once each (repeated deliveries dropped): source, source_index, text, tokens, entities."""
    a = table(spark, d, "annotation").select("source", "source_index", "text", "tokens", "entities", "loaded_at")
    best = a.where("text IS NOT NULL AND tokens IS NOT NULL").groupBy("source", "source_index").agg(F.min_by(F.struct("text", "tokens", "entities"), F.struct("loaded_at", F.to_json("tokens"))).alias("r"))
    return best.select("source", "source_index", "r.*")


def silver_tokens(spark: SparkSession, d: str) -> DataFrame:
    """All tokens of all annotation rows that have them: source, source_index, loaded_at, i, word, tag."""
    a = table(spark, d, "annotation").select("source", "source_index", F.posexplode("tokens").alias("i", "k"))
    return a.select("source", "source_index", F.col("i").cast("long").alias("i"), F.col("k.text").alias("word"), F.col("k.ckip_pos").alias("tag")).where("word <> ''")


SILVER = "(SELECT source, source_index, i, k.text AS word, k.ckip_pos AS tag FROM (SELECT source, source_index, unnest(tokens) AS k, generate_subscripts(tokens, 1) - 1 AS i FROM annotation) WHERE k.text <> '')"

__all__ = ["GOLD", "SILVER", "documents", "gold_tokens", "norm_text", "q", "reviewed", "silver", "silver_tokens", "table"]
