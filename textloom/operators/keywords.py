"""Keywords and keyphrases: window co-occurrence, graph ranking per document, proper-noun fusion and capped top-k."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, DAMPING, ITERATIONS, PROPER_WEIGHT, PROPER_SHARE = 5, 0.85, 10, 0.3, 0.4


def candidates(tokens: DataFrame, allowed: Column, proper: Column, min_chars: int = 2) -> DataFrame:
    """(doc, word, tf, first, proper) of tokens (doc, i, word, tag): allowed tags of at least ``min_chars``."""
    t = tokens.where((F.length("word") >= min_chars) & (allowed | proper))
    return t.groupBy("doc", "word").agg(F.count(F.lit(1)).alias("tf"), F.min("i").alias("first"), F.coalesce(F.bool_or(proper), F.lit(False)).alias("proper"))


def cooccurrence(tokens: DataFrame, allowed: Column, proper: Column, window: int = WINDOW, min_chars: int = 2) -> DataFrame:
    """Directed pairs (doc, a, b, n) of candidates less than ``window`` tokens apart; positions count all tokens.

    Each candidate is paired with those in a frame behind it (a range of positions), so a document of n tokens costs
    n times the window, not n squared, and is never shuffled as pairs of itself.
    """
    t = tokens.where((F.length("word") >= min_chars) & F.coalesce(allowed | proper, F.lit(False)))
    frame = Window.partitionBy("doc").orderBy("i").rangeBetween(1, max(2, window) - 1)
    near = t.withColumn("after", F.collect_list("word").over(frame)).select("doc", F.col("word").alias("a"), F.explode("after").alias("b"))
    return near.groupBy("doc", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def adjacency(pairs: DataFrame) -> DataFrame:
    """Undirected weights: each directed pair counts both ways, a self-pair twice; with the row's sum."""
    both = pairs.select("doc", "a", "b", "n").unionAll(pairs.select("doc", F.col("b"), F.col("a"), "n"))
    w = both.groupBy("doc", "a", "b").agg(F.sum("n").alias("n"))
    return w.withColumn("out", F.sum("n").over(Window.partitionBy("doc", "a")))


def textrank(cands: DataFrame, adj: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(doc, word, tf, first, proper, weight): ten in-place passes in the order of first occurrence, per document.

    The order matters (each node uses the values that were already updated), so a document is one group; groups
    are single documents, and the graph's size is bounded by the document's tokens times the window.
    """
    edges = adj.groupBy("doc", F.col("a").alias("word")).agg(F.collect_list("b").alias("to"), F.collect_list("n").alias("n"), F.first("out").alias("out"))
    rows = cands.join(edges, ["doc", "word"], "left").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "word", "tf", "proper", "to", "n", "out"))).alias("nodes"))
    kind = cands.schema["doc"].dataType.simpleString()

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, nodes in zip(pdf["doc"], pdf["nodes"]):
                at = {r["word"]: i for i, r in enumerate(nodes)}
                ws, total = [1.0 / len(at)] * len(at), [r["out"] or 1 for r in nodes]
                links = [[(at[b], n) for b, n in sorted(zip(r["to"], r["n"])) if b in at] if r["to"] is not None else [] for r in nodes]
                for _ in range(iterations):
                    for i, link in enumerate(links):
                        ws[i] = (1 - damping) + damping * sum(n / total[j] * ws[j] for j, n in link)
                out += [(doc, r["word"], r["tf"], r["first"], r["proper"], w) for r, w in zip(nodes, ws)]
            yield pd.DataFrame(out, columns=["doc", "word", "tf", "first", "proper", "weight"])

    return rows.mapInPandas(rank, f"doc {kind}, word string, tf bigint, first bigint, proper boolean, weight double")


def minmax(ranked: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc")
    lo, hi = F.min("weight").over(w), F.max("weight").over(w)
    return ranked.withColumn("base", F.coalesce(F.try_divide(F.col("weight") - lo / 10, hi - lo / 10), F.lit(0.0)))


def proper_scores(cands: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds ``entity``: frequency and early place of proper nouns, in [0, 1]."""
    size = tokens.groupBy("doc").agg(F.count(F.lit(1)).alias("tokens"))
    top = F.max(F.when(F.col("proper"), F.col("tf"))).over(Window.partitionBy("doc"))
    place = F.when(F.col("tokens") > 1, F.col("first") / (F.col("tokens") - 1)).otherwise(0.0)
    entity = F.when(F.col("proper"), 0.7 * F.log1p("tf") / F.log1p(top) + 0.3 * (1 - place)).otherwise(0.0)
    return cands.join(size, "doc").withColumn("entity", entity).drop("tokens")


def capped_top(scored: DataFrame, k: int, share: float = PROPER_SHARE) -> DataFrame:
    """The best ``k`` a document by score, then word; at most ceil(k * share) proper nouns unless others run out."""
    cap = -(-int(k * share * 1000) // 1000)
    order = [F.desc("score"), F.col("word")]
    r = scored.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "proper").orderBy(*order)))
    r = r.withColumn("late", F.col("proper") & (F.col("nth") > cap))
    r = r.withColumn("pick", F.row_number().over(Window.partitionBy("doc").orderBy("late", *order))).where(F.col("pick") <= k)
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(*order)).cast("long")).drop("nth", "late", "pick")


def keywords(tokens: DataFrame, allowed: Column, proper: Column, k: int = 10) -> DataFrame:
    """(doc, rank, word, score) of every document."""
    c = candidates(tokens, allowed, proper)
    ranked = minmax(textrank(c, adjacency(cooccurrence(tokens, allowed, proper))))
    fused = proper_scores(ranked, tokens).withColumn("score", F.round(F.col("base") + PROPER_WEIGHT * (1 - F.col("base")) * F.col("entity"), 6))
    return capped_top(fused, k).select("doc", "rank", "word", "score")


def keyword_runs(tokens: DataFrame, keys: DataFrame, max_terms: int = 4) -> DataFrame:
    """(doc, run, part, phrase, mean, terms): adjacent keywords form runs, cut into phrases of two to ``max_terms``."""
    t = tokens.join(keys.select("doc", "word", "score"), ["doc", "word"])
    order = Window.partitionBy("doc").orderBy("i")
    t = t.withColumn("run", F.col("i") - F.row_number().over(order))
    t = t.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("doc", "run").orderBy("i")) - 1) / max_terms))
    return t.groupBy("doc", "run", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), "").alias("phrase"), F.avg("score").alias("mean"), F.count(F.lit(1)).alias("terms")).where("terms >= 2")


def keyphrases(tokens: DataFrame, keys: DataFrame, max_terms: int = 4) -> DataFrame:
    """(doc, phrase, occurrences, weight) of the runs of keywords."""
    p = keyword_runs(tokens, keys, max_terms)
    weight = F.max("mean") * (1 + 0.1 * (F.max("terms") - 1)) * (1 + 0.1 * F.log1p(F.count(F.lit(1))))
    return p.groupBy("doc", "phrase").agg(F.count(F.lit(1)).alias("occurrences"), F.round(weight, 6).alias("weight"))
