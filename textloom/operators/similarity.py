"""Terms of texts and similarities within blocks, by an inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import spec

K1, B = 1.2, 0.75


def term_array(text: Column) -> Column:
    """Latin terms in ASCII lower case, Han characters, and Han pairs within a run (pairs overlap: two passes)."""
    lower = F.translate(text, spec.NORM_FROM[:26], spec.NORM_TO[:26])
    latin = F.regexp_extract_all(lower, F.lit("[a-z0-9_.-]+"), F.lit(0))
    han = F.regexp_extract_all(text, F.lit(f"[{spec.HAN_TERMS}]"), F.lit(0))
    pairs = F.regexp_extract_all(text, F.lit(f"(?=([{spec.HAN_TERMS}]{{2}}))"), F.lit(1))
    return F.concat(latin, han, pairs)


def document_terms(df: DataFrame, key: str, text: str, stopwords: DataFrame | None = None, min_chars: int = 1) -> DataFrame:
    """Rows (key, term, tf). Stop words (a column ``word``) are removed by an anti join."""
    t = df.select(key, F.explode(term_array(F.col(text))).alias("term"))
    if min_chars > 1:
        t = t.where((F.length("term") >= min_chars) | F.col("term").rlike(f"^[{spec.HAN_TERMS}]"))
    if stopwords is not None:
        t = t.join(stopwords.select(F.col("word").alias("term")), "term", "left_anti")
    return t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


#: Cells of a product that are held at once.
CELLS = 4_000_000


def _block_pairs(items: DataFrame, similarity) -> DataFrame:
    """(block, a, b, sim), a < b, of the items of a block that share a term.

    Blocks are documents, so a row of the packed table holds one document's terms, as hashes; its pairs are products of small
    matrices (items by terms), in slices of rows and terms of bounded size, instead of a join of every term's postings
    with themselves. Many documents make one Arrow batch, so that a call to Python is not paid for each.
    """
    kinds = items.schema["block"].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    hashed = items.select("block", "id", F.transform(term_array(F.col("text")), lambda t: F.xxhash64(t)).alias("terms")).where("size(terms) > 0")
    packed = hashed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "terms"))).alias("x")).where("size(x) > 1")
    packed = packed.select("block", F.col("x.id").alias("ids"), F.transform("x", lambda r: F.size(r["terms"])).alias("sizes"), F.flatten("x.terms").alias("terms"))

    def pairs(ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = len(ids)
        names, col = np.unique(hashes, return_inverse=True)
        width = len(names)
        cell, tf = np.unique(np.repeat(np.arange(n), sizes) * width + col, return_counts=True)
        row, col, tf = cell // width, cell % width, tf.astype(float)
        facts = similarity(row, col, tf, n, width)
        height = max(1, min(n, CELLS // n))
        step = max(1, min(width, CELLS // n))
        for top in range(0, n, height):
            rows = min(height, n - top)
            ab, ba, shared = np.zeros((rows, n)), np.zeros((rows, n)), np.zeros((rows, n), bool)
            for at in range(0, width, step):
                use = (col >= at) & (col < at + step)
                left, right = np.zeros((n, min(step, width - at))), np.zeros((n, min(step, width - at)))
                left[row[use], col[use] - at] = facts["left"][use]
                right[row[use], col[use] - at] = facts["right"][use]
                ab += left[top : top + rows] @ right.T
                ba += right[top : top + rows] @ left.T
                shared |= ((left[top : top + rows] != 0).astype(np.float32) @ (left != 0).astype(np.float32).T) > 0
            a, b = np.nonzero(shared & (np.arange(n) > np.arange(top, top + rows)[:, None]))
            yield ids[a + top], ids[b], facts["finish"](ab[a, b], ba[a, b], a + top, b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            blocks, a, b, sim, held = [], [], [], [], 0
            for block, ids, sizes, terms in zip(pdf["block"], pdf["ids"], pdf["sizes"], pdf["terms"]):
                for x, y, z in pairs(np.asarray(ids), np.asarray(sizes), np.asarray(terms)):
                    blocks.append(np.full(len(x), block))
                    a.append(x)
                    b.append(y)
                    sim.append(z)
                    held += len(x)
                    if held > CELLS:
                        yield pd.DataFrame({"block": np.concatenate(blocks), "a": np.concatenate(a), "b": np.concatenate(b), "sim": np.concatenate(sim)})
                        blocks, a, b, sim, held = [], [], [], [], 0
            if a:
                yield pd.DataFrame({"block": np.concatenate(blocks), "a": np.concatenate(a), "b": np.concatenate(b), "sim": np.concatenate(sim)})

    out = packed.mapInPandas(run, f"block {kinds[0]}, a {kinds[1]}, b {kinds[1]}, sim double")
    return out.select("block", "a", "b", F.round("sim", 6).alias("sim"))


def _bm25(row, col, tf, n, width):
    length, nterms = np.bincount(row, weights=tf, minlength=n), np.bincount(row, minlength=n)
    df = np.bincount(col, minlength=width)[col]
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
    w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / length.mean()))

    def finish(ab, ba, a, b):
        mean = (ab / nterms[a] + ba / nterms[b]) / 2
        return mean / (1 + mean)

    return {"left": np.ones(len(tf)), "right": w, "finish": finish}


def _cosine(row, col, tf, n, width):
    norm = np.sqrt(np.bincount(row, weights=tf * tf, minlength=n))
    return {"left": tf, "right": tf, "finish": lambda ab, ba, a, b: ab / (norm[a] * norm[b])}


def bm25_pairs(items: DataFrame) -> DataFrame:
    """Symmetric BM25 (k1 1.2, b 0.75) of the items (block, id, text) of each block."""
    return _block_pairs(items, _bm25)


def cosine_pairs(items: DataFrame) -> DataFrame:
    return _block_pairs(items, _cosine)


def global_running(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """``df`` with (rank, run, total): place in the whole order, and the sum of ``value`` up to it and of all.

    Rows are split by ranges of the order; every partition runs its own sums and adds those of the partitions before it, which are
    one row a partition. ``order`` must tell all rows apart.
    """
    from pyspark.sql import Window

    from textloom.session import cut_lineage

    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = cut_lineage(df.repartitionByRange(int(parts), *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    before = Window.orderBy("_part")  # one row a partition
    sums = sums.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_n"), (F.sum("_s").over(before) - F.col("_s")).alias("_s"), F.sum("_s").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    w = Window.partitionBy("_part").orderBy(*order)
    out = ranged.withColumn("rank", F.row_number().over(w)).withColumn("run", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(sums), "_part")  # one row a partition
    return out.withColumn("rank", (F.col("rank") + F.col("_n")).cast("long")).withColumn("run", F.col("run") + F.col("_s")).drop("_part", "_n", "_s")
