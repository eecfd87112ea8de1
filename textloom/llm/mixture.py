"""Problem 7: documents of several sources combined to target shares of the tokens.

A source's copies per document are its target tokens over the tokens it has, at most its cap. The whole part is
taken of every document; the fraction is drawn by the cube method: the flight phase moves the inclusion
probabilities of three documents at a time along the null space of the constraints (tokens and number of documents of
the source), until no three are left undecided. It runs in blocks of bounded size, whose at most two undecided documents
go on to the next round, and the small landing problem at the end is solved by trying all its outcomes. Totals
therefore differ from the targets by a few documents, at any size.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.tokens import DEFAULT_VOCABULARY, token_count
from textloom.session import cut_lineage, table

BLOCK_ROWS = 20_000
_EPS = 1e-9


def flight(sizes: list[float], chances: list[float], seed: int) -> list[float]:
    """Moves inclusion probabilities until at most two are undecided; sums of chances and of size times chance stay."""
    rng, out, active, nxt, n = random.Random(seed), list(chances), [], 0, len(sizes)
    while True:
        while len(active) < 3 and nxt < n:
            if _EPS < out[nxt] < 1 - _EPS:
                active.append(nxt)
            nxt += 1
        if len(active) < 3:
            if len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
                step = (1.0, -1.0)  # alike: both sums can still be kept
            else:
                return out
        else:
            a, b, c = (sizes[i] for i in active)
            step = (b - c, c - a, a - b)
            if step == (0, 0, 0):
                step = (1.0, -1.0, 0.0)
        up = min((1 - out[i]) / u if u > 0 else out[i] / -u for i, u in zip(active, step) if u)
        down = min(out[i] / u if u > 0 else (1 - out[i]) / -u for i, u in zip(active, step) if u)
        move = up if rng.random() * (up + down) < down else -down  # so that expectations stay
        for i, u in zip(active, step):
            out[i] = min(1.0, max(0.0, out[i] + move * u))
            if out[i] < _EPS:
                out[i] = 0.0
            elif out[i] > 1 - _EPS:
                out[i] = 1.0
        active = [i for i in active if 0 < out[i] < 1]


def landing(sizes: list[float], chances: list[float]) -> list[float]:
    """Decides the last few: of all outcomes the one whose total size, then number, is nearest to the expected."""
    undecided = [i for i, p in enumerate(chances) if 0 < p < 1]
    want = sum(sizes[i] * chances[i] for i in undecided)
    number = sum(chances[i] for i in undecided)
    best = min(itertools.product((0.0, 1.0), repeat=len(undecided)), key=lambda x: (abs(sum(s * sizes[i] for s, i in zip(x, undecided)) - want), abs(sum(x) - number)))
    out = list(chances)
    for i, x in zip(undecided, best):
        out[i] = x
    return out


def _fly(seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "id"], ascending=[False, True], kind="stable")  # the undecided rest is small
        sizes, chances = pdf["tokens"].astype(float).tolist(), pdf["chance"].tolist()
        chances = flight(sizes, chances, hash((seed, int(key[1]))))
        pdf["chance"] = landing(sizes, chances) if last else chances
        return pdf

    return run


def cube_sample(rows: DataFrame, counts: dict[str, int], seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (id, source, tokens, chance) with every chance moved to 0 or 1. ``counts``: rows of each source."""
    blocks = {s: max(1, -(-n // block_rows)) for s, n in counts.items()}
    done, schema = None, "id bigint, source string, tokens bigint, chance double"
    rounds = 0
    while True:
        last = all(b == 1 for b in blocks.values())
        number = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("source")] if blocks else F.lit(1)
        step = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed + rounds)), number).cast("int"))
        step = step.groupBy("source", "block").applyInPandas(_fly(seed + rounds, last), schema + ", block int").drop("block")
        if last:
            return step if done is None else done.unionByName(step)
        step = cut_lineage(step)
        decided, rows = step.where("chance IN (0, 1)"), step.where("chance NOT IN (0, 1)")
        done = decided if done is None else done.unionByName(decided)
        blocks = {s: max(1, -(-2 * b // block_rows)) if b > 1 else 1 for s, b in blocks.items()}
        rounds += 1


def mix(docs: DataFrame, key: str, source: str, text: str, plan: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, total_tokens: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(selection, report): rows (id, source, tokens, copies) with at least one copy, and one row per plan source.

    The report has ``target_share, max_repeat, documents, tokens, target_tokens, copies, mixed_tokens, actual_share``
    and ``falls_short`` (every document was taken max_repeat times, and the tokens so mixed stay below the target: read off
    the selection, after the draw). ``total_tokens`` defaults to
    the tokens of all documents of the plan's sources. A source without documents falls short if its target is
    positive. Documents with a null key, a null text or a source outside the plan are left out; a text without
    tokens is taken as it comes and changes no total; repeated rows count as documents of their own; an empty plan
    or table gives an empty selection. ``plan`` (source, target_share, max_repeat) is small by nature: one row per
    source, and its rows are read by the driver; of a source that is planned twice the first row by
    (target_share, max_repeat) holds.
    """
    rules: dict[str, tuple[float, int]] = {}
    for r in plan.where("source IS NOT NULL").orderBy("source", "target_share", "max_repeat").collect():
        rules.setdefault(r["source"], (float(r["target_share"] or 0), int(r["max_repeat"] or 0)))
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("source").isin(*rules))
    rows = cut_lineage(rows.select("id", "source", token_count(F.col("text"), vocabulary).alias("tokens")))
    have = {r["source"]: (r["n"], r["tokens"]) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).collect()}
    total = sum(t for _, t in have.values()) if total_tokens is None else total_tokens
    facts = []
    for s, (share, cap) in rules.items():
        n, tokens = have.get(s, (0, 0))
        want = share * total
        rate = min(float(cap), want / tokens) if tokens else 0.0
        facts.append((s, share, cap, n, tokens, want, rate))
    rates = {f[0]: f[6] for f in facts}
    whole = F.create_map(*[x for s, r in rates.items() for x in (F.lit(s), F.lit(int(r + _EPS)))])[F.col("source")] if rates else F.lit(0)
    part = {s: max(0.0, r - int(r + _EPS)) for s, r in rates.items()}
    part = {s: p for s, p in part.items() if p > _EPS}
    drawn = rows.where(F.col("source").isin(*part)).withColumn("chance", F.create_map(*[x for s, p in part.items() for x in (F.lit(s), F.lit(p))])[F.col("source")]) if part else None
    rest = rows.where(~F.col("source").isin(*part)).withColumn("chance", F.lit(0.0))
    both = rest if drawn is None else rest.unionByName(cube_sample(drawn, {s: have[s][0] for s in part if s in have}, seed))
    selection = both.select("id", "source", "tokens", (whole + F.round("chance")).cast("int").alias("copies")).where("copies > 0")
    taken = selection.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"))
    fixed = spark.createDataFrame([f[:6] for f in facts], "source string, target_share double, max_repeat int, documents bigint, tokens bigint, target_tokens double")
    report = fixed.join(taken, "source", "left").fillna(0, ["copies", "mixed_tokens"])
    mixed = taken.agg(F.sum("mixed_tokens").alias("all_mixed"))
    report = report.crossJoin(F.broadcast(mixed))  # one row
    at_cap = F.col("copies") == F.col("documents") * F.col("max_repeat")
    short = at_cap & ((F.col("mixed_tokens") < F.col("target_tokens")) | (F.col("documents") == 0) & (F.col("target_share") > 0))
    return selection, report.select("source", "target_share", "max_repeat", "documents", "tokens", F.round("target_tokens", 3).alias("target_tokens"), "copies", "mixed_tokens", F.round(F.col("mixed_tokens") / F.greatest("all_mixed", F.lit(1)), 6).alias("actual_share"), short.alias("falls_short"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", table(spark, sf_dir, "mix_plan"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("falls_short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p7_found": p7_found, "p7_report": p7_report, "p7_selection": p7_selection}
ORACLES = {
    "p7_found": """
WITH d AS (SELECT p.source, coalesce(sum(strlen(d.text)), 0) AS t FROM mix_plan p LEFT JOIN documents d ON d.source = p.source GROUP BY p.source),
s AS (SELECT sum(t) AS total FROM d)
SELECT p.source FROM mix_plan p JOIN d USING (source), s WHERE p.max_repeat * d.t < p.target_share * s.total OR (d.t = 0 AND p.target_share > 0)
"""
}
