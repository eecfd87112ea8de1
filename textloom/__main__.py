"""Command line: analyses of text files as DataFrames, written as a folder or printed.

    python -m textloom INPUT... [--format words|tsv|jsonl] [--keywords N | --sentences | --clauses | --summary N | --trace | --report]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.api.analysis import Analyzer
from textloom.operators import documents as D
from textloom.operators import segment as S
from textloom.session import local_session
from textloom.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description="Analyses of text files, line by line; summaries and reports take whole files.")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--format", choices=("words", "tsv", "jsonl"), default="words")
    p.add_argument("--model", help="folder of a trained model (tr_build)")
    p.add_argument("--output", help="folder to write to; otherwise the rows are printed")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--keywords", type=int, metavar="N")
    mode.add_argument("--sentences", action="store_true")
    mode.add_argument("--clauses", action="store_true")
    mode.add_argument("--summary", type=int, metavar="N")
    mode.add_argument("--trace", action="store_true")
    mode.add_argument("--report", action="store_true")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(value): the lines of the result."""
    a = Analyzer(spark, S.load_model(files.read_asset(spark, args.model)) if args.model else None)
    if args.summary or args.report:
        whole = files.read_whole(spark, args.inputs).select(F.col("path").alias("id"), "text")
        docs = a.summary(whole, args.summary or 3)
        if args.summary:
            return docs.orderBy("doc").select(F.col("summary").alias("value"))
        return docs.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("documents"), F.sum("input_chars").alias("input_chars"), F.sum("output_chars").alias("output_chars"), F.round(F.avg("reduction"), 4).alias("mean_reduction"))).alias("value"))
    lines = files.numbered_lines(spark, args.inputs).select(F.concat_ws(":", "path", F.lpad(F.col("line_no").cast("string"), 12, "0")).alias("id"), F.col("value").alias("text"))
    if args.sentences or args.clauses:
        column = D.sentences_column if args.sentences else D.clauses_column
        r = lines.select("id", "text", F.posexplode(column(F.col("text"))).alias("n", "r"))
        return r.orderBy("id", "n").select(F.trim(F.expr("substring(text, r.start + 1, r.end - r.start)")).alias("value"))
    if args.trace:
        return lines.select("id", F.explode(S.trace_column(F.col("text"))).alias("r")).orderBy("id", "r.start").select(F.to_json("r").alias("value"))
    if args.keywords:
        k = a.keywords(lines, args.keywords)
        return k.orderBy("doc", "rank").select(F.concat_ws("\t", "word", F.round("score", 6).cast("string")).alias("value"))
    tokens = a.tokens(lines)
    if args.format == "tsv":
        return files.tagged_lines(tokens, "id").orderBy("id").select(F.col("text").alias("value"))
    if args.format == "jsonl":
        return files.token_json(tokens, "id").orderBy("id").select(F.col("line").alias("value"))
    w = tokens.where("trim(word) <> ''").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "word"))).alias("w"))
    return w.orderBy("id").select(F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("value"))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    out = run(spark, args)
    if args.output:
        out.write.mode("overwrite").text(args.output)
        print(json.dumps({"output": args.output}))
    else:
        for r in out.toLocalIterator():
            print(r["value"])


if __name__ == "__main__":
    main()
