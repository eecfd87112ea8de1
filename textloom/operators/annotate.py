"""Annotation by an external tagger that the caller brings: batches of texts in, words and tags out, errors kept row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tagger: texts to (words, tags) of each.
Tagger = Callable[[list[str]], Sequence[tuple[list[str], list[str]]]]
RESULT = "tokens array<struct<text:string,pos:string>>, error string"


def _checked(text: str, words: Sequence[str], tags: Sequence[str]) -> tuple[list[dict] | None, str | None]:
    if len(words) != len(tags):
        return None, f"{len(words)} words but {len(tags)} tags"
    if "".join(words) != text:
        return None, "words do not join to the text"
    return [{"text": w, "pos": t} for w, t in zip(words, tags)], None


def preannotated(df: DataFrame, key: str, text: str, tagger: Tagger, batch: int = 256) -> DataFrame:
    """(key, tokens, error) of every row: tokens whose words join to the text, or why there are none. A tagger that answers with
    another number of texts fails the job; null texts are an error of their row."""
    kind = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts = [t for t in part["text"] if t is not None]
                answers = tagger(texts) if texts else []
                if len(answers) != len(texts):
                    raise ValueError("the tagger answered with another number of texts")
                left = iter(answers)
                rows = [(None, "no text") if t is None else _checked(t, *next(left)) for t in part["text"]]
                yield pd.DataFrame({"key": part["key"].to_list(), "tokens": [r[0] for r in rows], "error": [r[1] for r in rows]})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, {RESULT}").withColumnRenamed("key", key)


def normalised_entities(df: DataFrame, entities: str) -> DataFrame:
    """``df`` with its entities (start, end, label, text) once each, by start, end and label; empty and inverted spans left out."""
    ok = F.filter(entities, lambda e: (e["start"] >= 0) & (e["end"] > e["start"]))
    return df.withColumn(entities, F.array_sort(F.array_distinct(F.transform(ok, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), e["text"].alias("text"))))))


def silver(df: DataFrame, key: str, text: str, words: Callable[[list[str]], list[list[str]]], tags: Callable[[list[list[str]]], list[list[str]]], names: Callable[[list[str]], list[list[tuple[int, int, str, str]]]], batch: int = 256) -> DataFrame:
    """(key, tokens, entities, error): a word cutter, a tagger and a name finder one after the other over the same batches."""
    kind = df.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts = part["text"].to_list()
                cut = words(texts)
                tagged, named = tags(cut), names(texts)
                if not len(cut) == len(tagged) == len(named) == len(texts):
                    raise ValueError("an annotator answered with another number of texts")
                rows = [_checked(t, w, g) for t, w, g in zip(texts, cut, tagged)]
                spans = [[{"start": a, "end": b, "label": k, "text": x} for a, b, k, x in e] for e in named]
                yield pd.DataFrame({"key": part["key"].to_list(), "tokens": [r[0] for r in rows], "entities": spans, "error": [r[1] for r in rows]})

    out = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, tokens array<struct<text:string,pos:string>>, entities array<struct<start:int,end:int,label:string,text:string>>, error string")
    return normalised_entities(out, "entities").withColumnRenamed("key", key)
