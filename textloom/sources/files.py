"""Sources and sinks: lines, whole files, JSON lines, shards, manifests, dictionaries, lexicons, reports."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import spec

RECORD = (
    "schema_version int, id string, source struct<id:string,dataset:string,revision:string,license:string,license_url:string>, document_id string, segment_index int, split string, text string, "
    "metadata map<string,string>, preannotation struct<engine:string,engine_confidence_available:boolean,error:string>, review struct<status:string,tokens:array<struct<text:string,pos:string>>,annotator:string,notes:string>"
)
ANNOTATION = "schema_version int, source string, source_index bigint, text string, tokens array<struct<text:string,ckip_pos:string,entity_labels:array<string>>>, entities array<struct<start:int,end:int,label:string,text:string>>"
POLARITIES = ("positive", "negative", "neutral", "mixed", "contextual")
MODEL_KINDS = ("start", "trans1", "trans2", "emit1", "emit2", "word", "mixed", "tag", "pstart", "ptrans1", "ptrans2", "pemit")
LEXICON_KEYS = frozenset({"schemaVersion", "id", "domain", "priority", "enabled", "entries"})
ENTRY_KEYS = frozenset({"word", "pos", "affect"})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row a line: (value)."""
    return spark.read.text(path)


def read_whole(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row a file: (path, text), the text with a line feed behind it if it has none. Files stay apart, so that an input of
    many files is no one row; readers that want one document order the rows by path."""
    t = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return t.select("path", F.when(F.col("value").endswith("\n") | (F.col("value") == ""), F.col("value")).otherwise(F.concat("value", F.lit("\n"))).alias("text"))


def numbered_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, line_no, value) of all lines, counted from 0 in each file, without the line break. A file is read as one row for
    that: the readers below want the place of an error or the original index."""
    t = read_whole(spark, paths).select("path", F.posexplode(F.split(F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), r"\r?\n\z", ""), r"\r?\n")).alias("line_no", "value"))
    return t.select("path", F.col("line_no").cast("long").alias("line_no"), "value")


def read_text_file(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, source_index, text): stripped lines with their place in the file; blank lines and a byte order mark dropped."""
    return numbered_lines(spark, path).select(F.lit(source).alias("source"), F.col("line_no").alias("source_index"), F.regexp_replace("value", f"^[{spec.SPACE}]+|[{spec.SPACE}]+\\z", "").alias("text")).where("text <> ''")


def read_multi(parts: dict[str, DataFrame]) -> DataFrame:
    """Sources chained, each row with the name of its source."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def read_records(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """JSON lines with a fixed schema. A line that is no JSON object or of another schema version is an error that names
    file and line; blank lines are skipped."""
    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    parsed = lines.select("path", "line_no", F.from_json("value", f"{RECORD}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    place = F.concat("path", F.lit(":"), (F.col("line_no") + 1).cast("string"), F.lit(": "))
    problem = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "invalid JSON").when(~F.coalesce(F.col("r.schema_version") == version, F.lit(False)), "unsupported schema_version")
    checked = F.when(problem.isNull(), F.col("r.schema_version")).otherwise(F.raise_error(F.concat(place, problem)).cast("int"))
    return parsed.withColumn("v", checked).select(F.col("v").alias("schema_version"), *[F.col(f"r.{c}").alias(c) for c in spark.createDataFrame([], RECORD).columns[1:]])


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(ANNOTATION).json(f"{root}/annotations/*/batch-*.jsonl", mode="FAILFAST")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """[[source]] tables of a TOML manifest as rows."""
    with open(path, "rb") as f:
        manifest = tomllib.load(f)
    rows = manifest.get("source") or manifest.get("sources") or []
    if not rows:
        raise ValueError(f"{path} names no source")
    keys = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(None if r.get(k) is None else str(r.get(k)) for k in keys) for r in rows], ", ".join(f"`{k}` string" for k in keys))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """{word: [tag, frequency, ...]} as (word, value)."""
    t = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", "^﻿", ""), "map<string,array<string>>").alias("m"))
    t = t.select(F.explode(F.coalesce("m", F.raise_error(F.lit("not a dictionary")).cast("map<string,array<string>>"))).alias("word", "value"))
    return t.withColumn("value", F.when(F.size("value") >= 2, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad value of "), F.col("word"))).cast("array<string>")))


def read_dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one object a line, as ``dictionary_json`` writes them."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("word", "value"))


def parse_user_dictionary(lines: DataFrame) -> DataFrame:
    """(word, freq, tag) of lines ``word [freq] [tag]`` (column value); # starts a comment; a second field that is no
    number is the tag."""
    parts = F.split(F.trim(F.regexp_replace("value", "[ \\t]+", " ")), " ")
    t = lines.where("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(parts.alias("p"))
    freq = F.get("p", 1).try_cast("double")
    return t.select(F.get("p", 0).alias("word"), freq.alias("freq"), F.when(freq.isNull(), F.get("p", 1)).otherwise(F.get("p", 2)).alias("tag"))


def parse_lexicon(text: str) -> dict:
    """A lexicon's JSON; unknown fields and a priority outside -10..10 are errors."""
    spec = json.loads(text)
    if unknown := set(spec) - LEXICON_KEYS:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    if not -10 <= int(spec.get("priority", 0)) <= 10:
        raise ValueError("priority must be between -10 and 10")
    for e in spec.get("entries", []):
        if unknown := set(e) - ENTRY_KEYS:
            raise ValueError(f"unknown fields {sorted(unknown)} of {e.get('word')}")
    return spec


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, family, default_polarity, description, examples, enabled) of the labels of a taxonomy's JSON; an unknown
    polarity, an id that is there twice or a missing field is an error."""
    with_labels = "labels array<struct<id:string,nameZhTw:string,family:string,defaultPolarity:string,description:string,examples:array<string>,enabled:boolean>>"
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<{with_labels.replace(' ', ':', 1)}>")["labels"]).alias("r"))
    problem = (
        F.when(F.col("r.id").isNull() | F.col("r.family").isNull(), "field missing")
        .when(~F.coalesce(F.col("r.defaultPolarity").isin(*POLARITIES), F.lit(False)), "unknown polarity")
        .when(F.count(F.lit(1)).over(Window.partitionBy("r.id")) > 1, "label twice")
    )
    ok = F.when(problem.isNull(), F.col("r.id")).otherwise(F.raise_error(F.concat(problem, F.lit(": "), F.coalesce("r.id", F.lit("?")))).cast("string"))
    return t.select(ok.alias("id"), F.col("r.nameZhTw").alias("name"), "r.family", F.col("r.defaultPolarity").alias("default_polarity"), "r.description", "r.examples", F.coalesce("r.enabled", F.lit(True)).alias("enabled"))


def read_affect(spark: SparkSession, path: str) -> DataFrame:
    """(word, emotions, context_dependent, source) of an affect lexicon's JSON: an object with ``entries``, or their array."""
    entry = "struct<word:string,emotions:array<string>,contextDependent:boolean,source:string>"
    v = F.trim("value")
    entries = F.when(v.startswith("["), F.from_json(v, f"array<{entry}>")).otherwise(F.from_json(v, f"struct<entries:array<{entry}>>")["entries"])
    t = spark.read.text(path, wholetext=True).select(F.explode(entries).alias("r"))
    return t.select("r.word", "r.emotions", F.coalesce("r.contextDependent", F.lit(False)).alias("context_dependent"), "r.source")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(lexicon, domain, priority, enabled, word, pos) of a lexicon's JSON, checked by ``parse_lexicon`` file by file."""

    @F.pandas_udf("array<struct<lexicon:string,domain:string,priority:int,enabled:boolean,word:string,pos:string>>")
    def rows(values: pd.Series) -> pd.Series:
        def one(text: str) -> list[dict]:
            x = parse_lexicon(text)
            return [{"lexicon": x.get("id"), "domain": x.get("domain"), "priority": int(x.get("priority", 0)), "enabled": bool(x.get("enabled", True)), "word": e["word"], "pos": e.get("pos")} for e in x.get("entries", [])]

        return values.map(one)

    return spark.read.text(path, wholetext=True).select(F.inline(rows("value")))


def read_asset(spark: SparkSession, path: str) -> DataFrame:
    """The tables of a trained model as counts (kind, key, n); an unknown kind or a count that is not positive is an error."""
    t = spark.read.parquet(path)
    ok = F.col("kind").isin(*MODEL_KINDS) & (F.col("n") > 0)
    return t.select(F.when(ok, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("bad model row "), "kind", F.lit(" "), "key")).cast("string")).alias("kind"), "key", "n")


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' AND NOT startswith(word, '#')").distinct()


def parse_pipes(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, position, token) of lines of tokens between bars; empty tokens are dropped."""
    t = lines.select(key, F.posexplode(F.filter(F.split(F.regexp_replace(line, "^﻿", ""), r"\|"), lambda x: F.regexp_replace(x, "[ \\t]", "") != "")).alias("position", "token"))
    return t.select(key, F.col("position").cast("long").alias("position"), F.regexp_replace("token", r"^[ \t]+|[ \t]+\z", "").alias("token"))


def tagged_lines(tokens: DataFrame, key: str) -> DataFrame:
    """(key, text): a line ``word<tab>tag`` for every token (key, position, word, tag) that is not white space, and an empty one behind the last."""
    t = tokens.where(~F.col("word").rlike(f"^[{spec.SPACE}]*\\z")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", F.concat_ws("\t", "word", "tag").alias("line")))).alias("x"))
    return t.select(key, F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))


def token_json(tokens: DataFrame, key: str, *extra: str) -> DataFrame:
    """(key, line): ``{"tokens": [{"w", "t", "s", "e", ...}]}`` of tokens (key, position, word, tag, start, end) and ``extra`` columns; what is null is left out."""
    fields = F.struct("position", F.struct(F.col("word").alias("w"), F.col("tag").alias("t"), F.col("start").alias("s"), F.col("end").alias("e"), *extra).alias("k"))
    t = tokens.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("x"))
    return t.select(key, F.to_json(F.struct(F.transform("x", lambda r: r["k"]).alias("tokens"))).alias("line"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    """Committed as a whole by Spark's output committer; an earlier result is replaced."""
    df.select(column).write.mode("overwrite").text(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def dictionary_json(df: DataFrame) -> DataFrame:
    """(line) of (word, tag, freq, entity, emotion): optional columns are left out where they say nothing."""
    value = F.filter(F.array("tag", F.col("freq").cast("string"), F.when(F.col("entity") != "None", F.col("entity")), F.when(F.col("emotion") != "None", F.col("emotion"))), lambda x: x.isNotNull())
    return df.select(F.to_json(F.map_from_arrays(F.array("word"), F.array(value))).alias("line"))


def user_dictionary_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(" ", "word", F.col("freq").cast("string"), "tag").alias("line"))
