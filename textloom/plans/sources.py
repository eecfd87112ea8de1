"""Queries of sources, sinks and streams, with SQL twins where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.operators.corpus import quality_rejection
from textloom.plans.common import GOLD, documents, gold_tokens, reviewed, table
from textloom.plans import registry
from textloom.plans.lexicons import _DICT, _LINES, _dictionary, _pipe_lines, ed_decode
from textloom.plans.registry import query
from textloom.sources import files as S
from textloom.streaming import incremental as I


@query("src_multi", "SELECT 'reviewed' AS source, text FROM reviewed UNION ALL SELECT 'documents', text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark")
def src_multi(s, d):
    parts = {"reviewed": reviewed(s, d), "documents": documents(s, d), "benchmark": table(s, d, "benchmark")}
    return S.read_multi({k: v.select("text") for k, v in parts.items()}).select("source", "text")


@query("src_userdict", f"SELECT word, freq::DOUBLE AS freq, nullif(split_part(regexp_replace(tag, '^[ \\t]+', ''), ' ', 1), '') AS tag FROM {_DICT} WHERE tag IS NOT NULL")
def src_userdict(s, d):
    lines = _dictionary(s, d).where("tag IS NOT NULL").select(F.concat_ws(" ", "word", F.col("freq").cast("string"), "tag").alias("value"))
    return S.parse_user_dictionary(lines)


@query("snk_userdict", f"SELECT word || ' ' || freq || ' ' || tag AS line FROM {_DICT} WHERE tag IS NOT NULL")
def snk_userdict(s, d):
    return S.user_dictionary_lines(_dictionary(s, d).where("tag IS NOT NULL"))


@query("src_stopwords", f"SELECT word FROM {GOLD} WHERE word NOT LIKE '#%' GROUP BY word HAVING count(DISTINCT row_id) > 0.05 * (SELECT count(DISTINCT row_id) FROM {GOLD}) AND trim(word) <> ''")
def src_stopwords(s, d):
    """Words of more than a twentieth of the records."""
    g = gold_tokens(s, d).where("word NOT LIKE '#%' AND trim(word) <> ''")
    n = gold_tokens(s, d).agg(F.countDistinct("row_id").alias("n"))
    return g.groupBy("word").agg(F.countDistinct("row_id").alias("k")).crossJoin(F.broadcast(n)).where("k > 0.05 * n").select("word")  # one row


@query("src_pipeseg", f"SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY n) - 1)::BIGINT AS position, regexp_replace(p, '^[ \\t]+|[ \\t]+\\z', '', 'g') AS token FROM (SELECT row_id, unnest(l) AS p, unnest(range(len(l))) AS n FROM (SELECT row_id, string_split(line, '|') AS l FROM {_LINES})) WHERE regexp_replace(p, '[ \\t]', '', 'g') <> ''")
def src_pipeseg(s, d):
    return S.parse_pipes(_pipe_lines(s, d), "row_id", "line")


@query("snk_dictjson", "SELECT word, tag, frequency, nullif(entity, 'None') AS entity, nullif(emotion, 'None') AS emotion FROM (" + registry.ORACLES["ed_decode"] + ") WHERE tag IS NOT NULL")
def snk_dictjson(s, d):
    """The dictionary with its entities and emotions written as JSON, a word a line, and read back."""
    entries = ed_decode(s, d).where("tag IS NOT NULL").select("word", "tag", F.col("frequency").alias("freq"), "entity", "emotion")
    at = _written(s, "dictjson", lambda p: S.write_text(S.dictionary_json(entries), "line", p))
    back = S.read_dictionary_lines(s, at)
    third = F.get("value", 2)
    emotion = F.coalesce(third.isin(*spec.LEGACY_EMOTIONS), F.lit(False))
    return back.select("word", F.get("value", 0).alias("tag"), F.get("value", 1).cast("long").alias("frequency"), F.when(~emotion, third).alias("entity"), F.when(emotion, third).alias("emotion"))


@query("snk_report", "SELECT source, lang, count(*)::BIGINT AS documents, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL")
def snk_report(s, d):
    return table(s, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("snk_shards_resume")
def snk_shards_resume(s, d):
    """A resumable run over the records as JSON files: the second call has nothing left to do."""
    at = I.scratch(s, f"resume-{uuid.uuid4().hex}")
    reviewed(s, d).write.json(f"{at}/in")
    for _ in range(2):
        I.run_available(s, f"{at}/in", "row_id bigint, text string", lambda df: df.select("row_id", quality_rejection(F.col("text")).alias("reason")), f"{at}/out", f"{at}/state")
    return s.read.parquet(f"{at}/out").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("tr_upsert", f"SELECT word, pos, count(*)::BIGINT AS n FROM {GOLD} GROUP BY ALL")
def tr_upsert(s, d):
    """Counts kept up to date by a stream over the token table."""
    at = I.scratch(s, f"upsert-{uuid.uuid4().hex}")
    gold_tokens(s, d).select("word", "pos").write.parquet(f"{at}/in")
    I.running_counts(s, f"{at}/in", "word string, pos string", ["word", "pos"], f"{at}/out", f"{at}/state")
    return I.read_counts(s, f"{at}/out", ["word", "pos"])


# ---------------------------------------------------------------- round trips: written to the shared folder and read back
def _written(s, name, write):
    at = f"{I.scratch(s, name)}-{uuid.uuid4().hex}"
    write(at)
    return at


_ONE_LINE = "regexp_replace(text, '[\\r\\n]+', ' ', 'g')"


def _one_line(c):
    return F.regexp_replace(c, r"[\r\n]+", " ")


@query("src_lines", f"SELECT line, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM documents) GROUP BY line")
def src_lines(s, d):
    """Every line of texts written one behind the other."""
    at = _written(s, "lines", lambda p: documents(s, d).select(F.regexp_replace("text", "\\r\\n?", "\n").alias("value")).write.text(p))
    return S.read_lines(s, at).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("src_whole", f"SELECT count(*)::BIGINT AS lines, sum(strlen(text))::BIGINT AS bytes FROM (SELECT {_ONE_LINE} AS text FROM reviewed)")
def src_whole(s, d):
    """Files as whole documents: their lines and bytes."""
    at = _written(s, "whole", lambda p: reviewed(s, d).select(_one_line(F.col("text")).alias("value")).write.text(p))
    lines = F.size(F.split("text", "\n")) - 1
    return S.read_whole(s, at).agg(F.sum(lines).alias("lines"), F.sum(F.octet_length("text") - lines).alias("bytes"))


@query("src_textfile", f"SELECT 'doc' AS source, regexp_replace({_ONE_LINE}, '^[{spec.SPACE}]+|[{spec.SPACE}]+\\z', '', 'g') AS text, count(*)::BIGINT AS n FROM reviewed WHERE NOT regexp_matches({_ONE_LINE}, '^[{spec.SPACE}]*\\z') GROUP BY ALL")
def src_textfile(s, d):
    at = _written(s, "textfile", lambda p: reviewed(s, d).select(_one_line(F.col("text")).alias("value")).write.text(p))
    return S.read_text_file(s, at, "doc").groupBy("source", "text").agg(F.count(F.lit(1)).alias("n"))


@query("src_jsonl", "SELECT id, document_id, text, len(review.tokens)::BIGINT AS tokens, count(*)::BIGINT AS n FROM reviewed WHERE schema_version = 1 GROUP BY ALL")
def src_jsonl(s, d):
    """Records as JSON lines, back with the fixed schema."""
    r = table(s, d, "reviewed").where("schema_version = 1").drop("row_id", "reviewed_at", "ingested_at")
    at = _written(s, "records", lambda p: S.write_records(r, p))
    return S.read_records(s, at).groupBy("id", "document_id", "text", F.when(F.col("review.tokens").isNotNull(), F.size("review.tokens")).cast("long").alias("tokens")).agg(F.count(F.lit(1)).alias("n"))


@query("src_shards", "SELECT source, count(*)::BIGINT AS n, sum(len(tokens))::BIGINT AS tokens FROM annotation GROUP BY source")
def src_shards(s, d):
    """Annotations as shards in folders by source, back with the fixed schema."""
    a = table(s, d, "annotation").drop("loaded_at")
    at = _written(s, "shards", lambda p: a.withColumn("folder", F.col("source")).write.partitionBy("folder").json(f"{p}/annotations"))
    back = s.read.schema(S.ANNOTATION).json(f"{at}/annotations", mode="FAILFAST")
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("tokens").isNotNull(), F.size("tokens"))).cast("long").alias("tokens"))


@query("src_dictjson", f"SELECT word, [tag, freq::VARCHAR] AS value FROM {_DICT} WHERE tag IS NOT NULL")
def src_dictjson(s, d):
    entries = _dictionary(s, d).where("tag IS NOT NULL").select("word", "tag", "freq", F.lit("None").alias("entity"), F.lit("None").alias("emotion"))
    at = _written(s, "dictjson", lambda p: S.write_text(S.dictionary_json(entries), "line", p))
    return S.read_dictionary_lines(s, at)


@query("src_taxonomy", "SELECT id, name_zh_tw AS name, family, default_polarity, examples, coalesce(enabled, true) AS enabled FROM emotion_taxonomy")
def src_taxonomy(s, d):
    t = table(s, d, "emotion_taxonomy").select("id", F.col("name_zh_tw").alias("nameZhTw"), "family", F.col("default_polarity").alias("defaultPolarity"), "description", "examples", "enabled")
    one = t.agg(F.to_json(F.struct(F.collect_list(F.struct(*t.columns)).alias("labels"))).alias("value"))  # 36 rows
    at = _written(s, "taxonomy", lambda p: one.write.text(p))
    return S.read_taxonomy(s, at).select("id", "name", "family", "default_polarity", "examples", "enabled")


@query("src_affect", "SELECT word, emotions, coalesce(context_dependent, false) AS context_dependent, source, count(*)::BIGINT AS n FROM emotion_lexicon GROUP BY ALL")
def src_affect(s, d):
    t = table(s, d, "emotion_lexicon").select("word", "emotions", F.col("context_dependent").alias("contextDependent"), "source")
    one = t.agg(F.to_json(F.struct(F.collect_list(F.struct(*t.columns)).alias("entries"))).alias("value"))  # some 300 rows
    at = _written(s, "affect", lambda p: one.write.text(p))
    return S.read_affect(s, at).groupBy("word", "emotions", "context_dependent", "source").agg(F.count(F.lit(1)).alias("n"))


@query("src_lexicon", "SELECT source AS lexicon, source <> 'import-v3' AS enabled, word, count(*)::BIGINT AS n FROM emotion_lexicon WHERE source IS NOT NULL GROUP BY ALL")
def src_lexicon(s, d):
    """One lexicon file for each source of the table, back as entries."""
    t = table(s, d, "emotion_lexicon").where("source IS NOT NULL").groupBy("source").agg(F.collect_list(F.struct("word")).alias("entries"))
    t = t.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.col("source").alias("id"), F.lit("affect").alias("domain"), F.lit(0).alias("priority"), (F.col("source") != "import-v3").alias("enabled"), "entries")).alias("value"))
    at = _written(s, "lexicon", lambda p: t.repartition("value").write.option("maxRecordsPerFile", 1).text(p))
    return S.read_lexicon(s, at).groupBy("lexicon", "enabled", "word").agg(F.count(F.lit(1)).alias("n"))


@query("src_asset")
def src_asset(s, d):
    """The tables of a trained model, checked and read."""
    from textloom.plans.segments import trained

    at = _written(s, "asset", lambda p: trained(s, d).write.parquet(p))
    return S.read_asset(s, at).groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("n"))


_TOKENS = f"(SELECT row_id, i AS position, word, coalesce(pos, '') AS tag, (sum(length(word)) OVER w - length(word))::BIGINT AS start, (sum(length(word)) OVER w)::BIGINT AS \"end\" FROM {GOLD} WINDOW w AS (PARTITION BY row_id ORDER BY i))"


def _tokens(s, d):
    end = F.sum(F.length("word")).over(Window.partitionBy("row_id").orderBy("i")).cast("long")
    g = gold_tokens(s, d).select("row_id", F.col("i").alias("position"), "word", F.coalesce("pos", F.lit("")).alias("tag"), end.alias("end"))
    return g.withColumn("start", F.col("end") - F.length("word"))


@query("snk_tsv", f"SELECT row_id, string_agg(word || chr(9) || tag, chr(10) ORDER BY position) || chr(10) AS text FROM {_TOKENS} WHERE NOT regexp_matches(word, '^[{spec.SPACE}]*\\z') GROUP BY row_id")
def snk_tsv(s, d):
    return S.tagged_lines(_tokens(s, d), "row_id")


@query("snk_annjson")
def snk_annjson(s, d):
    """Tokens as JSON with the emotions of the lexicon, where a word has them."""
    a = table(s, d, "emotion_lexicon").where("emotions IS NOT NULL").groupBy("word").agg(F.max_by("emotions", "entry_id").alias("affect"), F.max_by("source", "entry_id").alias("source"))
    return S.token_json(_tokens(s, d).join(a, "word", "left"), "row_id", "affect", "source")


@query("snk_atomic", "SELECT row_id, text FROM reviewed")
def snk_atomic(s, d):
    """A table that is written twice is replaced as a whole."""
    at = I.scratch(s, f"atomic-{uuid.uuid4().hex}")
    for rows in (reviewed(s, d).where("false"), reviewed(s, d)):
        S.write_records(rows, at)
    return s.read.schema("row_id bigint, text string").json(at)
