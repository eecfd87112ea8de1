"""Queries of scalar projections, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions import text as T
from textloom.plans.common import GOLD, SILVER, documents, gold_tokens, q, reviewed, silver_tokens, table
from textloom.plans import registry
from textloom.plans.registry import query

NORM_SQL = f"translate(text, {q(spec.NORM_FROM)}, {q(spec.NORM_TO)})"


@query("norm_text", f"SELECT doc_id, {NORM_SQL} AS text FROM documents")
def norm_text(s, d):
    return documents(s, d).select("doc_id", T.norm_text(F.col("text")).alias("text"))


@query("norm_js", "SELECT row_id, translate(lower(text), '臺', '台') AS text FROM reviewed")
def norm_js(s, d):
    return reviewed(s, d).select("row_id", T.norm_js(F.col("text")).alias("text"))


@query("norm_nfc", "SELECT row_id, nfc_normalize(text) AS text FROM reviewed")
def norm_nfc(s, d):
    return reviewed(s, d).select("row_id", T.norm_nfc(F.col("text")).alias("text"))


@query("dedupe_key")
def dedupe_key(s, d):
    return reviewed(s, d).select("row_id", T.dedupe_key(F.col("text")).alias("key"))


@query("variant_check", "SELECT * FROM (SELECT substr(f, i, 1) AS \"from\", substr(t, i, 1) AS \"to\", strlen(substr(f, i, 1)) = strlen(substr(t, i, 1)) AS valid FROM (SELECT " + q(spec.NORM_FROM + "é") + " AS f, " + q(spec.NORM_TO + "e") + " AS t, unnest(range(1, 29)) AS i))")
def variant_check(s, d):
    rows = s.createDataFrame(list(zip(spec.NORM_FROM + "é", spec.NORM_TO + "e")), "from string, to string")
    return rows.select("from", "to", (F.octet_length("from") == F.octet_length("to")).alias("valid"))


for _name, _body in (("is_han_core", spec.HAN_CORE), ("is_han_train", spec.HAN_TRAIN), ("is_han_pipe", spec.HAN_PIPE)):

    def _han(s, d, body=_body):
        return documents(s, d).select("doc_id", T.count_class(F.col("text"), body).alias("n"))

    query(_name, f"SELECT doc_id, length(regexp_replace(text, '[^{_body}]', '', 'g')) AS n FROM documents")(_han)

_SURFACES = {
    "han_word": f"^[{spec.HAN_TRAIN}]+\\z",
    "dict_surface": rf"^[{spec.HAN_TRAIN}\p{{L}}\p{{N}}.%％_-]*[{spec.HAN_TRAIN}][{spec.HAN_TRAIN}\p{{L}}\p{{N}}.%％_-]*$",
    "qty_surface": spec.QTY_SURFACE,
}


@query("is_han_word", "SELECT DISTINCT word, " + ", ".join(f"regexp_matches(word, {q(p)}) AS {n}" for n, p in _SURFACES.items()) + f" FROM {SILVER}")
def is_han_word(s, d):
    return silver_tokens(s, d).select("word").distinct().select("word", *[F.col("word").rlike(p).alias(n) for n, p in _SURFACES.items()])


_CLASS_SQL = f"CASE WHEN regexp_matches(ch, '^[{spec.HAN_CORE}]') THEN 'Han' WHEN regexp_matches(ch, '^[{spec.ALNUM}]') THEN 'Alnum' WHEN regexp_matches(ch, '^[{spec.SPACE}]') THEN 'Space' WHEN regexp_matches(ch, '^[{spec.PUNCT}]') THEN 'Punct' ELSE 'Other' END"


@query("char_class", f"SELECT ch, {_CLASS_SQL} AS class, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM reviewed) GROUP BY ALL")
def char_class(s, d):
    counts = reviewed(s, d).select(F.explode(T.chars(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("ch", T.char_class(F.col("ch")).alias("class"), "n")


@query("stable_int", "SELECT row_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: ('0x' || substr(h, i::INT * 8 + 1, 8))::BIGINT)), lambda a, b: (a * 4294967296 + b) % 1000) AS bucket FROM (SELECT row_id, sha256(concat_ws(chr(31), '7', source.id, document_id)) AS h FROM reviewed)")
def stable_int(s, d):
    r = table(s, d, "reviewed")
    return r.select("row_id", T.stable_mod([F.lit("7"), F.col("source.id"), F.col("document_id")], 1000).alias("bucket"))


@query("record_id", "SELECT row_id, substr(sha256(concat_ws(chr(31), source.id, document_id, segment_index, text)), 1, 24) AS id FROM reviewed")
def record_id(s, d):
    r = table(s, d, "reviewed")
    return r.select("row_id", T.record_id([F.col("source.id"), F.col("document_id"), F.col("segment_index").cast("string"), F.col("text")]).alias("id"))


@query("hash_bucket")
def hash_bucket(s, d):
    return reviewed(s, d).select(F.explode(T.chars(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n")).select("ch", T.hash_bucket(F.col("ch"), 1024).alias("bucket"), "n")


@query("bmes_shape", f"SELECT word, CASE WHEN length(word) = 1 THEN 'S' ELSE 'B' || repeat('M', length(word) - 2) || 'E' END AS shape, count(*)::BIGINT AS n FROM {GOLD} GROUP BY ALL")
def bmes_shape(s, d):
    return gold_tokens(s, d).groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", T.bmes_shape(F.col("word")).alias("shape"), "n")


_LABELLED = f"(SELECT row_id, string_agg(word, '' ORDER BY i) AS sentence, string_agg(CASE WHEN length(word) = 1 THEN 'S' ELSE 'B' || repeat('M', length(word) - 2) || 'E' END, '' ORDER BY i) AS labels FROM {GOLD} GROUP BY row_id)"


@query(
    "bmes_decode",
    f"SELECT row_id, n::BIGINT AS position, substr(sentence, (coalesce(list_sum(list_transform(p[1:n - 1], lambda x: length(x))), 0) + 1)::INT, length(p[n])::INT) AS word FROM (SELECT row_id, sentence, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT row_id, sentence, regexp_extract_all(labels, 'BM*E|S') AS p FROM {_LABELLED}))",
)
def bmes_decode(s, d):
    """BMES strings back to words: the label runs' lengths cut the sentence."""
    g = gold_tokens(s, d).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    g = g.select("row_id", F.array_join(F.transform("w", lambda x: x["word"]), "").alias("sentence"), F.array_join(F.transform("w", lambda x: T.bmes_shape(x["word"])), "").alias("labels"))
    g = g.select("row_id", "sentence", F.posexplode(F.transform(F.regexp_extract_all("labels", F.lit("BM*E|S"), F.lit(0)), lambda x: F.length(x))).alias("n", "size"))
    end = F.sum("size").over(Window.partitionBy("row_id").orderBy("n"))
    g = g.withColumn("end", end)
    return g.select("row_id", (F.col("n") + 1).cast("long").alias("position"), F.expr("substring(sentence, int(end - size + 1), size)").alias("word"))


_SPOILT = f"(SELECT row_id, sentence, CASE row_id % 4 WHEN 0 THEN labels WHEN 1 THEN substr(labels, 2) WHEN 2 THEN replace(labels, 'BE', 'BM') ELSE labels || 'S' END AS labels FROM {_LABELLED})"


@query("bmes_valid", f"SELECT row_id, regexp_matches(labels, '^(S|BM*E)*\\z') AND length(sentence) = length(labels) AS valid FROM {_SPOILT}")
def bmes_valid(s, d):
    """Label strings that can be decoded; three of four are spoilt here: cut, with words that do not end, too long."""
    g = gold_tokens(s, d).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    g = g.select("row_id", F.array_join(F.transform("w", lambda x: x["word"]), "").alias("sentence"), F.array_join(F.transform("w", lambda x: T.bmes_shape(x["word"])), "").alias("labels"))
    spoilt = F.expr("CASE row_id % 4 WHEN 0 THEN labels WHEN 1 THEN substr(labels, 2) WHEN 2 THEN replace(labels, 'BE', 'BM') ELSE concat(labels, 'S') END")
    return g.select("row_id", T.bmes_valid(F.col("sentence"), spoilt).alias("valid"))


@query("token_spans", f"SELECT row_id, i AS position, word, (sum(length(word)) OVER w - length(word))::BIGINT AS char_start, (sum(length(word)) OVER w)::BIGINT AS char_end FROM {GOLD} WINDOW w AS (PARTITION BY row_id ORDER BY i)")
def token_spans(s, d):
    end = F.sum(F.length("word")).over(Window.partitionBy("row_id").orderBy("i")).cast("long")
    return gold_tokens(s, d).select("row_id", F.col("i").alias("position"), "word", end.alias("char_end")).select("row_id", "position", "word", (F.col("char_end") - F.length("word")).alias("char_start"), "char_end")


@query("offsets", f"SELECT row_id, i AS position, (sum(strlen(word)) OVER w - strlen(word))::BIGINT AS byte_start, (sum(strlen(word)) OVER w)::BIGINT AS byte_end, (sum(length(word)) OVER w)::BIGINT AS char_end FROM {GOLD} WINDOW w AS (PARTITION BY row_id ORDER BY i)")
def offsets(s, d):
    w = Window.partitionBy("row_id").orderBy("i")
    g = gold_tokens(s, d).withColumn("byte_end", F.sum(F.octet_length("word")).over(w).cast("long")).withColumn("char_end", F.sum(F.length("word")).over(w).cast("long"))
    return g.select("row_id", F.col("i").alias("position"), (F.col("byte_end") - F.octet_length("word")).alias("byte_start"), "byte_end", "char_end")


_BODY, _HAN = "0-9" + spec.HAN_NUMERALS + "多餘余約.,/", spec.HAN_NUMERALS + "多餘余約.,/"


def _qty_sql(column: str, label: str) -> str:
    sub = lambda x, p, r: f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"
    out = sub(column, "民國[0-9]{1,3}年", "\ufff0A\ufff1年")
    out = sub(out, "民國[〇零一二兩三四五六七八九十百千壹貳參肆伍陸柒捌玖拾佰仟]+年", "\ufff0B\ufff1年")
    dated = sub(sub(out, "(^|[^0-9])[12][0-9]{3}年", "\\1\ufff0C\ufff1年"), "[〇零一二兩三四五六七八九壹貳參肆伍陸柒捌玖]{4}年", "\ufff0D\ufff1年")
    out = f"CASE WHEN {label} = 'DATE' THEN {dated} ELSE {out} END"
    out = sub(out, "百分之", "\ufff0E\ufff1")
    out = sub(sub(out, f"[{_HAN}]*[0-9][{_BODY}]*", "\ufff2"), f"[{_HAN}]+", "一")
    for mark, value in (("\ufff2", "1"), ("\ufff0A\ufff1", "民國100"), ("\ufff0B\ufff1", "民國一百"), ("\ufff0C\ufff1", "2000"), ("\ufff0D\ufff1", "二〇〇〇"), ("\ufff0E\ufff1", "百分之")):
        out = sub(out, mark, value)
    return out


_QTY = ",".join(q(x) for x in spec.QUANTITY_ENTITIES)


@query("canon_qty", f"SELECT text, label, {_qty_sql('text', 'label')} AS canonical FROM (SELECT DISTINCT e.text AS text, e.label AS label FROM (SELECT unnest(entities) AS e FROM annotation) WHERE e.label IN ({_QTY}))")
def canon_qty(s, d):
    e = table(s, d, "annotation").select(F.explode("entities").alias("e")).select("e.text", "e.label").where(F.col("label").isin(*spec.QUANTITY_ENTITIES)).distinct()
    return e.select("text", "label", T.canon_qty(F.col("text"), F.col("label")).alias("canonical"))


def _values(table_: dict, columns: str) -> str:
    return "(VALUES " + ",".join(f"({q(k)},{q(v)})" for k, v in table_.items()) + f") t({columns})"


@query(
    "map_tag",
    f"""WITH t AS (SELECT tag, count(*)::BIGINT AS n FROM {SILVER} GROUP BY tag),
e AS (SELECT * FROM {_values(spec.TAG_EXACT, 'k,v')}), b AS (SELECT * FROM {_values(spec.TAG_BROAD, 'k,v')}), a AS (SELECT * FROM {_values({k: '|'.join(v) for k, v in spec.TAG_AMBIGUOUS.items()}, 'k,v')})
SELECT t.tag, coalesce(e.v, b.v) AS target, CASE WHEN e.v IS NOT NULL THEN 'exact' WHEN b.v IS NOT NULL THEN 'broad' WHEN a.v IS NOT NULL THEN 'ambiguous' WHEN regexp_matches(t.tag, '^({'|'.join(spec.TAG_SKIP)})') THEN 'skipped' ELSE 'unmapped' END AS status, CASE WHEN e.v IS NULL AND b.v IS NULL THEN a.v END AS candidates, t.n
FROM t LEFT JOIN e ON t.tag = e.k LEFT JOIN b ON t.tag = b.k LEFT JOIN a ON t.tag = a.k""",
)
def map_tag(s, d):
    counts = silver_tokens(s, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("tag", T.map_tag(F.col("tag")).alias("m"), "n").select("tag", "m.target", "m.status", "m.candidates", "n")


@query("map_tag_eval", f"WITH c AS (SELECT p.pos AS raw, g.pos AS pos, count(*) AS n FROM (SELECT id, i, k.text AS word, k.pos AS pos FROM (SELECT id, unnest(tokens) AS k, generate_subscripts(tokens, 1) - 1 AS i FROM prediction WHERE tool = 'cutter-a')) p JOIN (SELECT id, i, k.text AS word, k.pos AS pos FROM (SELECT id, unnest(review.tokens) AS k, generate_subscripts(review.tokens, 1) - 1 AS i FROM reviewed)) g ON p.id = g.id AND p.i = g.i AND p.word = g.word WHERE p.pos IS NOT NULL AND g.pos IS NOT NULL GROUP BY ALL) SELECT raw, pos AS target, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY n DESC, pos) AS r FROM c) WHERE r = 1")
def map_tag_eval(s, d):
    """The reviewed tag that most often meets each predicted tag."""

    def tokens(name, column, where):
        t = table(s, d, name).where(where).select("id", F.posexplode(column).alias("i", "k"))
        return t.select("id", "i", F.col("k.text").alias("word"), F.col("k.pos").alias("pos")).where("pos IS NOT NULL")

    p, g = tokens("prediction", "tokens", "tool = 'cutter-a'").withColumnRenamed("pos", "raw"), tokens("reviewed", "review.tokens", "true")
    c = p.join(g, ["id", "i", "word"]).groupBy("raw", "pos").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("raw").agg(F.min_by(F.struct("pos", "n"), F.struct((-F.col("n")).alias("m"), "pos")).alias("b")).select("raw", F.col("b.pos").alias("target"), "b.n")


_PUNCT_ONLY = r"^[\p{P}\p{S}]+\z"


@query("map_tag_apply", f"SELECT tool, target, count(*)::BIGINT AS n FROM (SELECT tool, CASE WHEN regexp_matches(word, '{_PUNCT_ONLY}') THEN 'w' ELSE coalesce(m.target, raw) END AS target FROM (SELECT tool, k.text AS word, k.pos AS raw FROM (SELECT tool, unnest(tokens) AS k FROM prediction)) LEFT JOIN ({registry.ORACLES['map_tag_eval']}) m USING (raw)) GROUP BY ALL")
def map_tag_apply(s, d):
    """Predicted tags in the tags of the reviewed records: punctuation by its characters, others by the majority, the rest as they are."""
    p = table(s, d, "prediction").select("tool", F.explode("tokens").alias("k")).select("tool", F.col("k.text").alias("word"), F.col("k.pos").alias("raw"))
    m = p.join(map_tag_eval(s, d).select("raw", "target"), "raw", "left")
    target = F.when(F.col("word").rlike(_PUNCT_ONLY), "w").otherwise(F.coalesce("target", "raw"))
    return m.groupBy("tool", target.alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("tr_qty", f"SELECT label, {_qty_sql('text', 'label')} AS canonical, count(*)::BIGINT AS n FROM (SELECT e.text AS text, e.label AS label FROM (SELECT unnest(entities) AS e FROM annotation) WHERE e.label IN ({_QTY}) AND regexp_matches(e.text, {q(spec.QTY_SURFACE)})) GROUP BY ALL")
def tr_qty(s, d):
    """Patterns of quantities: canonical forms by label with their occurrences."""
    e = table(s, d, "annotation").select(F.explode("entities").alias("e")).select("e.text", "e.label").where(F.col("label").isin(*spec.QUANTITY_ENTITIES) & F.col("text").rlike(spec.QTY_SURFACE))
    return e.groupBy("label", T.canon_qty(F.col("text"), F.col("label")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_key_ascii", "SELECT doc_id, CASE WHEN regexp_matches(text, '^[\\x00-\\x7F]*\\z') THEN lower(regexp_replace(text, '[\\x09-\\x0d\\x1c-\\x20]+', '', 'g')) END AS k FROM documents")
def dedupe_key_ascii(s, d):
    """The key of duplicates of every document of ASCII characters; others, whose key SQL cannot make, have none here."""
    return documents(s, d).select("doc_id", F.when(F.col("text").rlike(r"^[\x00-\x7F]*\z"), T.dedupe_key(F.col("text"))).alias("k"))


@query("contains_fold", "SELECT entry_id, contains(lower(word), 'o') AS latin, contains(word, '心') AS han FROM emotion_lexicon")
def contains_fold(s, d):
    return table(s, d, "emotion_lexicon").select("entry_id", T.contains_fold(F.col("word"), "O").alias("latin"), T.contains_fold(F.col("word"), "心").alias("han"))


@query("count_occ", "SELECT doc_id, ((length(text) - length(replace(text, '圖書館', ''))) / 3)::BIGINT AS n FROM documents")
def count_occ(s, d):
    return documents(s, d).select("doc_id", T.count_occurrences(F.col("text"), F.lit("圖書館")).alias("n"))


@query("clip_unit", "SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0.5 ELSE least(greatest(value / 100, 0.0), 1.0) END AS x FROM events")
def clip_unit(s, d):
    return table(s, d, "events").select("event_id", T.clip_unit(F.col("value") / 100, 0.5).alias("x"))


@query("divide0", "SELECT doc_id, CASE WHEN b = 0 THEN 0.0 ELSE round(a / b, 6) END AS ratio FROM (SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE AS a, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE AS b FROM documents)")
def divide0(s, d):
    return documents(s, d).select("doc_id", F.round(T.divide0(T.count_class(F.col("text"), "0-9"), T.count_class(F.col("text"), "A-Za-z")), 6).alias("ratio"))


@query("reduction", "SELECT doc_id, CASE WHEN a > 0 THEN round(greatest(0.0, (1 - b / a) * 100), 6) ELSE 0.0 END AS saved FROM (SELECT doc_id, length(text)::DOUBLE AS a, length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g'))::DOUBLE AS b FROM documents)")
def reduction(s, d):
    a = F.length("text").cast("double")
    return documents(s, d).select("doc_id", F.round(T.reduction(a, T.count_class(F.col("text"), "0-9A-Za-z").cast("double")), 6).alias("saved"))
