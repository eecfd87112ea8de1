"""Queries of dictionaries, lexicons and affect, intervals and editors, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions.text import count_occurrences, norm_text
from textloom.operators import lexicon as L
from textloom.operators.similarity import global_running
from textloom.plans.common import GOLD, gold_tokens, q, reviewed, table
from textloom.plans import registry
from textloom.plans.registry import query

_NORM = f"translate({{}}, '{spec.NORM_FROM}', '{spec.NORM_TO}')"
# Dictionary of these queries: reviewed Han words of 2 to 255 characters with their number of occurrences and first tag.
_DICT = f"(SELECT word, count(*)::BIGINT AS freq, min(pos) AS tag FROM {GOLD} WHERE regexp_matches(word, '^[{spec.HAN_TRAIN}]{{2,255}}\\z') GROUP BY word)"


def _dictionary(s, d):
    g = gold_tokens(s, d).where(F.col("word").rlike(f"^[{spec.HAN_TRAIN}]{{2,255}}\\z"))
    return g.groupBy("word").agg(F.count(F.lit(1)).alias("freq"), F.min("pos").alias("tag"))


# Every length that a dictionary word has, at every position.
_HITS = f"SELECT row_id, (i - 1)::BIGINT AS start, substr(t, i::INT, k::INT) AS word FROM (SELECT row_id, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM (SELECT row_id, {_NORM.format('text')} AS t, unnest((SELECT list(DISTINCT length(word)) FROM {_DICT})) AS k FROM reviewed))"


@query("dict_match", f"SELECT row_id, start, word, freq, tag FROM ({_HITS}) JOIN (SELECT {_NORM.format('word')} AS word, sum(freq)::BIGINT AS freq, min(tag) AS tag FROM {_DICT} GROUP BY ALL) USING (word)")
def dict_match(s, d):
    lookup = _dictionary(s, d).groupBy(norm_text(F.col("word")).alias("word")).agg(F.sum("freq").alias("freq"), F.min("tag").alias("tag"))
    return L.dict_matches(reviewed(s, d), "row_id", "text", lookup)


_CURATED = "(VALUES " + ",".join(f"({i},{q(w)},{f}::DOUBLE,{q(t)})" for i, (w, f, t) in enumerate(spec.CURATED)) + ") c(line, word, freq, tag)"
_INSTALL = f"WITH u AS (SELECT word, arg_max(freq, line) AS freq, arg_max(tag, line) AS tag FROM (SELECT line, {_NORM.format('word')} AS word, freq, tag FROM {_CURATED}) GROUP BY word), b AS (SELECT word, freq::DOUBLE AS freq, tag, false AS is_user FROM {_DICT} ANTI JOIN u USING (word) UNION ALL SELECT word, freq, tag, true FROM u)"


@query("userdict_install", _INSTALL + " SELECT word, tag, is_user, round(ln(freq) - ln(sum(freq) OVER ()), 6) AS logp FROM b")
def userdict_install(s, d):
    """The curated overrides are installed as user entries over the dictionary."""
    user = s.createDataFrame([(i, w, float(f), t) for i, (w, f, t) in enumerate(spec.CURATED)], "line int, word string, freq double, tag string")
    return L.install_user(_dictionary(s, d), user)


@query("curated_overrides", _INSTALL + " SELECT word, tag FROM b WHERE is_user")
def curated_overrides(s, d):
    return userdict_install(s, d).where("is_user").select("word", "tag")


@query("dict_lookup", _INSTALL + f", t AS (SELECT ln(sum(freq)) AS total FROM b) SELECT row_id, i AS position, g.word, coalesce(freq, 0)::DOUBLE AS freq, coalesce(b.tag, '') AS tag, coalesce(is_user, false) AS is_user, round(ln(freq) - total, 6) AS logp FROM {GOLD} g, t LEFT JOIN b ON b.word = g.word")
def dict_lookup(s, d):
    """Every token in the dictionary with the user's entries: frequency, tag, whether it is the user's, log probability; unknown words have none."""
    user = s.createDataFrame([(i, w, float(f), t) for i, (w, f, t) in enumerate(spec.CURATED)], "line int, word string, freq double, tag string")
    b = L.install_user(_dictionary(s, d), user, keep=("freq",))
    j = gold_tokens(s, d).select("row_id", F.col("i").alias("position"), "word").join(b, "word", "left")
    return j.select("row_id", "position", "word", F.coalesce("freq", F.lit(0.0)).alias("freq"), F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("is_user", F.lit(False)).alias("is_user"), "logp")


# Two lexicons from the table: one for each source tag, by load order; entries of a null source are in no lexicon.
_LEX = "(SELECT source AS lexicon, CASE source WHEN 'hand-v1' THEN 1 WHEN 'crowd-v2' THEN 2 ELSE 3 END AS load_order, CASE source WHEN 'crowd-v2' THEN 3 ELSE 0 END AS priority, source <> 'import-v3' AS enabled, word FROM emotion_lexicon WHERE source IS NOT NULL)"


def _entries(s, d):
    e = table(s, d, "emotion_lexicon").where("source IS NOT NULL")
    return e.select(F.col("source").alias("lexicon"), F.expr("CASE source WHEN 'hand-v1' THEN 1 WHEN 'crowd-v2' THEN 2 ELSE 3 END").alias("load_order"), F.expr("CASE source WHEN 'crowd-v2' THEN 3 ELSE 0 END").alias("priority"), (F.col("source") != "import-v3").alias("enabled"), "word")


_WIN = f"(SELECT {_NORM.format('word')} AS word, lexicon, priority, row_number() OVER (PARTITION BY {_NORM.format('word')} ORDER BY priority DESC, load_order DESC) AS r, count(*) OVER (PARTITION BY {_NORM.format('word')}) AS candidates FROM {_LEX} WHERE enabled)"


@query("lexicon_install", f"SELECT word, lexicon, candidates::BIGINT AS candidates, (6.0 + priority * 0.5)::DOUBLE AS bias FROM {_WIN} WHERE r = 1")
def lexicon_install(s, d):
    return L.install_lexicons(_entries(s, d))


@query("lexicon_stats", f"SELECT lexicon, count(*)::BIGINT AS words, sum((candidates > 1)::INT)::BIGINT AS conflicts FROM {_WIN} WHERE r = 1 GROUP BY lexicon")
def lexicon_stats(s, d):
    return lexicon_install(s, d).groupBy("lexicon").agg(F.count(F.lit(1)).alias("words"), F.count(F.when(F.col("candidates") > 1, 1)).alias("conflicts"))


@query("lexicon_summary", f"SELECT (SELECT count(DISTINCT lexicon) FROM {_LEX})::BIGINT AS lexicons, (SELECT count(DISTINCT lexicon) FROM {_LEX} WHERE enabled)::BIGINT AS enabled, (SELECT count(*) FROM {_WIN} WHERE r = 1)::BIGINT AS words, (SELECT count(*) FROM {_WIN} WHERE r = 1 AND candidates > 1)::BIGINT AS conflicts, (SELECT count(*) FROM {_WIN} JOIN (SELECT DISTINCT {_NORM.format('word')} AS word FROM {_DICT}) USING (word) WHERE r = 1)::BIGINT AS overrides")
def lexicon_summary(s, d):
    """Over all lexicons: how many, enabled ones, words in effect, conflicts, and words that override the dictionary's."""
    lexicons = _entries(s, d).agg(F.countDistinct("lexicon").alias("lexicons"), F.countDistinct(F.when(F.col("enabled"), F.col("lexicon"))).alias("enabled"))
    base = _dictionary(s, d).select(norm_text(F.col("word")).alias("word")).distinct().withColumn("base", F.lit(1))
    words = lexicon_install(s, d).join(base, "word", "left").agg(F.count(F.lit(1)).alias("words"), F.count(F.when(F.col("candidates") > 1, 1)).alias("conflicts"), F.count("base").alias("overrides"))
    return lexicons.crossJoin(words)  # one row each


@query("affect_polarity", "SELECT word, CASE WHEN pos AND neg THEN 'mixed' WHEN ctx THEN 'contextual' WHEN pos THEN 'positive' WHEN neg THEN 'negative' ELSE 'neutral' END AS polarity FROM (SELECT word, coalesce(bool_or(p = 'positive'), false) AS pos, coalesce(bool_or(p = 'negative'), false) AS neg, coalesce(bool_or(p = 'contextual'), false) OR bool_or(ctx) AS ctx FROM (SELECT e.word, coalesce(e.context_dependent, false) AS ctx, t.default_polarity AS p FROM emotion_lexicon e LEFT JOIN (SELECT entry_id, unnest(emotions) AS id FROM emotion_lexicon) x USING (entry_id) LEFT JOIN emotion_taxonomy t ON t.id = x.id) GROUP BY word)")
def affect_polarity(s, d):
    return L.polarity(table(s, d, "emotion_lexicon"), table(s, d, "emotion_taxonomy"))


@query("affect_override", "SELECT p.word, coalesce(o.given, p.polarity) AS polarity FROM (" + registry.ORACLES["affect_polarity"] + ") p JOIN (SELECT word, max(CASE WHEN entry_id % 5 = 0 THEN 'neutral' WHEN entry_id % 7 = 0 THEN 'mixed' END) AS given FROM emotion_lexicon GROUP BY word) o ON o.word IS NOT DISTINCT FROM p.word")
def affect_override(s, d):
    """Polarities with some set by hand (here by entry id): those go before what the labels say."""
    e = table(s, d, "emotion_lexicon").withColumn("given", F.expr("CASE WHEN entry_id % 5 = 0 THEN 'neutral' WHEN entry_id % 7 = 0 THEN 'mixed' END"))
    return L.polarity(e, table(s, d, "emotion_taxonomy"), "given")


@query("affect_merge", f"SELECT word, arg_max(emotions, rank * 100000 + entry_id) AS emotions FROM (SELECT {_NORM.format('word')} AS word, emotions, entry_id, CASE source WHEN 'crowd-v2' THEN 3 WHEN 'hand-v1' THEN 2 ELSE 1 END AS rank FROM emotion_lexicon WHERE emotions IS NOT NULL) GROUP BY word")
def affect_merge(s, d):
    """Entries overlaid by priority of their source, later ones winning ties."""
    e = table(s, d, "emotion_lexicon").where("emotions IS NOT NULL").select(norm_text(F.col("word")).alias("word"), "emotions", "entry_id", F.expr("CASE source WHEN 'crowd-v2' THEN 3 WHEN 'hand-v1' THEN 2 ELSE 1 END").alias("rank"))
    return e.groupBy("word").agg(F.max_by("emotions", F.struct("rank", "entry_id")).alias("emotions"))


@query("affect_stats", "SELECT t.family, count(DISTINCT word)::BIGINT AS words FROM (SELECT word, unnest(emotions) AS id FROM emotion_lexicon) e JOIN emotion_taxonomy t USING (id) GROUP BY t.family")
def affect_stats(s, d):
    e = table(s, d, "emotion_lexicon").select("word", F.explode("emotions").alias("id"))
    return e.join(table(s, d, "emotion_taxonomy"), "id").groupBy("family").agg(F.countDistinct("word").alias("words"))


@query("affect_validate", "SELECT DISTINCT word, error FROM (SELECT word, CASE WHEN t.id IS NULL THEN 'unknown_label' WHEN NOT enabled THEN 'disabled_label' END AS error FROM (SELECT word, unnest(emotions) AS id FROM emotion_lexicon) e LEFT JOIN emotion_taxonomy t USING (id) UNION ALL SELECT word, 'duplicate_word' FROM emotion_lexicon GROUP BY word HAVING count(*) > 1 UNION ALL SELECT word, 'no_label' FROM emotion_lexicon WHERE emotions IS NULL OR len(emotions) = 0) WHERE error IS NOT NULL")
def affect_validate(s, d):
    return L.affect_errors(table(s, d, "emotion_lexicon"), table(s, d, "emotion_taxonomy"))


@query("taxonomy_validate", "SELECT DISTINCT id, error FROM (SELECT id, 'duplicate_id' AS error FROM emotion_taxonomy GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'no_family' FROM emotion_taxonomy WHERE coalesce(family, '') = '' UNION ALL SELECT id, 'unknown_polarity' FROM emotion_taxonomy WHERE coalesce(default_polarity, '') NOT IN ('positive', 'negative', 'neutral', 'mixed', 'contextual') UNION ALL SELECT id, 'mixed_default' FROM emotion_taxonomy WHERE default_polarity = 'mixed' UNION ALL SELECT id, 'family_differs' FROM emotion_taxonomy WHERE NOT starts_with(id, family || '.'))")
def taxonomy_validate(s, d):
    """Labels that break a rule of the taxonomy: ids once, a family that the id begins with, a known polarity that is not mixed."""
    t = table(s, d, "emotion_taxonomy")
    polarity = F.coalesce("default_polarity", F.lit(""))
    rules = {
        "no_family": F.coalesce("family", F.lit("")) == "", "unknown_polarity": ~polarity.isin("positive", "negative", "neutral", "mixed", "contextual"), "mixed_default": polarity == "mixed",
        "family_differs": ~F.coalesce(F.col("id").startswith(F.concat("family", F.lit("."))), F.lit(True)),
    }
    found = F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    twice = t.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("error"))
    return t.select("id", F.explode(found).alias("error")).unionByName(twice).distinct()


@query("affect_lookup", f"SELECT row_id, i AS position, g.word, a.entries FROM {GOLD} g JOIN (SELECT {_NORM.format('word')} AS norm, count(*)::BIGINT AS entries FROM emotion_lexicon GROUP BY ALL) a ON {_NORM.format('g.word')} = a.norm")
def affect_lookup(s, d):
    a = table(s, d, "emotion_lexicon").groupBy(norm_text(F.col("word")).alias("norm")).agg(F.count(F.lit(1)).alias("entries"))
    g = gold_tokens(s, d).select("row_id", F.col("i").alias("position"), "word", norm_text(F.col("word")).alias("norm"))
    return g.join(a, "norm").drop("norm")


_LEGACY = "(VALUES " + ",".join(f"({q(k)},{q(a)},{q(b)})" for k, (a, b) in spec.LEGACY_EMOTIONS.items()) + ") l(code, kind, value)"


@query("emotion_migrate", f"WITH c AS (SELECT entry_id, word, (['Happy','Sad','Angry','Fake','Blame','Odd'])[entry_id % 6 + 1] AS code FROM emotion_lexicon) SELECT entry_id, word, code, coalesce(kind, 'pending') AS kind, value FROM c LEFT JOIN {_LEGACY} USING (code)")
def emotion_migrate(s, d):
    """Legacy codes (given to the entries by their id) become labels, flags or appraisals; others stay pending."""
    legacy = s.createDataFrame([(k, a, b) for k, (a, b) in spec.LEGACY_EMOTIONS.items()], "code string, kind string, value string")
    code = F.element_at(F.array(*[F.lit(x) for x in ("Happy", "Sad", "Angry", "Fake", "Blame", "Odd")]), (F.col("entry_id") % 6 + 1).cast("int"))
    e = table(s, d, "emotion_lexicon").select("entry_id", "word", code.alias("code"))
    return e.join(legacy, "code", "left").select("entry_id", "word", "code", F.coalesce("kind", F.lit("pending")).alias("kind"), "value")


# ---------------------------------------------------------------- intervals
_ANN = "(SELECT DISTINCT source, source_index, text, tokens, entities FROM annotation WHERE text IS NOT NULL AND tokens IS NOT NULL)"
_TOK = f"(SELECT source, source_index, text, i, word, (sum(length(word)) OVER w - length(word))::BIGINT AS a, (sum(length(word)) OVER w)::BIGINT AS b FROM (SELECT source, source_index, text, i, k.text AS word FROM (SELECT source, source_index, text, unnest(tokens) AS k, generate_subscripts(tokens, 1) - 1 AS i FROM {_ANN})) WINDOW w AS (PARTITION BY source, source_index, text ORDER BY i))"


def _ann(s, d):
    return table(s, d, "annotation").where("text IS NOT NULL AND tokens IS NOT NULL").select("source", "source_index", "text", "tokens", "entities").distinct()


def _ann_tokens(s, d):
    t = _ann(s, d).select("source", "source_index", "text", F.posexplode("tokens").alias("i", "k")).select("source", "source_index", "text", F.col("i").cast("long").alias("i"), F.col("k.text").alias("word"))
    b = F.sum(F.length("word")).over(Window.partitionBy("source", "source_index", "text").orderBy("i")).cast("long")
    return t.withColumn("b", b).withColumn("a", F.col("b") - F.length("word"))


@query("align_find", f"SELECT source, source_index, i, word, a AS char_start, b AS char_end, substr(text, (a + 1)::INT, length(word)) = word AS found FROM {_TOK}")
def align_find(s, d):
    return _ann_tokens(s, d).select("source", "source_index", "i", "word", F.col("a").alias("char_start"), F.col("b").alias("char_end"), (F.expr("substring(text, int(a + 1), length(word))") == F.col("word")).alias("found"))


_ENT = f"(SELECT source, source_index, text, e.start AS s, e.\"end\" AS t, e.label AS label, e.text AS surface FROM (SELECT source, source_index, text, unnest(entities) AS e FROM {_ANN}))"


def _ann_entities(s, d):
    return _ann(s, d).select("source", "source_index", "text", F.explode("entities").alias("e")).select("source", "source_index", "text", F.col("e.start").alias("s"), F.col("e.end").alias("t"), F.col("e.label").alias("label"), F.col("e.text").alias("surface"))


@query("ivl_join_entity", f"SELECT t.source, t.source_index, t.i, t.word, list_sort(list(DISTINCT e.label)) AS labels FROM {_TOK} t JOIN {_ENT} e ON t.source = e.source AND t.source_index = e.source_index AND t.text = e.text AND t.a < e.t AND e.s < t.b GROUP BY ALL")
def ivl_join_entity(s, d):
    """Labels of the entities that a token overlaps: equal record keys first, so the range test is within a record."""
    j = _ann_tokens(s, d).join(_ann_entities(s, d), ["source", "source_index", "text"]).where("a < t AND s < b")
    return j.groupBy("source", "source_index", "i", "word").agg(F.array_sort(F.collect_set("label")).alias("labels"))


@query("entity_validate", f"SELECT e.source, e.source_index, e.s::BIGINT AS char_start, e.label, CASE WHEN s < 0 OR t > length(text) OR t <= s THEN 'invalid-offset' WHEN substr(text, s + 1, t - s) <> surface THEN 'surface-mismatch' WHEN NOT starts OR NOT ends THEN 'partial-token-boundary' ELSE 'valid' END AS reason FROM (SELECT e.*, EXISTS (SELECT 1 FROM {_TOK} k WHERE k.source = e.source AND k.source_index = e.source_index AND k.text = e.text AND k.a = e.s) AS starts, EXISTS (SELECT 1 FROM {_TOK} k WHERE k.source = e.source AND k.source_index = e.source_index AND k.text = e.text AND k.b = e.t) AS ends FROM {_ENT} e) e")
def entity_validate(s, d):
    """Every entity of every record with its fault. Only lengths of tokens, offsets of entities and digests are shuffled, once: texts and
    surfaces are compared where they lie, and the ends of tokens are running sums inside a record. Records of one key and text
    count together, position by position."""
    checked = F.expr("""transform(coalesce(entities, array()), e -> struct(bigint(e.start) AS s, bigint(e.`end`) AS t, e.label AS label, CASE WHEN e.start < 0 OR e.`end` > length(text) OR e.`end` <= e.start THEN 'invalid-offset'
        WHEN substring(text, int(e.start + 1), int(e.`end` - e.start)) <> e.text THEN 'surface-mismatch' END AS fault))""")
    r = table(s, d, "annotation").where("text IS NOT NULL AND tokens IS NOT NULL")
    r = r.select("source", "source_index", F.unhex(F.sha2("text", 256)).alias("text"), F.struct(F.unhex(F.sha2(F.to_json(F.struct("tokens", "entities")), 256)).alias("digest"), F.transform("tokens", lambda k: F.length(k["text"])).alias("sizes"), checked.alias("e")).alias("r"))
    g = r.groupBy("source", "source_index", "text").agg(F.collect_set("r").alias("r"))
    total = F.expr("aggregate(r, cast(array() AS array<bigint>), (a, x) -> zip_with(a, x.sizes, (m, n) -> coalesce(m, 0L) + coalesce(n, 0)))")
    running = F.expr("aggregate(n, named_struct('x', cast(array() AS array<bigint>), 'at', 0L), (a, m) -> named_struct('x', concat(a.x, array(a.at + m)), 'at', a.at + m), a -> a.x)")
    g = g.select("source", "source_index", "r", total.alias("n")).select("source", "source_index", "r", running.alias("ends"))
    starts = F.flatten(F.transform("r", lambda x: F.zip_with(F.col("ends"), x["sizes"], lambda b, n: b - n)))
    e = g.select("source", "source_index", "ends", starts.alias("starts"), F.explode(F.flatten(F.transform("r", lambda x: x["e"]))).alias("e"))
    at_tokens = F.col("source").isNotNull() & F.col("source_index").isNotNull() & F.array_contains("starts", F.col("e.s")) & F.array_contains("ends", F.col("e.t"))
    reason = F.coalesce("e.fault", F.when(at_tokens, "valid").otherwise("partial-token-boundary"))
    return e.select("source", "source_index", F.col("e.s").alias("char_start"), F.col("e.label").alias("label"), reason.alias("reason"))


# ---------------------------------------------------------------- dictionary editor and frequency batches
_ED = f"(SELECT word, [tag, freq::VARCHAR, CASE WHEN freq % 3 = 0 THEN 'PERSON' WHEN freq % 3 = 1 THEN 'Happy' END] AS value FROM {_DICT})"
_CODES = ",".join(q(k) for k in spec.LEGACY_EMOTIONS)


@query("ed_decode", f"SELECT word, value[1] AS tag, value[2]::BIGINT AS frequency, CASE WHEN value[3] IS NULL OR value[3] IN ({_CODES}) THEN 'None' ELSE value[3] END AS entity, CASE WHEN value[3] IN ({_CODES}) THEN value[3] ELSE 'None' END AS emotion FROM {_ED}")
def ed_decode(s, d):
    """Two- to four-column values; a third column is an emotion if it is one of the codes, else an entity."""
    third = F.when(F.col("freq") % 3 == 0, "PERSON").when(F.col("freq") % 3 == 1, "Happy")
    v = _dictionary(s, d).select("word", F.array("tag", F.col("freq").cast("string"), third).alias("v"))
    emotion = F.coalesce(F.col("v")[2].isin(*spec.LEGACY_EMOTIONS), F.lit(False))
    return v.select("word", F.col("v")[0].alias("tag"), F.col("v")[1].cast("long").alias("frequency"), F.when(F.col("v")[2].isNull() | emotion, "None").otherwise(F.col("v")[2]).alias("entity"), F.when(emotion, F.col("v")[2]).otherwise("None").alias("emotion"))


@query("ed_filter_sort", f"SELECT word, tag, freq, row_number() OVER (ORDER BY freq DESC, word)::BIGINT AS place FROM {_DICT} WHERE contains(word, '圖') AND freq BETWEEN 1 AND 1000")
def ed_filter_sort(s, d):
    kept = _dictionary(s, d).where("contains(word, '圖') AND freq BETWEEN 1 AND 1000")
    return global_running(kept, [F.desc("freq"), F.col("word")], "freq").select("word", "tag", "freq", F.col("rank").alias("place"))


@query("ed_replace", f"WITH r AS (SELECT word AS before, replace(word, '館', '舘') AS after FROM {_DICT} WHERE contains(word, '館')) SELECT before, after, CASE WHEN after = '' THEN 'empty' WHEN after IN (SELECT word FROM {_DICT}) OR count(*) OVER (PARTITION BY after) > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM r")
def ed_replace(s, d):
    """Preview of a bulk rename with its conflicts."""
    w = _dictionary(s, d).select("word")
    r = w.where("contains(word, '館')").select(F.col("word").alias("before"), F.expr("replace(word, '館', '舘')").alias("after"))
    r = r.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("after"))).join(w.select(F.col("word").alias("after"), F.lit(True).alias("taken")), "after", "left")
    return r.select("before", "after", F.when(F.col("after") == "", "empty").when(F.col("taken") | (F.col("n") > 1), "duplicate").otherwise("ok").alias("status"))


_LINES = f"(SELECT row_id, string_agg(word, '|' ORDER BY i) || '|' AS line FROM {GOLD} GROUP BY row_id)"


def _pipe_lines(s, d):
    g = gold_tokens(s, d).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    return g.select("row_id", F.concat(F.array_join(F.transform("w", lambda x: x["word"]), "|"), F.lit("|")).alias("line"))


@query("ed_train_replace", f"SELECT row_id, regexp_replace(regexp_replace(replace(line, '的|', ''), '\\|\\|+', '|', 'g'), '\\|+$', '') AS line FROM {_LINES}")
def ed_train_replace(s, d):
    return _pipe_lines(s, d).select("row_id", F.regexp_replace(F.regexp_replace(F.expr("replace(line, '的|', '')"), r"\|\|+", "|"), r"\|+$", "").alias("line"))


@query("ed_delete_first", "SELECT row_id, text FROM (SELECT row_id, text, row_number() OVER (PARTITION BY text ORDER BY row_id) AS r FROM reviewed) WHERE NOT (text = '同上。' AND r = 1)")
def ed_delete_first(s, d):
    """Removes the first row (by id) with exactly the given line, and only it."""
    r = reviewed(s, d)
    first = r.where("text = '同上。'").agg(F.min("row_id").alias("row_id"))
    return r.join(first, "row_id", "left_anti")


@query("ed_infer", f"SELECT row_id, list_extract(list(p ORDER BY length(p) DESC, n), 1) AS word FROM (SELECT row_id, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM (SELECT row_id, string_split(line, '|') AS l FROM {_LINES})) WHERE length(p) >= 2 GROUP BY row_id")
def ed_infer(s, d):
    """The first of the longest parts of at least two characters of every line; lines without one give no row."""
    parts = F.filter(F.transform(F.split("line", r"\|"), lambda x, i: F.struct((-F.length(x)).alias("size"), i.alias("at"), x.alias("part"))), lambda x: x["size"] <= -2)
    return _pipe_lines(s, d).select("row_id", F.array_min(parts)["part"].alias("word")).where("word IS NOT NULL")


_STATE = f"(SELECT {_NORM.format('word')} AS canonical, max(n)::BIGINT AS freq, list_sort(list(DISTINCT word)) AS aliases FROM (SELECT word, count(*) AS n FROM {GOLD} WHERE regexp_matches(word, '^[{spec.HAN_TRAIN}]+\\z') GROUP BY word) GROUP BY ALL)"
_TARGETS = f"(SELECT DISTINCT {_NORM.format('k.text')} AS canonical FROM (SELECT unnest(tokens) AS k FROM prediction) WHERE regexp_matches(k.text, '^[{spec.HAN_TRAIN}]{{2,255}}\\z'))"


def _state(s, d):
    w = gold_tokens(s, d).where(F.col("word").rlike(f"^[{spec.HAN_TRAIN}]+\\z")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy(norm_text(F.col("word")).alias("canonical")).agg(F.max("n").alias("freq"), F.array_sort(F.collect_set("word")).alias("aliases"))


def _targets(s, d):
    p = table(s, d, "prediction").select(F.explode("tokens.text").alias("w")).where(F.col("w").rlike(f"^[{spec.HAN_TRAIN}]{{2,255}}\\z"))
    return p.select(norm_text(F.col("w")).alias("canonical")).distinct()


query("fq_bootstrap", f"SELECT * FROM {_STATE}")(_state)


@query("fq_pending", f"SELECT canonical FROM {_TARGETS} ANTI JOIN {_STATE} USING (canonical)")
def fq_pending(s, d):
    return _targets(s, d).join(_state(s, d), "canonical", "left_anti")


_TAGGED = f"(SELECT {_NORM.format('word')} AS canonical, min(pos) AS tag, count(*) AS freq FROM {GOLD} WHERE regexp_matches(word, '^[{spec.HAN_TRAIN}]{{2,255}}\\z') AND pos IS NOT NULL GROUP BY ALL)"


@query("fq_plan", f"WITH t AS (SELECT * FROM {_TAGGED}), m AS (SELECT tag, median(freq) AS m FROM t WHERE freq > 1 GROUP BY tag) SELECT canonical, tag, coalesce(m, 1.0)::DOUBLE AS provisional FROM t LEFT JOIN m USING (tag) WHERE freq = 1")
def fq_plan(s, d):
    """Words seen once get the median frequency of sampled words of their tag."""
    t = gold_tokens(s, d).where(F.col("word").rlike(f"^[{spec.HAN_TRAIN}]{{2,255}}\\z") & F.col("pos").isNotNull()).groupBy(norm_text(F.col("word")).alias("canonical")).agg(F.min("pos").alias("tag"), F.count(F.lit(1)).alias("freq"))
    m = t.where("freq > 1").groupBy("tag").agg(F.percentile("freq", 0.5).alias("m"))
    return t.where("freq = 1").join(m, "tag", "left").select("canonical", "tag", F.coalesce("m", F.lit(1.0)).alias("provisional"))


@query("fq_count", f"WITH c AS (SELECT {_NORM.format('word')} AS canonical, count(*) AS n FROM {GOLD} GROUP BY ALL) SELECT canonical, coalesce(n, 0)::BIGINT AS n FROM {_TARGETS} LEFT JOIN c USING (canonical)")
def fq_count(s, d):
    c = gold_tokens(s, d).groupBy(norm_text(F.col("word")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))
    return _targets(s, d).join(c, "canonical", "left").fillna(0, ["n"])


_FQ_TARGET = f"(SELECT DISTINCT {_NORM.format('word')} AS word FROM emotion_lexicon WHERE word <> '')"


@query(
    "fq_candidates",
    f"WITH t AS (SELECT * FROM {_FQ_TARGET}), raw AS (SELECT t.word, count(*)::BIGINT AS lines, sum((length(x) - length(replace(x, word, ''))) / length(word))::BIGINT AS raw FROM t JOIN (SELECT {_NORM.format('text')} AS x FROM reviewed) ON contains(x, word) GROUP BY t.word), tok AS (SELECT {_NORM.format('word')} AS word, count(*)::BIGINT AS tokens FROM {GOLD} GROUP BY ALL) SELECT word, coalesce(lines, 0)::BIGINT AS lines, coalesce(raw, 0)::BIGINT AS raw, coalesce(tokens, 0)::BIGINT AS tokens FROM t LEFT JOIN raw USING (word) LEFT JOIN tok USING (word)",
)
def fq_candidates(s, d):
    """For each target word the lines that contain it, its occurrences in them that do not overlap, and its tokens."""
    t = table(s, d, "emotion_lexicon").where("word <> ''").select(norm_text(F.col("word")).alias("word")).distinct()
    lines = L.dict_matches(reviewed(s, d), "row_id", "text", t, least=1).select("row_id", "word").distinct().join(reviewed(s, d).select("row_id", norm_text(F.col("text")).alias("x")), "row_id")
    raw = lines.groupBy("word").agg(F.count(F.lit(1)).alias("lines"), F.sum(count_occurrences(F.col("x"), F.col("word"))).alias("raw"))
    tok = gold_tokens(s, d).groupBy(norm_text(F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("tokens"))
    return t.join(raw, "word", "left").join(tok, "word", "left").fillna(0, ["lines", "raw", "tokens"])


@query("fq_accepted", f"SELECT canonical, count(*)::BIGINT AS n FROM (SELECT {_NORM.format('k.text')} AS canonical FROM (SELECT unnest(tokens) AS k FROM prediction)) JOIN (SELECT DISTINCT {_NORM.format('word')} AS canonical FROM emotion_lexicon) USING (canonical) GROUP BY canonical")
def fq_accepted(s, d):
    t = table(s, d, "emotion_lexicon").select(norm_text(F.col("word")).alias("canonical")).distinct()
    p = table(s, d, "prediction").select(F.explode("tokens.text").alias("w")).select(norm_text(F.col("w")).alias("canonical"))
    return p.join(t, "canonical", "left_semi").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


@query("fq_apply", f"WITH c AS (SELECT {_NORM.format('word')} AS canonical, count(*) AS n FROM {GOLD} GROUP BY ALL) SELECT word, d.freq AS before, coalesce(c.n, d.freq)::BIGINT AS after FROM {_DICT} d LEFT JOIN c ON {_NORM.format('d.word')} = c.canonical")
def fq_apply(s, d):
    """Counts are written back once per canonical form to all of its aliases."""
    c = gold_tokens(s, d).groupBy(norm_text(F.col("word")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))
    w = _dictionary(s, d).select("word", F.col("freq").alias("before"), norm_text(F.col("word")).alias("canonical"))
    return w.join(c, "canonical", "left").select("word", "before", F.coalesce("n", "before").alias("after"))


@query("fq_job", f"WITH p AS (SELECT count(*)::BIGINT AS pending FROM (SELECT canonical FROM {_TARGETS} ANTI JOIN {_STATE} USING (canonical))) SELECT pending, 100::BIGINT AS threshold, pending >= 100 AS runs, (SELECT count(*) FROM {_TARGETS})::BIGINT AS targets, (SELECT count(*) FROM {_STATE})::BIGINT AS known FROM p")
def fq_job(s, d):
    """What a frequency job would do (dry run): it starts from a hundred pending targets."""
    return L.frequency_job(_state(s, d), _targets(s, d), 100)


