"""Queries of corpus preparation, validation, evaluation and splitting, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions import text as T
from textloom.operators import corpus as C
from textloom.plans.common import GOLD, documents, gold_tokens, q, reviewed, table
from textloom.plans.registry import query

_VISIBLE = f"regexp_replace(text, '[{spec.SPACE}]', '', 'g')"
QUALITY_SQL = f"""CASE WHEN length(text) < 4 THEN 'too_short' WHEN contains(text, chr(65533)) THEN 'replacement_character' WHEN regexp_matches(text, {q(spec.PII_PLAIN)}) THEN 'suspected_pii'
WHEN contains(text, '```') OR contains(lower(text), '<script') OR contains(lower(text), 'function(') THEN 'code_like' WHEN length({_VISIBLE}) = 0 THEN 'empty'
WHEN length(regexp_replace(text, '[^{spec.HAN_PIPE}]', '', 'g')) / length({_VISIBLE}) < 0.35 THEN 'low_han_ratio' END"""


@query("cp_quality", f"SELECT doc_id, {QUALITY_SQL} AS reason FROM documents")
def cp_quality(s, d):
    return documents(s, d).select("doc_id", C.quality_rejection(F.col("text")).alias("reason"))


@query("cp_dedup")
def cp_dedup(s, d):
    """Keep-first by row_id over the NFKC key without white space and case."""
    return C.dedup(reviewed(s, d), T.dedupe_key(F.col("text")), "row_id")


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: ('0x' || substr(h, i::INT * 8 + 1, 8))::BIGINT)), lambda a, b: (a * 4294967296 + b) % {n})"


@query("cp_split", "SELECT row_id, CASE WHEN b < 980 THEN 'train' WHEN b < 990 THEN 'dev' ELSE 'test' END AS split FROM (SELECT row_id, " + _HASH.format(n=1000) + " AS b FROM (SELECT row_id, sha256(concat_ws(chr(31), '20260728', source.id, document_id)) AS h FROM reviewed))")
def cp_split(s, d):
    return table(s, d, "reviewed").select("row_id", C.assign_split(20260728, F.col("source.id"), F.col("document_id")).alias("split"))


@query("cp_trident_split", "SELECT doc_id, CASE WHEN b < 9800 THEN 'train' WHEN b < 9900 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, (('0x' || substr(h, 1, 8))::BIGINT % 10000 * 4294967296 + ('0x' || substr(h, 9, 8))::BIGINT) % 10000 AS b FROM (SELECT doc_id, sha256(text) AS h FROM documents))")
def cp_trident_split(s, d):
    return documents(s, d).select("doc_id", C.text_split(F.col("text")).alias("split"))


@query("cp_sample", "SELECT row_id, source_id, r AS rank FROM (SELECT row_id, source.id AS source_id, row_number() OVER (PARTITION BY source.id ORDER BY sha256(concat_ws(chr(31), '7', source.id, id)), row_id)::BIGINT AS r FROM reviewed) WHERE r <= 50")
def cp_sample(s, d):
    r = table(s, d, "reviewed").select("row_id", "id", F.col("source.id").alias("source_id"))
    return C.stable_sample(r, "source_id", [F.lit("7"), F.col("source_id"), F.col("id")], "row_id", 50).select("row_id", "source_id", "rank")


@query("cp_select")
def cp_select(s, d):
    """Quality, keep-first, stable sample of 200 a source, split; counted per source and split."""
    r = table(s, d, "reviewed").select("row_id", F.col("source.id").alias("source_id"), "document_id", "id", "text")
    return C.select_records(r, seed=20260728, limit=200).groupBy("source_id", "split").agg(F.count(F.lit(1)).alias("records"))


@query("cp_adapt_exam", "SELECT doc_id, field, text FROM (SELECT doc_id, 'source' AS field, source AS text FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents UNION ALL SELECT doc_id, 'document_id', document_id FROM documents) WHERE trim(text) <> ''")
def cp_adapt_exam(s, d):
    t = table(s, d, "documents").select("doc_id", "source", "lang", "document_id")
    return C.unpivot_fields(t, "doc_id", ["source", "lang", "document_id"])


@query("cp_adapt_chat", "SELECT row_id, metadata['subset'] AS subset, metadata['role'] AS role, text FROM reviewed WHERE source.id = 'prompt_box_tw' AND metadata['role'] IN ('human', 'user')")
def cp_adapt_chat(s, d):
    r = table(s, d, "reviewed").where("source.id = 'prompt_box_tw'").select("row_id", F.col("metadata")["subset"].alias("subset"), F.col("metadata")["role"].alias("role"), "text")
    return r.where(F.col("role").isin("human", "user"))


@query("cp_adapt_law", "SELECT row_id, text, metadata['name'] AS name FROM reviewed WHERE source.id = 'statute_text' AND coalesce(trim(metadata['abandon_note']), '') = ''")
def cp_adapt_law(s, d):
    r = table(s, d, "reviewed").where("source.id = 'statute_text'")
    return r.where(F.coalesce(F.trim(F.col("metadata")["abandon_note"]), F.lit("")) == "").select("row_id", "text", F.col("metadata")["name"].alias("name"))


@query("cp_adapt_news", f"SELECT row_id, text FROM reviewed WHERE source.id = 'news_island' AND regexp_matches(coalesce(metadata['title'], '') || chr(10) || text, '{spec.TAIWAN}') AND NOT contains(text, '-{{') AND NOT contains(text, '}}-')")
def cp_adapt_news(s, d):
    r = table(s, d, "reviewed").where("source.id = 'news_island'")
    body = F.concat(F.coalesce(F.col("metadata")["title"], F.lit("")), F.lit("\n"), F.col("text"))
    return r.where(body.rlike(spec.TAIWAN) & ~F.contains("text", F.lit("-{")) & ~F.contains("text", F.lit("}-"))).select("row_id", "text")


@query(
    "cp_validate",
    f"""WITH r AS (SELECT row_id, id, schema_version, split, text, review, row_number() OVER (PARTITION BY id ORDER BY row_id) AS nth FROM reviewed),
t AS (SELECT row_id, string_agg(k.text, '' ORDER BY i) AS rebuilt, bool_or(coalesce(k.text, '') = '') AS bad, bool_or(regexp_matches(k.text, '^[{spec.HAN_PIPE}]+\\z') AND coalesce(trim(k.pos), '') = '') AS nopos FROM (SELECT row_id, unnest(review.tokens) AS k, generate_subscripts(review.tokens, 1) AS i FROM r) GROUP BY row_id),
e AS (SELECT row_id, 'schema_version' AS error FROM r WHERE schema_version IS DISTINCT FROM 1 UNION ALL SELECT row_id, 'duplicate_id' FROM r WHERE nth > 1 UNION ALL SELECT row_id, 'split' FROM r WHERE split IS NULL OR split NOT IN ('train', 'dev', 'test')
UNION ALL SELECT row_id, 'text' FROM r WHERE coalesce(text, '') = '' UNION ALL SELECT row_id, 'status' FROM r WHERE review.status IS NULL OR review.status NOT IN ('pending', 'accepted', 'rejected')
UNION ALL SELECT row_id, 'tokens' FROM r WHERE review.status = 'accepted' AND (review.tokens IS NULL OR len(review.tokens) = 0)
UNION ALL SELECT r.row_id, 'token_text' FROM r JOIN t USING (row_id) WHERE review.status = 'accepted' AND bad UNION ALL SELECT r.row_id, 'han_pos' FROM r JOIN t USING (row_id) WHERE review.status = 'accepted' AND nopos
UNION ALL SELECT r.row_id, 'reconstruct' FROM r JOIN t USING (row_id) WHERE review.status = 'accepted' AND len(review.tokens) > 0 AND coalesce(rebuilt, '') <> text)
SELECT row_id, error FROM e""",
)
def cp_validate(s, d):
    return C.validate_records(table(s, d, "reviewed"))


@query("seg_text_max", "SELECT doc_id, sent_no::BIGINT AS sent_no, unnest(range(1, ceil(length(t) / 80)::INT + 1)) - 1 AS part, substr(t, (80 * part + 1)::INT, 80) AS text FROM (SELECT doc_id, sent_no, regexp_replace(regexp_replace(x, '^[ \\t\\r\\f\\n]+', ''), '[ \\t\\r\\f\\n]+\\z', '') AS t FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS sent_no FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？!?；;\\n]*[。！？!?；;\\n]+|[^。！？!?；;\\n]+') AS l FROM documents))) WHERE t <> ''")
def seg_text_max(s, d):
    return C.split_max(documents(s, d), "doc_id", "text", 80)


# ---------------------------------------------------------------- evaluation
_SPANS = """(SELECT id, {who} AS who, i, word, pos, (sum(length(word)) OVER (PARTITION BY id ORDER BY i) - length(word))::BIGINT AS a, (sum(length(word)) OVER (PARTITION BY id ORDER BY i))::BIGINT AS b FROM ({src}))"""
_GOLD_ONE = "SELECT id, i, k.text AS word, k.pos AS pos FROM (SELECT id, unnest(tokens) AS k, generate_subscripts(tokens, 1) AS i FROM (SELECT id, arg_min(review.tokens, row_id) AS tokens FROM reviewed WHERE review.tokens IS NOT NULL AND split IN ('dev', 'test') GROUP BY id)) WHERE k.text <> ''"
_PRED_ALL = "SELECT tool, id, i, k.text AS word, k.pos AS pos FROM (SELECT tool, id, unnest(tokens) AS k, generate_subscripts(tokens, 1) AS i FROM prediction WHERE tokens IS NOT NULL) WHERE k.text <> ''"
_EVAL_ALL = f"""WITH g0 AS (SELECT * FROM {_SPANS.format(who="'gold'", src=_GOLD_ONE)}), p0 AS (SELECT tool, id, i, word, pos, (sum(length(word)) OVER w - length(word))::BIGINT AS a, (sum(length(word)) OVER w)::BIGINT AS b FROM ({_PRED_ALL}) WINDOW w AS (PARTITION BY tool, id ORDER BY i)),
same AS (SELECT tool, id FROM (SELECT tool, id, string_agg(word, '' ORDER BY i) AS t FROM p0 GROUP BY ALL) JOIN (SELECT id, string_agg(word, '' ORDER BY i) AS t FROM g0 GROUP BY ALL) USING (id, t)),
g AS (SELECT tool, g0.* FROM g0 JOIN same USING (id)), p AS (SELECT * FROM p0 SEMI JOIN same USING (tool, id)),
n AS (SELECT tool, count(*) AS n FROM same GROUP BY tool), gw AS (SELECT tool, id, count(*) AS gold FROM g GROUP BY ALL), pw AS (SELECT tool, id, count(*) AS predicted FROM p GROUP BY ALL),
hw AS (SELECT g.tool, g.id, count(*) AS correct FROM g JOIN p USING (tool, id, a, b) GROUP BY ALL), ew AS (SELECT g.tool, g.id, count(*) AS ends FROM g JOIN p USING (tool, id, b) GROUP BY ALL),
t AS (SELECT tool, sum(gold) AS gold, sum(predicted) AS predicted, sum(coalesce(correct, 0)) AS correct, sum(ends) AS ends, sum((gold = predicted AND gold = correct)::INT) AS exact, any_value(n) AS n FROM gw JOIN pw USING (tool, id) LEFT JOIN hw USING (tool, id) JOIN ew USING (tool, id) JOIN n USING (tool) GROUP BY tool)"""


@query("ev_report", _EVAL_ALL + """ SELECT tool, n::BIGINT AS records, round(correct / predicted, 6) AS word_precision, round(correct / gold, 6) AS word_recall, round(2 * correct / (gold + predicted), 6) AS word_f1,
round((ends - n) / (predicted - n), 6) AS boundary_precision, round((ends - n) / (gold - n), 6) AS boundary_recall, round(2 * (ends - n) / (gold + predicted - 2 * n), 6) AS boundary_f1, round(exact / n, 6) AS exact_share FROM t""")
def ev_report(s, d):
    """Precision, recall and F1 of words and boundaries, and exact records, of every tool."""
    return C.segmentation_metrics(*_all_tools(s, d))


@query("ev_tags", _EVAL_ALL + " SELECT tool, count(*)::BIGINT AS total, sum((g.pos IS NOT DISTINCT FROM p.pos)::INT)::BIGINT AS correct, round(sum((g.pos IS NOT DISTINCT FROM p.pos)::INT) / count(*), 6) AS accuracy FROM g0 g JOIN p0 p USING (id, a, b) WHERE g.pos IS NOT NULL GROUP BY tool")
def ev_tags(s, d):
    """The share of right tags on the spans that each tool shares with the accepted tokens."""
    return C.tag_accuracy(*_all_tools(s, d))


def _all_tools(s, d):
    r = table(s, d, "reviewed").where("review.tokens IS NOT NULL AND split IN ('dev', 'test')").groupBy("id").agg(F.min_by("review.tokens", "row_id").alias("tokens"))
    p = table(s, d, "prediction").where("tokens IS NOT NULL").select(F.struct("tool", "id").alias("id"), "tokens")
    return C.token_spans(r), C.token_spans(p).select("id.tool", "id.id", "i", "word", "pos", "a", "b")


@query("ev_seg", _EVAL_ALL + " SELECT tool, n::BIGINT AS records, gold::BIGINT AS gold, predicted::BIGINT AS predicted, correct::BIGINT AS correct, exact::BIGINT AS exact FROM t")
def ev_seg(s, d):
    return C.segmentation_counts(*_all_tools(s, d))


@query("ev_pos", _EVAL_ALL + " SELECT tool, coalesce(g.pos, '') AS gold, coalesce(p.pos, '') AS predicted, count(*)::BIGINT AS n FROM g JOIN p USING (tool, id, a, b) GROUP BY ALL")
def ev_pos(s, d):
    """The confusion table of the tags of every tool on agreeing spans."""
    g, p = C.comparable(*_all_tools(s, d))
    hit = g.join(p.select("tool", "id", "a", "b", F.col("pos").alias("ppos")), ["tool", "id", "a", "b"])
    return hit.groupBy("tool", F.coalesce("pos", F.lit("")).alias("gold"), F.coalesce("ppos", F.lit("")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query("ev_vocab", "SELECT DISTINCT k.text AS word FROM (SELECT unnest(review.tokens) AS k FROM reviewed WHERE split = 'train') WHERE k.text <> ''")
def ev_vocab(s, d):
    return table(s, d, "reviewed").where("split = 'train'").select(F.explode("review.tokens.text").alias("word")).where("word <> ''").distinct()


_OOV = f", v AS (SELECT DISTINCT k.text AS word FROM (SELECT unnest(review.tokens) AS k FROM reviewed WHERE split = 'train') WHERE k.text <> ''), o AS (SELECT * FROM g ANTI JOIN v USING (word) WHERE regexp_matches(word, '^[{spec.HAN_PIPE}]+\\z'))"


@query("ev_pipe", _EVAL_ALL + _OOV + " SELECT tool, total::BIGINT AS oov_words, coalesce(hit, 0)::BIGINT AS oov_correct, round(coalesce(hit, 0) / total, 6) AS oov_recall, (SELECT count(DISTINCT id) FROM g0)::BIGINT - n::BIGINT AS missing FROM (SELECT tool, count(*) AS total FROM o GROUP BY tool) LEFT JOIN (SELECT o.tool, count(*) AS hit FROM o JOIN p USING (tool, id, a, b) GROUP BY ALL) USING (tool) JOIN n USING (tool)")
def ev_pipe(s, d):
    """Han words that the train records do not have: how many each tool finds, and the records it does not cover."""
    gold, predicted = _all_tools(s, d)
    g, p = C.comparable(gold, predicted)
    oov = g.where(F.col("word").rlike(f"^[{spec.HAN_PIPE}]+\\z")).join(ev_vocab(s, d), "word", "left_anti").select("tool", "id", "a", "b")
    t = oov.join(p.select("tool", "id", "a", "b", F.lit(1).alias("hit")), ["tool", "id", "a", "b"], "left").groupBy("tool").agg(F.count(F.lit(1)).alias("oov_words"), F.count("hit").alias("oov_correct"))
    covered = g.groupBy("tool").agg(F.countDistinct("id").alias("covered")).crossJoin(gold.agg(F.countDistinct("id").alias("records")))  # one row
    return t.join(covered, "tool").select("tool", "oov_words", "oov_correct", F.round(F.col("oov_correct") / F.col("oov_words"), 6).alias("oov_recall"), (F.col("records") - F.col("covered")).alias("missing"))


@query("ev_regress", _EVAL_ALL + " SELECT 'gold_only' AS side, tool, id, a, b, word FROM g ANTI JOIN p USING (tool, id, a, b) UNION ALL SELECT 'predicted_only', tool, id, a, b, word FROM p ANTI JOIN g USING (tool, id, a, b)")
def ev_regress(s, d):
    g, p = C.comparable(*_all_tools(s, d))
    only = lambda x, y, side: x.join(y.select("tool", "id", "a", "b"), ["tool", "id", "a", "b"], "left_anti").select(F.lit(side).alias("side"), "tool", "id", "a", "b", "word")
    return only(g, p, "gold_only").union(only(p, g, "predicted_only"))


@query("ev_timing", "SELECT tool, count(*)::BIGINT AS runs, floor(median(epoch_us(run_at)))::BIGINT AS median_us FROM prediction GROUP BY tool")
def ev_timing(s, d):
    p = table(s, d, "prediction").groupBy("tool").agg(F.count(F.lit(1)).alias("runs"), F.floor(F.percentile(F.unix_micros(F.col("run_at").cast("timestamp")), 0.5)).alias("median_us"))
    return p


@query("ev_speed", "SELECT event_type AS tool, count(*)::BIGINT AS runs, round(median(value), 6) AS median_seconds, round(1400 / median(value), 4) AS sentences_per_second FROM events WHERE value > 0 GROUP BY event_type")
def ev_speed(s, d):
    """Speed by the median of repeated runs of 1,400 sentences; the events' values stand for seconds, their types for tools."""
    return C.median_speed(table(s, d, "events").where("value > 0").select(F.col("event_type").alias("tool"), F.col("value").alias("seconds")), 1400)


@query("ev_corpus_stats", f"SELECT round(avg(length(word)), 6) AS mean_length, round(avg((length(word) = 1)::INT), 6) AS single_share, count(*)::BIGINT AS words FROM {GOLD} WHERE regexp_matches(word, '^[{spec.HAN_TRAIN}]+\\z')")
def ev_corpus_stats(s, d):
    w = gold_tokens(s, d).where(F.col("word").rlike(f"^[{spec.HAN_TRAIN}]+\\z"))
    return w.agg(F.round(F.avg(F.length("word")), 6).alias("mean_length"), F.round(F.avg((F.length("word") == 1).cast("int")), 6).alias("single_share"), F.count(F.lit(1)).alias("words"))

