"""Queries of pattern predicates, signals and terms, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions.signals import DISCOURSE_SQL, discourse_score, negations, signal_count, signal_score
from textloom.functions.text import norm_text
from textloom.operators.similarity import bm25_pairs, cosine_pairs, document_terms
from textloom.plans.common import documents, q, reviewed
from textloom.plans.registry import query


def _counting(name: str, pattern: str, normalised: bool = False):
    """Documents with the number of matches of one pattern; the same pattern runs in both engines."""

    def run(s, d):
        text = norm_text(F.col("text")) if normalised else F.col("text")
        return documents(s, d).select("doc_id", F.regexp_count(text, F.lit(pattern)).cast("long").alias("n"))

    text = f"translate(text, {q(spec.NORM_FROM)}, {q(spec.NORM_TO)})" if normalised else "text"
    query(name, f"SELECT doc_id, len(regexp_extract_all({text}, {q(pattern)}))::BIGINT AS n FROM documents")(run)


for _name, _pattern in (("rx_email", spec.EMAIL), ("rx_model_id", spec.MODEL_ID), ("rx_ordinal", spec.ORDINAL), ("rx_taiwan", spec.TAIWAN)):
    _counting(_name, _pattern, normalised=True)

# Matches of fewer than four bytes are no addresses.
@query("rx_url", f"SELECT doc_id, len(list_filter(regexp_extract_all(text, {q(spec.URL)}), lambda x: strlen(x) >= 4))::BIGINT AS n FROM documents")
def rx_url(s, d):
    found = F.filter(F.regexp_extract_all("text", F.lit(spec.URL), F.lit(0)), lambda x: F.octet_length(x) >= 4)
    return documents(s, d).select("doc_id", F.size(found).cast("long").alias("n"))


def _rejecting(name: str, pattern: str, before: str, after: str):
    """Find, then reject by the neighbours: a match is taken first and dropped then, so it hides what it covers."""

    def run(s, d):
        marked = F.regexp_replace("text", F.lit(f"({pattern})"), F.lit("￰$1￱"))
        inner = f"￰[^￰￱]*￱"
        bad = "|".join(x for x in (f"{before}{inner}" if before else "", f"{inner}{after}" if after else "") if x)
        all_, left = F.regexp_count(marked, F.lit("￰")), F.regexp_count(F.regexp_replace(marked, F.lit(bad), F.lit("")), F.lit("￰"))
        return documents(s, d).select("doc_id", all_.cast("long").alias("found"), left.cast("long").alias("kept"))

    marked = f"regexp_replace(text, {q('(' + pattern + ')')}, '￰\\1￱', 'g')"
    inner = "￰[^￰￱]*￱"
    bad = "|".join(x for x in (f"{before}{inner}" if before else "", f"{inner}{after}" if after else "") if x)
    query(name, f"SELECT doc_id, len(regexp_extract_all(m, '￰'))::BIGINT AS found, len(regexp_extract_all(regexp_replace(m, {q(bad)}, '', 'g'), '￰'))::BIGINT AS kept FROM (SELECT doc_id, {marked} AS m FROM documents)")(run)


_rejecting("rx_cn_time", spec.CN_TIME, "第", "")
_rejecting("rx_cn_qty", spec.CN_QTY, "第", "")
_rejecting("rx_num_time", spec.NUM_TIME, f"[{spec.ALNUM}]", "")
_rejecting("rx_number", spec.NUMBER, f"[{spec.ALNUM}]", f"[{spec.ALNUM}]")



@query("rx_pii", f"SELECT row_id, regexp_matches(text, {q(spec.PII_PLAIN)}) AS suspected FROM reviewed")
def rx_pii(s, d):
    return reviewed(s, d).select("row_id", F.col("text").rlike(spec.PII).alias("suspected"))


_HTML = rf"(?m)^[ \t]*(?:<!--|<!DOCTYPE|<\?|</?(?:{spec.HTML_TAGS})(?:\s|>|/))"


@query("rx_html_start", f"SELECT doc_id, len(regexp_extract_all(text, {q(_HTML)}))::BIGINT AS n FROM documents")
def rx_html_start(s, d):
    return documents(s, d).select("doc_id", F.regexp_count("text", F.lit(_HTML)).cast("long").alias("n"))


# ASCII word boundaries, spelled out, so that both engines agree on text of any script.
for _name in ("number", "date", "money", "quantity", "emphasis"):
    _counting(f"sig_{_name}", spec.SIGNALS[_name].replace(r"\s", r"[\t\n\f\r ]"))


# RE2 has word boundaries of ASCII only; with a low line for every other letter they fall where those of all scripts do.
for _name in ("acronym", "proper_en"):
    _sql = f"SELECT doc_id, len(regexp_extract_all(list_aggregate(list_transform(regexp_extract_all(text, '[\\x00-\\x7F]+|[^\\x00-\\x7F]+'), lambda x: CASE WHEN x < chr(128) THEN x ELSE regexp_replace(x, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]', '_', 'g') END), 'string_agg', ''), {q(spec.SIGNALS[_name])}))::BIGINT AS n FROM documents"
    query(f"sig_{_name}", _sql)(lambda s, d, n=_name: documents(s, d).select("doc_id", signal_count(F.col("text"), n).alias("n")))
query("sig_object")(lambda s, d: documents(s, d).select("doc_id", signal_count(F.col("text"), "object").alias("n")))

_CJK_SQL = spec.SIGNALS["proper_cjk"]


@query("sig_proper_cjk", f"SELECT doc_id, len(regexp_extract_all(text, {q(_CJK_SQL)}))::BIGINT AS n FROM documents")
def sig_proper_cjk(s, d):
    return documents(s, d).select("doc_id", F.regexp_count("text", F.lit(_CJK_SQL.replace(r"\p{Han}", r"\p{IsHan}"))).cast("long").alias("n"))


_NEG_SQL = (
    f"len(regexp_extract_all(text, '[{spec.NEGATION_CHARS}]')) - len(regexp_extract_all(text, {q('|'.join(x for x in spec.NEGATION_EXCLUDED if x[0] in spec.NEGATION_CHARS))})) - len(regexp_extract_all(text, '是否([^則]|$)'))"
)
_EN_SQL = f"len(regexp_extract_all(e, {q(spec.NEGATION_EN)})) - len(regexp_extract_all(e, '\\bnot only')) - len(regexp_extract_all(e, 'whether or not\\b')) - len(regexp_extract_all(e, 'neither nor\\b'))"


@query("sig_negation", f"SELECT doc_id, ({_NEG_SQL})::BIGINT AS han, ({_EN_SQL})::BIGINT AS english FROM (SELECT doc_id, text, regexp_replace(lower(text), '[^\\x00-\\x7F]+', ' ', 'g') AS e FROM documents)")
def sig_negation(s, d):
    han, english = negations(F.col("text"))
    return documents(s, d).select("doc_id", han.alias("han"), english.alias("english"))


@query("sig_discourse", f"SELECT doc_id, {DISCOURSE_SQL} AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def sig_discourse(s, d):
    return documents(s, d).select("doc_id", discourse_score(F.col("text")).alias("score"))


@query("sig_score")
def sig_score(s, d):
    return documents(s, d).select("doc_id", F.round(signal_score(F.col("text")), 6).alias("score"))


_MARKER = rf"^[ \t]*(?:[{spec.BULLETS.replace('-', '')}-] |[0-9一二三四五六七八九十]+(?:[.)] |） |、))"


@query("sig_listitem", f"SELECT doc_id, n AS line_no, regexp_extract(line, {q(_MARKER)}) AS marker FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(line, {q(_MARKER)})")
def sig_listitem(s, d):
    lines = documents(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(_MARKER)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.regexp_extract("line", _MARKER, 0).alias("marker"))


# ---------------------------------------------------------------- terms and similarity
_HAN = f"[{spec.HAN_TERMS}]"
TERMS_SQL = f"""(SELECT doc_id, term, count(*)::BIGINT AS tf FROM (
SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spec.NORM_FROM[:26]}', '{spec.NORM_TO[:26]}'), '[a-z0-9_.-]+')) AS term FROM documents
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '{_HAN}')) FROM documents
UNION ALL SELECT doc_id, substr(run, i::INT, 2) FROM (SELECT doc_id, run, unnest(range(1, length(run))) AS i FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_HAN}+')) AS run FROM documents))
) GROUP BY ALL)"""


@query("terms", f"SELECT doc_id, term, tf FROM {TERMS_SQL}")
def terms(s, d):
    return document_terms(documents(s, d), "doc_id", "text")


@query("term_df", f"SELECT term, count(*)::BIGINT AS df FROM {TERMS_SQL} GROUP BY term")
def term_df(s, d):
    return document_terms(documents(s, d), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


# Similarity is between the paragraphs of one document, never across documents.
_BLOCKS = """(SELECT doc_id AS block, i::BIGINT AS id, p[i + 1] AS text FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents)))"""
_BTERMS = f"""bt AS (SELECT block, id, term, count(*)::DOUBLE AS tf FROM (
SELECT block, id, unnest(regexp_extract_all(translate(text, '{spec.NORM_FROM[:26]}', '{spec.NORM_TO[:26]}'), '[a-z0-9_.-]+')) AS term FROM {_BLOCKS}
UNION ALL SELECT block, id, unnest(regexp_extract_all(text, '{_HAN}')) FROM {_BLOCKS}
UNION ALL SELECT block, id, substr(run, i::INT, 2) FROM (SELECT block, id, run, unnest(range(1, length(run))) AS i FROM (SELECT block, id, unnest(regexp_extract_all(text, '{_HAN}+')) AS run FROM {_BLOCKS}))
) GROUP BY ALL),
size AS (SELECT block, id, sum(tf) AS len, count(*)::DOUBLE AS nterms FROM bt GROUP BY ALL),
blk AS (SELECT block, count(*)::DOUBLE AS n, avg(len) AS avgdl FROM size GROUP BY block),
df AS (SELECT block, term, count(*)::DOUBLE AS df FROM bt GROUP BY ALL)"""


def _blocks(s, d):
    return documents(s, d).select(F.col("doc_id").alias("block"), F.posexplode(F.split("text", "\n\n")).alias("id", "text")).select("block", F.col("id").cast("long").alias("id"), "text")


@query(
    "sim_bm25",
    f"""WITH {_BTERMS},
p AS (SELECT a.block, a.id AS a, b.id AS b,
 sum(ln((n - df + 0.5) / (df + 0.5) + 1) * b.tf * 2.2 / (b.tf + 1.2 * (0.25 + 0.75 * sb.len / avgdl))) / any_value(sa.nterms) AS ab,
 sum(ln((n - df + 0.5) / (df + 0.5) + 1) * a.tf * 2.2 / (a.tf + 1.2 * (0.25 + 0.75 * sa.len / avgdl))) / any_value(sb.nterms) AS ba
 FROM bt a JOIN bt b ON a.block = b.block AND a.term = b.term AND a.id < b.id JOIN df ON df.block = a.block AND df.term = a.term JOIN blk ON blk.block = a.block
 JOIN size sa ON sa.block = a.block AND sa.id = a.id JOIN size sb ON sb.block = b.block AND sb.id = b.id GROUP BY ALL)
SELECT block, a, b, round((ab + ba) / 2 / (1 + (ab + ba) / 2), 6) AS sim FROM p""",
)
def sim_bm25(s, d):
    return bm25_pairs(_blocks(s, d))


@query(
    "sim_cosine",
    f"""WITH {_BTERMS}, norm AS (SELECT block, id, sqrt(sum(tf * tf)) AS norm FROM bt GROUP BY ALL)
SELECT a.block, a.id AS a, b.id AS b, round(sum(a.tf * b.tf) / (any_value(na.norm) * any_value(nb.norm)), 6) AS sim
FROM bt a JOIN bt b ON a.block = b.block AND a.term = b.term AND a.id < b.id JOIN norm na ON na.block = a.block AND na.id = a.id JOIN norm nb ON nb.block = b.block AND nb.id = b.id GROUP BY ALL""",
)
def sim_cosine(s, d):
    return cosine_pairs(_blocks(s, d))
