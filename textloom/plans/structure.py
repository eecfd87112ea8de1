"""Queries of sentences, clauses, blocks, ranking and summaries, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions.signals import signal_score
from textloom.operators import documents as D
from textloom.operators import profile as PR
from textloom.operators.similarity import bm25_pairs, global_running
from textloom.plans.common import documents, q, reviewed, table
from textloom.plans.registry import query
from textloom.session import cut_lineage, spread


def _rows(df, key, column):
    return df.select(key, "text", F.posexplode(column).alias("n", "r"))


@query("sent_split")
def sent_split(s, d):
    """Sentences of every text, counted by their words."""
    r = _rows(reviewed(s, d), "row_id", D.sentences_column(F.col("text"))).select("row_id", F.expr("substring(text, r.start + 1, r.end - r.start)").alias("sentence"))
    return r.groupBy("row_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


def _like(xs):
    return "(" + " OR ".join(f"contains(c, {q(x)})" for x in xs) + ")"


_ACRONYM_SQL = " OR ".join(f"(regexp_matches(c, '{a}[A-Z0-9&./-]{{1,12}}{b}[^{a}]*\\z') AND regexp_matches(c, '{a}[0-9&./-]*[A-Z][0-9&./-]*[A-Z][A-Z0-9&./-]*{b}[^{a}]*\\z'))" for a, b in (("（", "）"), ("\\(", "\\)")))


@query(
    "sent_dependent",
    f"""SELECT row_id, n, {_like(spec.DEPENDENT_ANYWHERE)} OR {' OR '.join(f'starts_with(c, {q(x)})' for x in spec.DEPENDENT_PREFIX)} OR ({_like(spec.CONDITION)} AND ({' OR '.join(f'ends_with(c, {q(x)})' for x in spec.CONDITION_UNITS)})) OR {_like(spec.DEFINITION)} OR regexp_matches(c, '先($|[^生進前祖])') OR {_ACRONYM_SQL} AS dependent
FROM (SELECT row_id, n::BIGINT AS n, regexp_replace(trim(regexp_replace(trim(x), '[，,]+$', '')), '^[0-9.)）、]*', '') AS c FROM (SELECT row_id, unnest(l) AS x, unnest(range(len(l))) AS n FROM (SELECT row_id, regexp_extract_all(text, '[^，。！？\\n\\r]+，') AS l FROM reviewed)))""",
)
def sent_dependent(s, d):
    t = reviewed(s, d).select("row_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^，。！？\n\r]+，"), F.lit(0))).alias("n", "x"))
    return t.select("row_id", F.col("n").cast("long").alias("n"), D.depends_sql("x").alias("dependent"))


@query("clause_split")
def clause_split(s, d):
    r = _rows(reviewed(s, d), "row_id", D.clauses_column(F.col("text")))
    return r.select("row_id", "r.sentence", F.col("n").alias("clause"), F.expr("trim(substring(text, r.start + 1, r.end - r.start))").alias("clause_text"))


query("ts_sent")(lambda s, d: _rows(reviewed(s, d), "row_id", _period_sentences(F.col("text"))).select("row_id", F.col("n").alias("sentence"), "r.start", "r.end"))
query("ts_clause")(lambda s, d: _rows(reviewed(s, d), "row_id", _comma_clauses(F.col("text"))).select("row_id", "r.sentence", F.col("n").alias("clause"), "r.start", "r.end"))
_period_sentences = D._spans("start:int,end:int", lambda t: D.split_sentences(t, period=True))
_comma_clauses = D._spans("sentence:int,start:int,end:int", lambda t: D.split_clauses(t, semicolon=False, colon=False))


@query("blk_lines", "SELECT doc_id, n::BIGINT AS line_no, line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS l FROM documents))")
def blk_lines(s, d):
    t = documents(s, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))).alias("line_no", "line"))
    return t.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


_CLASSES = {
    "blank": r"^[ \t\r]*\z", "fence": r"^ {0,3}(?:`{3,}|~{3,})", "indented": r"^(?:    |\t)", "atx": r"^ {0,3}#{1,6}(?:[ \t]|\z)",
    "thematic": r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\z", "list": rf"^[ \t]*(?:[{spec.BULLETS.replace('-', '')}-] |[0-9一二三四五六七八九十]+(?:[.)] |） |、))", "quote": r"^[ \t]*>",
}


@query("blk_lineclass", "SELECT doc_id, class, count(*)::BIGINT AS n FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(line, {q(p)}) THEN '{k}'" for k, p in _CLASSES.items()) + " ELSE 'text' END AS class FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY ALL")
def blk_lineclass(s, d):
    t = documents(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    kind = F.lit("text")
    for k, p in reversed(_CLASSES.items()):
        kind = F.when(F.col("line").rlike(p), k).otherwise(kind)
    return t.groupBy("doc_id", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _blocks(s, d):
    return D.document_blocks(spread(documents(s, d)), "doc_id", "text").withColumnRenamed("doc", "doc_id")


query("blk_parse")(lambda s, d: _blocks(s, d).select("doc_id", "block", "kind", "depth", F.length("body").cast("long").alias("chars")))


@query("blk_children")
def blk_children(s, d):
    """Children of list items: the items of the next depth under them."""
    return _blocks(s, d).where("parent >= 0").select("doc_id", F.col("parent").alias("item"), F.col("block").alias("child"), "depth")


query("blk_embedded")(lambda s, d: _blocks(s, d).where("kind LIKE '%list-item'").select("doc_id", "block", "embedded"))


def _retained(s, d):
    """Blocks that stay in any summary: code, tables, HTML and list items."""
    b = _blocks(s, d).withColumnRenamed("doc_id", "doc")
    return b.select("doc", "block", "kind", "depth", F.col("kind").isin(*D.PROTECTED, "ordered-list-item", "unordered-list-item").alias("retained"))


query("blk_context")(lambda s, d: D.kept_headings(_retained(s, d)).withColumnRenamed("doc", "doc_id"))
query("blk_breaks")(lambda s, d: D.kept_breaks(_retained(s, d)).withColumnRenamed("doc", "doc_id"))


@query("sig_all")
def sig_all(s, d):
    """All signals of every block, counted by kind."""
    b = D.with_signals(_blocks(s, d), "body")
    return b.select("doc_id", "block", F.col("kind").endswith("list-item").alias("list_item"), *D.signal_counts(F.col("spans")))


@query("qty_suppress")
def qty_suppress(s, d):
    """Quantities of every document that are not inside a date or an amount of money."""
    t = D.with_signals(documents(s, d), "text").select("doc_id", F.explode("spans").alias("r")).where("r.kind = 'quantity'")
    return t.select("doc_id", F.col("r.start").alias("char_start"), F.col("r.end").alias("char_end"))


query("cand_bound")(lambda s, d: D.bounded(D.ranked_blocks(_blocks(s, d).withColumnRenamed("doc_id", "doc")), 3).select(F.col("doc").alias("doc_id"), "block"))


@query("pagerank_sum")
def pagerank_sum(s, d):
    """The rank of every candidate block in its document's graph of similarities; the ranks of a document add up to one."""
    p = cut_lineage(D.bounded(D.ranked_blocks(_blocks(s, d).withColumnRenamed("doc_id", "doc")), 3))
    sims = bm25_pairs(p.select(F.col("doc").alias("block"), F.col("block").alias("id"), "text"))
    return D.block_ranks(p, sims).withColumnRenamed("doc", "doc_id")


def _summary(s, d):
    return D.summary_documents(spread(documents(s, d)), "doc_id", "text")


query("summary")(lambda s, d: _summary(s, d)[1].withColumnRenamed("doc", "doc_id"))
query("assemble")(lambda s, d: _summary(s, d)[1].select(F.col("doc").alias("doc_id"), "summary"))
query("preserve")(lambda s, d: _summary(s, d)[0].select(F.col("doc").alias("doc_id"), "block", "kind", "decision", F.length("output").alias("output_chars")))


@query("select_mmr")
def select_mmr(s, d):
    """The blocks chosen for every document, best first."""
    w = Window.partitionBy("doc").orderBy(F.desc("score"), "block")
    return _summary(s, d)[0].where("score IS NOT NULL").select(F.col("doc").alias("doc_id"), "block", "score", F.row_number().over(w).alias("place"))


@query("summary_report")
def summary_report(s, d):
    """Over all documents: how many, their characters before and after, and the share of documents by overflow."""
    t = _summary(s, d)[1]
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return t.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("input_chars").alias("input_chars"), F.sum("output_chars").alias("output_chars"), share(F.col("preserved") > 0).alias("preserved_share"),
        share(F.col("forced") > 0).alias("forced_share"), share(F.col("bounded") < F.col("candidates")).alias("bounded_share"), F.round(F.avg("reduction"), 4).alias("mean_reduction"),
    )


@query("long_block")
def long_block(s, d):
    """Blocks with three clauses or more, and over 240 characters or 60 Latin words."""
    b = _blocks(s, d).select("doc_id", "block", F.length("body").cast("long").alias("chars"), "body", F.size(D.whole_clauses_column(F.col("body"))).alias("clauses"))
    return b.select("doc_id", "block", "chars", "clauses", D.is_long(F.col("body"), F.col("clauses")).alias("long"))


query("clause_rank")(lambda s, d: D.ranked_clauses(_blocks(s, d).withColumnRenamed("doc_id", "doc")).withColumnRenamed("doc", "doc_id"))


@query("cumcurve")
def cumcurve(s, d):
    """Cumulative share of the scores of the chosen blocks, best first."""
    t = _summary(s, d)[0].where("score IS NOT NULL").select(F.col("doc").alias("doc_id"), "block", F.greatest("score", F.lit(0.0)).alias("x"))
    r = global_running(t, [F.desc("x"), F.col("doc_id"), F.col("block")], "x")
    return r.select("doc_id", "block", "rank", F.round(F.col("run") / F.col("total"), 6).alias("share"))


# ---------------------------------------------------------------- the second profile
@query("tsv_weights")
def tsv_weights(s, d):
    """The blocks chosen under the weights of the second profile, without a threshold."""
    p = cut_lineage(D.bounded(D.ranked_blocks(_blocks(s, d).withColumnRenamed("doc_id", "doc")), 3))
    sims = bm25_pairs(p.select(F.col("doc").alias("block"), F.col("block").alias("id"), "text"))
    chosen = D.summarise(p.select("doc", "block", "terms", "discourse", "signal"), sims, 3, 0.0, PR.BLOCK_WEIGHTS["relevance"], PR.BLOCK_WEIGHTS["final"])
    return chosen.withColumnRenamed("doc", "doc_id")


_TOK = f"(SELECT source || '/' || source_index || '/' || md5(text) AS rid, i, word, tag FROM (SELECT source, source_index, text, k.text AS word, k.ckip_pos AS tag, i FROM (SELECT source, source_index, text, unnest(tokens) AS k, generate_subscripts(tokens, 1) - 1 AS i FROM (SELECT DISTINCT source, source_index, text, tokens FROM annotation WHERE text IS NOT NULL AND tokens IS NOT NULL AND source IS NOT NULL))) WHERE word <> '')"


def _annotated(s, d):
    a = table(s, d, "annotation").where("text IS NOT NULL AND tokens IS NOT NULL AND source IS NOT NULL").select("source", "source_index", "text", "tokens").distinct()
    a = a.withColumn("rid", F.concat_ws("/", "source", F.col("source_index").cast("string"), F.md5("text")))
    return a, a.select("rid", F.posexplode("tokens").alias("i", "k")).select("rid", F.col("i").cast("long").alias("i"), F.col("k.text").alias("word"), F.col("k.ckip_pos").alias("tag")).where("word <> ''")


_GONE = f"coalesce((regexp_matches(tag, '^(D|Da|Dfa|Dfb|Di|Dk|Caa|Cab|Cba|Cbb|I)\\z') OR (tag = 'T' AND word IN ({','.join(q(x) for x in spec.INTERJECTIONS)}))) AND word NOT IN ({','.join(q(x) for x in spec.MEANING_WORDS)}), false)"


@query("tsv_compact", f"SELECT rid, CASE WHEN n = 0 OR regexp_matches(short, '^[{spec.SPACE}]*\\z') THEN whole ELSE short END AS text, (CASE WHEN regexp_matches(short, '^[{spec.SPACE}]*\\z') THEN 0 ELSE n END)::BIGINT AS removed FROM (SELECT rid, string_agg(word, '' ORDER BY i) AS whole, regexp_replace(coalesce(string_agg(word, '' ORDER BY i) FILTER (WHERE NOT gone), ''), '[ \\t]{{2,}}', ' ', 'g') AS short, sum(gone::INT) AS n FROM (SELECT *, {_GONE} AS gone FROM {_TOK}) GROUP BY rid)")
def tsv_compact(s, d):
    return PR.compacted(_annotated(s, d)[1])


_PARTS = f"(SELECT rid, part, text, coalesce(nouns, false) AND length(regexp_replace(text, '[，,、；;。！？!?…\\s]+\\z', '')) BETWEEN 1 AND 8 AS nominal FROM (SELECT rid, part, string_agg(word, '' ORDER BY i) AS text, bool_and(coalesce(regexp_matches(tag, '^(N|FW)'), false)) FILTER (WHERE NOT coalesce(regexp_matches(tag, 'CATEGORY\\z'), false)) AS nouns FROM (SELECT *, coalesce(sum(regexp_matches(word, '[，,、；;。！？!?]\\z')::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM {_TOK}) GROUP BY rid, part))"


@query(
    "enum_merge",
    f"WITH p AS (SELECT *, sum((NOT nominal)::INT) OVER (PARTITION BY rid ORDER BY part) AS run FROM {_PARTS}), l AS (SELECT *, nominal AND sum(nominal::INT) OVER (PARTITION BY rid, run) >= 2 AS long FROM p), m AS (SELECT *, long OR coalesce(lead(long) OVER (PARTITION BY rid ORDER BY part), false) AS inside FROM l), g AS (SELECT *, sum((NOT inside OR NOT coalesce(before, false))::INT) OVER (PARTITION BY rid ORDER BY part) AS island FROM (SELECT *, lag(inside) OVER (PARTITION BY rid ORDER BY part) AS before FROM m)) SELECT rid, min(part) AS \"first\", max(part) AS \"last\", string_agg(text, '' ORDER BY part) AS text FROM g GROUP BY rid, island",
)
def enum_merge(s, d):
    """Clauses of the annotation records with enumerations of nouns kept in one piece."""
    return PR.merged_enumerations(PR.clause_parts(_annotated(s, d)[1]))


@query("ts_signals")
def ts_signals(s, d):
    a, t = _annotated(s, d)
    return PR.tag_signal_score(a.select("rid", "text"), t)


@query("tsv_compress")
def tsv_compress(s, d):
    """Clauses of long reviewed texts with their score, and whether they are kept."""
    c = _rows(reviewed(s, d), "row_id", _comma_clauses(F.col("text"))).select(F.col("row_id").alias("rid"), F.col("n").alias("part"), F.expr("trim(substring(text, r.start + 1, r.end - r.start))").alias("text"))
    return PR.compressed(c.withColumn("signal", signal_score(F.col("text")))).withColumnRenamed("rid", "row_id")
