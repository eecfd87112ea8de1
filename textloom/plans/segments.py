"""Queries of scanning, decoding, tagging and keywords, with SQL twins where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions.text import chars, norm_text  # noqa: F401
from textloom.operators import annotate as A
from textloom.operators import keywords as K
from textloom.operators import segment as S
from textloom.operators.lexicon import dict_matches
from textloom.plans import training as TR
from textloom.plans.common import GOLD, gold_tokens, reviewed, table
from textloom.plans.registry import query
from textloom.plans.scalars import _CLASS_SQL
from textloom.sources.files import token_json
from textloom.session import ensure_checkpoint_dir, spread

_SCAN = f"[{spec.ALNUM}]+|[{spec.HAN_CORE}]+|[{spec.SPACE}]+|([{spec.PUNCT}])\\1*|[^{spec.ALNUM}{spec.HAN_CORE}{spec.SPACE}{spec.PUNCT}]+"
_ISLANDS = f"""(SELECT row_id, (min(i) - 1)::BIGINT AS char_start, max(i)::BIGINT AS char_end, string_agg(ch, '' ORDER BY i) AS word, CASE class WHEN 'Alnum' THEN CASE WHEN bool_and(ch BETWEEN '0' AND '9') THEN 'Num' ELSE 'Eng' END ELSE class END AS kind FROM (
SELECT *, sum(brk) OVER (PARTITION BY row_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(class) OVER w IS DISTINCT FROM class OR (class = 'Punct' AND lag(ch) OVER w <> ch) THEN 1 ELSE 0 END AS brk FROM (
SELECT row_id, i, ch, {_CLASS_SQL} AS class FROM (SELECT row_id, unnest(l) AS ch, generate_subscripts(l, 1) AS i FROM (SELECT row_id, regexp_extract_all(text, '(?s).') AS l FROM reviewed))) WINDOW w AS (PARTITION BY row_id ORDER BY i))) GROUP BY row_id, run, class)"""
_TAGS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.FIXED_TAGS.items())


def _scanned(s, d):
    """Runs of one class, in the JVM: one regular expression finds them, running lengths give the offsets."""
    t = reviewed(s, d).select("row_id", F.posexplode(F.regexp_extract_all("text", F.lit(_SCAN), F.lit(0))).alias("i", "word"))
    end = F.sum(F.length("word")).over(Window.partitionBy("row_id").orderBy("i")).cast("long")
    w = F.col("word")
    kind = F.when(w.rlike(f"^[{spec.HAN_CORE}]"), "Han").when(w.rlike(r"^[0-9]+\z"), "Num").when(w.rlike(f"^[{spec.ALNUM}]"), "Eng").when(w.rlike(f"^[{spec.SPACE}]"), "Space").when(w.rlike(f"^[{spec.PUNCT}]"), "Punct").otherwise("Other")
    return t.select("row_id", "word", kind.alias("kind"), end.alias("char_end")).select("row_id", (F.col("char_end") - F.length("word")).alias("char_start"), "char_end", "word", "kind")


query("scan_plain", f"SELECT * FROM {_ISLANDS}")(_scanned)


@query("pos_fixed", f"SELECT row_id, char_start, CASE kind {_TAGS} ELSE '' END AS tag FROM {_ISLANDS}")
def pos_fixed(s, d):
    tag = F.coalesce(F.create_map(*[F.lit(x) for kv in S.FIXED_TAGS.items() for x in kv])[F.col("kind")], F.lit(""))
    return _scanned(s, d).select("row_id", "char_start", tag.alias("tag"))


@query("pos_runs", f"SELECT row_id, min(char_start) AS char_start, count(*)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY char_start) - row_number() OVER (PARTITION BY row_id, kind = 'Han' ORDER BY char_start) AS g FROM {_ISLANDS}) WHERE kind = 'Han' GROUP BY row_id, g")
def pos_runs(s, d):
    """Maximal runs of segments without a fixed tag."""
    t = _scanned(s, d).withColumn("han", F.col("kind") == "Han")
    t = t.withColumn("g", F.row_number().over(Window.partitionBy("row_id").orderBy("char_start")) - F.row_number().over(Window.partitionBy("row_id", "han").orderBy("char_start")))
    return t.where("han").groupBy("row_id", "g").agg(F.min("char_start").alias("char_start"), F.count(F.lit(1)).alias("n")).drop("g")


@query("snk_words", f"SELECT row_id, string_agg(word, ' ' ORDER BY char_start) AS line FROM {_ISLANDS} WHERE kind <> 'Space' GROUP BY row_id")
def snk_words(s, d):
    t = _scanned(s, d).where("kind <> 'Space'").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "word"))).alias("w"))
    return t.select("row_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("line"))


query("snk_jsonl")(lambda s, d: token_json(tokenize(s, d), "row_id"))


@query("ivl_preselect")
def ivl_preselect(s, d):
    """Protected spans after competition, with the rule that won."""
    t = reviewed(s, d).select("row_id", F.explode(S.trace_column(F.col("text"))).alias("r"))
    return t.select("row_id", "r.rule", "r.kind", "r.start", "r.end")


query("seg_trace")(lambda s, d: ivl_preselect(s, d).groupBy("rule", "kind").agg(F.count(F.lit(1)).alias("applications"), F.countDistinct("row_id").alias("texts")))


@query("ivl_cover")
def ivl_cover(s, d):
    """Segments of every text without a model; their words join to the normalised text."""
    return reviewed(s, d).select("row_id", S.cut_column(F.col("text")).alias("words"))


def model_counts(s, d):
    """Counts (kind, key, n) of the accepted records; words seen at least three times. One pass gives all character counts: each
    character emits its keys, and one aggregate adds them up."""
    st = TR._states(s, d)
    keys = {"trans1": ("s1", "state"), "trans2": ("s2", "s1", "state"), "emit1": ("state", "ch"), "emit2": ("s1", "state", "ch"), "ptrans1": ("j1", "joint"), "ptrans2": ("j2", "j1", "joint"), "pemit": ("joint", "ch")}
    emitted = [F.when(F.col("s1").isNull(), F.struct(F.lit("start").alias("kind"), F.col("state").alias("key"))), F.when(F.col("j1").isNull(), F.struct(F.lit("pstart").alias("kind"), F.col("joint").alias("key")))]
    emitted += [
        F.when(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0, F.struct(F.lit(k).alias("kind"), F.concat_ws(S.SEP if k.startswith("ptrans") else "", *columns).alias("key")))
        for k, columns in keys.items()
    ]
    chars_ = st.select(F.explode(F.filter(F.array(*emitted), lambda x: x.isNotNull())).alias("e")).groupBy("e.kind", "e.key").agg(F.count(F.lit(1)).alias("n"))
    han = F.col("word").rlike(TR._HAN)
    emitted = [
        F.when(han & F.length("word").between(2, S.MAX_WORD), F.struct(F.lit("word").alias("kind"), norm_text(F.col("word")).alias("key"))),
        F.when(F.col("word").rlike("[A-Za-z0-9]") & F.col("word").rlike(f"[{spec.HAN_CORE}]"), F.struct(F.lit("mixed").alias("kind"), norm_text(F.col("word")).alias("key"))),
        F.when(han & F.col("pos").isNotNull(), F.struct(F.lit("tag").alias("kind"), F.concat_ws("\t", norm_text(F.col("word")), "pos").alias("key"))),
    ]
    words = gold_tokens(s, d).select(F.explode(F.filter(F.array(*emitted), lambda x: x.isNotNull())).alias("e")).groupBy("e.kind", "e.key").agg(F.count(F.lit(1)).alias("n"))
    return chars_.unionByName(words.where("n >= CASE kind WHEN 'tag' THEN 2 ELSE 3 END"))


_trained: dict[tuple[str, str], str] = {}


def trained(s, d):
    """The counts, written once for an application and its input files to the shared folder, and read from there."""
    files = sorted(table(s, d, "reviewed").inputFiles())
    key = (s.sparkContext.applicationId, "|".join(files))
    if key not in _trained:
        path = f"{ensure_checkpoint_dir(s)}/model-{uuid.uuid4().hex}"
        model_counts(s, d).write.parquet(path)
        _trained[key] = path
    return s.read.parquet(_trained[key])


def _model(s, d):
    return S.load_model(trained(s, d))


_KEYS = {"start": "CASE WHEN s1 IS NULL THEN state END", "pstart": "CASE WHEN j1 IS NULL THEN joint END", "trans1": "s1 || state", "trans2": "s2 || s1 || state", "emit1": "state || ch", "emit2": "s1 || state || ch"}
_KEYS |= {"ptrans1": "j1 || chr(31) || joint", "ptrans2": "j2 || chr(31) || j1 || chr(31) || joint", "pemit": "joint || ch"}
_NORM_WORD = f"translate(word, '{spec.NORM_FROM}', '{spec.NORM_TO}')"
_WORDS = {"word": (f"CASE WHEN regexp_matches(word, '{TR._HAN}') AND length(word) BETWEEN 2 AND 255 THEN {_NORM_WORD} END", 3), "mixed": (f"CASE WHEN regexp_matches(word, '[A-Za-z0-9]') AND regexp_matches(word, '[{spec.HAN_CORE}]') THEN {_NORM_WORD} END", 3)}
_WORDS["tag"] = (f"CASE WHEN regexp_matches(word, '{TR._HAN}') THEN {_NORM_WORD} || chr(9) || pos END", 2)
_BUILD = " UNION ALL ".join(
    [f"SELECT '{k}' AS kind, {v} AS key, count(*) AS n FROM {TR._STATES} WHERE {v} IS NOT NULL GROUP BY ALL" for k, v in _KEYS.items()]
    + [f"SELECT '{k}' AS kind, {v} AS key, count(*) AS n FROM {GOLD} WHERE {v} IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}" for k, (v, least) in _WORDS.items()]
)


@query("tr_build", f"SELECT kind, count(*)::BIGINT AS entries, sum(n)::BIGINT AS occurrences FROM ({_BUILD}) GROUP BY kind")
def tr_build(s, d):
    """Trains the model and reports its tables: entries and occurrences of each kind."""
    return trained(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("occurrences"))


@query("seg_cut")
def seg_cut(s, d):
    return spread(reviewed(s, d)).select("row_id", S.cut_column(F.col("text"), _model(s, d)).alias("words"))


@query("seg_viterbi")
def seg_viterbi(s, d):
    """The best path through every text: its spans, and the score of every Han word behind those before it."""
    t = spread(reviewed(s, d)).select("row_id", F.posexplode(S.path_column(F.col("text"), _model(s, d))).alias("step", "r"))
    return t.select("row_id", "step", "r.start", "r.end", "r.kind", F.round("r.score", 6).alias("score"))


def _spans(s, d, f):
    t = spread(reviewed(s, d)).select("row_id", F.explode(S.spans_column(F.col("text"), f)).alias("r"))
    return t.select("row_id", F.col("r.start").alias("char_start"), F.col("r.end").alias("char_end"), "r.kind")


@query("ivl_anchor")
def ivl_anchor(s, d):
    """Dictionary words that mix letters or digits with Han, and the protected ones: they stand before any segmentation."""
    model = _model(s, d)
    return _spans(s, d, lambda x: [(a, b, "Word") for a, b in S.anchors(model, x)])


@query("ivl_postselect")
def ivl_postselect(s, d):
    """The merges made behind segmentation, of both rules: by first segment, priority and end."""
    model = _model(s, d)
    return _spans(s, d, lambda x: S.edits(model, x, measure=True))


query("post_time")(lambda s, d: ivl_postselect(s, d).where("kind = 'Time'"))
query("post_measure")(lambda s, d: ivl_postselect(s, d).where("kind = 'Num'"))


@query("seg_edges")
def seg_edges(s, d):
    """The dictionary edges of the lattice: every word of the model at every place it can stand, with its log probability."""
    w = trained(s, d).where("kind = 'word'").select(F.col("key").alias("word"), "n")
    total = w.agg(F.sum("n").alias("total"))
    w = w.crossJoin(F.broadcast(total)).select("word", F.round(F.log(F.col("n") / F.col("total")), 6).alias("logp"))  # one row
    return dict_matches(reviewed(s, d), "row_id", "text", w).select("row_id", "start", (F.col("start") + F.length("word")).alias("end"), "word", "logp")


@query("seg_score_audit")
def seg_score_audit(s, d):
    """Per length of word: how often the decoder agrees with the accepted boundaries, and its mean score of them."""
    gold = gold_tokens(s, d).where(F.col("word").rlike(TR._HAN)).select("row_id", "i", "word")
    scored = gold.select("word").distinct().select("word", S.span_score_column(F.col("word"), _model(s, d)).alias("score"), S.cut_column(F.col("word"), _model(s, d)).alias("cut"))
    return gold.join(scored, "word").groupBy(F.length("word").alias("chars")).agg(F.count(F.lit(1)).alias("words"), F.count(F.when(F.size("cut") == 1, 1)).alias("whole"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("tokenize")
def tokenize(s, d):
    t = spread(reviewed(s, d)).select("row_id", F.posexplode(S.tokens_column(F.col("text"), _model(s, d))).alias("position", "k"))
    return t.select("row_id", "position", "k.word", "k.tag", "k.kind", "k.start", "k.end")


query("pos_viterbi")(lambda s, d: tokenize(s, d).where("kind = 'Word'").select("row_id", "position", "word", "tag"))
query("sig_model_proper")(lambda s, d: tokenize(s, d).groupBy("row_id").agg(F.count(F.when(F.col("tag").isin("nr", "ns", "nt", "Nb", "Nc"), 1)).alias("n")))


@query("pos_topology", f"SELECT tag, list_sort(list(DISTINCT state)) AS states, count(DISTINCT state) = 4 AS complete FROM {TR._STATES} GROUP BY tag")
def pos_topology(s, d):
    """The positions that each tag has been seen in; a tagger over joint states needs all four."""
    return TR._states(s, d).groupBy("tag").agg(F.array_sort(F.collect_set("state")).alias("states"), (F.countDistinct("state") == 4).alias("complete"))


@query("pos_tagmap", f"SELECT tag, (row_number() OVER (ORDER BY tag) - 1)::BIGINT AS id FROM (SELECT DISTINCT tag FROM {TR._STATES})")
def pos_tagmap(s, d):
    """Tags numbered by name. There are as many rows as tags: the window without a partition holds a few dozen."""
    return TR._states(s, d).select("tag").distinct().select("tag", (F.row_number().over(Window.orderBy("tag")) - 1).cast("long").alias("id"))


@query("annotate")
def annotate(s, d):
    """Tokens with the affect labels of the lexicon, joined on the normalised word."""
    a = table(s, d, "emotion_lexicon").where("emotions IS NOT NULL").groupBy(norm_text(F.col("word")).alias("norm")).agg(F.max_by("emotions", "entry_id").alias("emotions"))
    return tokenize(s, d).withColumn("norm", norm_text(F.col("word"))).join(a, "norm", "left").drop("norm")


_FINGERPRINT = "SELECT kind, sha256(string_agg(digest, chr(10) ORDER BY bucket)) AS digest FROM (SELECT kind, substr(md5(key), 1, 2) AS bucket, sha256(string_agg(key || '=' || n, chr(10) ORDER BY key || '=' || n)) AS digest FROM ({}) GROUP BY ALL) GROUP BY kind"


@query("fingerprint", _FINGERPRINT.format(_BUILD))
def fingerprint(s, d):
    """A digest of every table of the model: of its rows in order, by buckets of their keys, so that no table is one group."""
    rows = trained(s, d).groupBy("kind", F.substring(F.md5("key"), 1, 2).alias("bucket")).agg(F.array_sort(F.collect_list(F.concat("key", F.lit("="), F.col("n").cast("string")))).alias("x"))
    parts = rows.select("kind", "bucket", F.sha2(F.array_join("x", "\n"), 256).alias("digest")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("bucket", "digest"))).alias("x"))
    return parts.select("kind", F.sha2(F.array_join(F.transform("x", lambda r: r["digest"]), "\n"), 256).alias("digest"))


def _rules(texts):
    """The tagger of ``preannotate``: rules only, no model."""
    answers = [S.tokenize(None, t) for t in texts]
    return [([w for w, *_ in a], [t for _, t, *_ in a]) for a in answers]


@query("preannotate")
def preannotate(s, d):
    """Train and dev records without annotation, annotated: tokens and errors."""
    r = table(s, d, "reviewed").where("split IN ('train', 'dev') AND preannotation IS NULL")
    return A.preannotated(spread(r), "row_id", "text", _rules)


@query("annotate_silver")
def annotate_silver(s, d):
    """Words, tags and named spans of the documents by three annotators over the same batches: rules stand for models."""
    names = lambda texts: [[(a, b, k.upper(), t[a:b]) for a, b, k, _ in S.protected(t)] for t in texts]
    return A.silver(spread(table(s, d, "documents")), "doc_id", "text", lambda t: [w for w, _ in _rules(t)], lambda words: [["Na"] * len(w) for w in words], names)


# ---------------------------------------------------------------- keywords over the reviewed tokens
_OK = "(length(word) >= 2 AND (pos IN ('n', 'ns', 'nz', 'x') OR pos LIKE 'v%' OR pos IN ('nr', 'nt')))"


def _kw(s, d):
    return gold_tokens(s, d).select(F.col("row_id").alias("doc"), "i", "word", F.col("pos").alias("tag"))


def _allowed():
    return F.coalesce(F.col("tag").isin("n", "ns", "nz", "x") | F.col("tag").startswith("v"), F.lit(False)), F.coalesce(F.col("tag").isin("nr", "nt"), F.lit(False))


_CAND = f"(SELECT row_id AS doc, word, count(*)::BIGINT AS tf, min(i)::BIGINT AS first, bool_or(coalesce(pos IN ('nr', 'nt'), false)) AS proper FROM {GOLD} WHERE {_OK} GROUP BY ALL)"
_PAIRS = f"(SELECT a.row_id AS doc, a.word AS a, b.word AS b, count(*)::BIGINT AS n FROM {GOLD} a JOIN {GOLD} b ON a.row_id = b.row_id AND b.i BETWEEN a.i + 1 AND a.i + 4 WHERE {_OK.replace('word', 'a.word').replace('pos', 'a.pos')} AND {_OK.replace('word', 'b.word').replace('pos', 'b.pos')} GROUP BY ALL)"


@query("kw_candidates", f"SELECT * FROM {_CAND}")
def kw_candidates(s, d):
    return K.candidates(_kw(s, d), *_allowed())


@query("kw_cooc", f"SELECT * FROM {_PAIRS}")
def kw_cooc(s, d):
    return K.cooccurrence(_kw(s, d), *_allowed())


@query("kw_adj", f"SELECT doc, a, b, n, (sum(n) OVER (PARTITION BY doc, a))::BIGINT AS out FROM (SELECT doc, a, b, sum(n)::BIGINT AS n FROM (SELECT doc, a, b, n FROM {_PAIRS} UNION ALL SELECT doc, b, a, n FROM {_PAIRS}) GROUP BY ALL)")
def kw_adj(s, d):
    return K.adjacency(kw_cooc(s, d))


@query("kw_minmax", f"SELECT doc, word, round((tf - lo / 10) / (hi - lo / 10), 6) AS base FROM (SELECT doc, word, tf::DOUBLE AS tf, min(tf::DOUBLE) OVER (PARTITION BY doc) AS lo, max(tf::DOUBLE) OVER (PARTITION BY doc) AS hi FROM {_CAND})")
def kw_minmax(s, d):
    """The scaling, applied to term frequencies."""
    c = kw_candidates(s, d).withColumn("weight", F.col("tf").cast("double"))
    return K.minmax(c).select("doc", "word", F.round("base", 6).alias("base"))


_ENTITY = f"(SELECT c.*, CASE WHEN proper THEN 0.7 * ln(1 + tf) / ln(1 + max(CASE WHEN proper THEN tf END) OVER (PARTITION BY c.doc)) + 0.3 * (1 - CASE WHEN t > 1 THEN first / (t - 1) ELSE 0.0 END) ELSE 0.0 END AS entity FROM {_CAND} c JOIN (SELECT row_id AS doc, count(*) AS t FROM {GOLD} GROUP BY ALL) USING (doc))"


@query("kw_proper", f"SELECT doc, word, round(entity, 6) AS entity FROM {_ENTITY}")
def kw_proper(s, d):
    return K.proper_scores(kw_candidates(s, d), _kw(s, d)).select("doc", "word", F.round("entity", 6).alias("entity"))


@query("kw_topk_cap", f"WITH s AS (SELECT doc, word, proper, tf AS score, proper AND row_number() OVER (PARTITION BY doc, proper ORDER BY tf DESC, word) > 2 AS late FROM {_CAND}), p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY late, score DESC, word) AS pick FROM s) SELECT doc, word, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, word)::BIGINT AS rank FROM p WHERE pick <= 5")
def kw_topk_cap(s, d):
    """The five best by frequency, two proper nouns at most unless the others run out."""
    return K.capped_top(kw_candidates(s, d).withColumn("score", F.col("tf")), 5).select("doc", "word", "score", "rank")


@query("keywords")
def keywords(s, d):
    return K.keywords(_kw(s, d), *_allowed())


query("kw_textrank")(lambda s, d: K.textrank(kw_candidates(s, d), kw_adj(s, d)).select("doc", "word", F.round("weight", 6).alias("weight")))


@query("keyphrases")
def keyphrases(s, d):
    return K.keyphrases(_kw(s, d), K.keywords(_kw(s, d), *_allowed(), k=20))


query("kp_runs")(lambda s, d: K.keyword_runs(_kw(s, d), K.keywords(_kw(s, d), *_allowed(), k=20)).select("doc", "phrase", "terms", F.round("mean", 6).alias("mean")))
