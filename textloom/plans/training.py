"""Queries of model training, retokenisation evidence and dictionaries, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.operators import retokenize as RT
from textloom.operators import training as R
from textloom.plans.common import GOLD, SILVER, gold_tokens, q, silver_tokens, table
from textloom.plans import registry
from textloom.plans.lexicons import entity_validate
from textloom.plans.registry import query

_HAN = rf"^[{spec.HAN_TRAIN}]+\z"
_SEQ = f"(SELECT row_id, i, word, pos AS tag, sum((NOT coalesce(pos IS NOT NULL AND regexp_matches(word, '{_HAN}'), false))::INT) OVER (PARTITION BY row_id ORDER BY i) AS seq, coalesce(pos IS NOT NULL AND regexp_matches(word, '{_HAN}'), false) AS ok FROM {GOLD})"
_STATES = f"""(SELECT *, lag(state, 1) OVER w AS s1, lag(state, 2) OVER w AS s2, lag(state || '-' || tag, 1) OVER w AS j1, lag(state || '-' || tag, 2) OVER w AS j2, state || '-' || tag AS joint FROM (
SELECT row_id, seq, i, tag, n, substr(word, n::INT, 1) AS ch, CASE WHEN length(word) = 1 THEN 'S' WHEN n = 1 THEN 'B' WHEN n = length(word) THEN 'E' ELSE 'M' END AS state FROM (SELECT *, unnest(range(1, length(word) + 1)) AS n FROM {_SEQ} WHERE ok)) WINDOW w AS (PARTITION BY row_id, seq ORDER BY i, n))"""


def _tokens(s, d):
    return gold_tokens(s, d).withColumnRenamed("pos", "tag")


def _sequences(s, d):
    return R.sequences(_tokens(s, d), ["row_id"], F.col("tag").isNotNull() & F.col("word").rlike(_HAN))


def _states(s, d):
    return R.states(_sequences(s, d), ["row_id"])


@query("tr_sequences", f"SELECT row_id, seq::BIGINT AS seq, count(*)::BIGINT AS words, sum(length(word))::BIGINT AS chars FROM {_SEQ} WHERE ok GROUP BY ALL")
def tr_sequences(s, d):
    return _sequences(s, d).groupBy("row_id", "seq").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("chars"))


def _counter(name: str, *columns: str):
    query(name, f"SELECT {', '.join(columns)}, count(*)::BIGINT AS n FROM {_STATES} WHERE {' AND '.join(c + ' IS NOT NULL' for c in columns)} GROUP BY ALL")(lambda s, d: R.counts(_states(s, d), *columns))


query("tr_start", f"SELECT state, count(*)::BIGINT AS n FROM {_STATES} WHERE s1 IS NULL GROUP BY ALL")(lambda s, d: R.starts(_states(s, d)))
query("tr_pos_start", f"SELECT joint, count(*)::BIGINT AS n FROM {_STATES} WHERE j1 IS NULL GROUP BY ALL")(lambda s, d: R.starts(_states(s, d), "joint", "j1"))
for _name, _columns in {
    "tr_trans1": ("s1", "state"), "tr_trans2": ("s2", "s1", "state"), "tr_emit1": ("state", "ch"), "tr_emit2": ("s1", "state", "ch"),
    "tr_pos_trans1": ("j1", "joint"), "tr_pos_trans2": ("j2", "j1", "joint"), "tr_pos_emit": ("joint", "ch"),
}.items():
    _counter(_name, *_columns)


@query("tr_reverse", f"SELECT ch, list_sort(list(DISTINCT joint)) AS states FROM {_STATES} GROUP BY ch")
def tr_reverse(s, d):
    return _states(s, d).groupBy("ch").agg(F.array_sort(F.collect_set("joint")).alias("states"))


@query("tr_reverse_probs", f"SELECT ch, state, round((n + 0.1) / (sum(n) OVER (PARTITION BY ch) + 0.4), 6) AS p FROM (SELECT ch, state, count(*) AS n FROM {_STATES} GROUP BY ALL)")
def tr_reverse_probs(s, d):
    """P(state | ch), smoothed over the four states; seen pairs."""
    c = R.counts(_states(s, d), "ch", "state")
    return c.select("ch", "state", F.round((F.col("n") + 0.1) / (F.sum("n").over(Window.partitionBy("ch")) + 0.4), 6).alias("p"))


_LEGAL = "(VALUES ('B','M'),('B','E'),('M','M'),('M','E'),('E','B'),('E','S'),('S','B'),('S','S')) l(s1, state)"


@query("tr_smooth_row", f"SELECT s1, state, n, round(ln((n + 0.1) / (sum(n) OVER (PARTITION BY s1) + 0.2)), 6) AS logp FROM (SELECT l.s1, l.state, coalesce(c.n, 0)::BIGINT AS n FROM {_LEGAL} LEFT JOIN (SELECT s1, state, count(*) AS n FROM {_STATES} WHERE s1 IS NOT NULL GROUP BY ALL) c USING (s1, state))")
def tr_smooth_row(s, d):
    return R.smooth_transitions(R.counts(_states(s, d), "s1", "state"))


@query("tr_smooth_emit", f"WITH e AS (SELECT state, ch, count(*)::BIGINT AS n FROM {_STATES} GROUP BY ALL), t AS (SELECT state, sum(n) AS total FROM e GROUP BY state), v AS (SELECT count(DISTINCT ch) AS v FROM e) SELECT state, ch, n, round(ln((n + 0.1) / (total + 0.1 * (v + 1))), 6) AS logp FROM (SELECT * FROM e UNION ALL SELECT state, '<UNK>', 0 FROM t) JOIN t USING (state), v")
def tr_smooth_emit(s, d):
    return R.smooth_emissions(R.counts(_states(s, d), "state", "ch"))


@query("tr_joint_legal", f"WITH t AS (SELECT DISTINCT state AS st, tag FROM {_STATES}) SELECT a.st || '-' || a.tag AS \"before\", b.st || '-' || b.tag AS \"after\" FROM t a JOIN t b ON CASE WHEN a.st IN ('B', 'M') THEN b.st IN ('M', 'E') AND a.tag = b.tag ELSE b.st IN ('B', 'S') END")
def tr_joint_legal(s, d):
    """Pairs of joint states that may follow each other: inside a word by tag, between words by state."""
    t = _states(s, d).select(F.col("state").alias("st"), "tag").distinct()
    a, b = t.select(F.col("st").alias("sa"), F.col("tag").alias("ta")), t.select(F.col("st").alias("sb"), F.col("tag").alias("tb"))
    inside = a.where("sa IN ('B', 'M')").join(b.where("sb IN ('M', 'E')"), F.col("ta") == F.col("tb"))
    legal = s.createDataFrame([(x, y) for x in "ES" for y in "BS"], "sa string, sb string")
    between = a.join(legal, "sa").join(b, "sb")
    joint = lambda x: F.concat_ws("-", f"s{x}", f"t{x}")
    return inside.select(joint("a").alias("before"), joint("b").alias("after")).unionByName(between.select(joint("a").alias("before"), joint("b").alias("after")))


_WORD_POS = f"(SELECT word, tag AS pos, count(*)::BIGINT AS n FROM {SILVER} WHERE tag IS NOT NULL AND regexp_matches(word, '{_HAN}') GROUP BY ALL)"
_NAMED = ",".join(q(x) for x in spec.NAMED_ENTITIES)
_WORD_ENTITY = f"(SELECT e.text AS word, e.label AS label, count(*)::BIGINT AS n FROM (SELECT unnest(entities) AS e FROM annotation) WHERE e.label IN ({_NAMED}) AND regexp_matches(e.text, '{_HAN}') GROUP BY ALL)"


def _word_pos(s, d):
    return silver_tokens(s, d).where(F.col("tag").isNotNull() & F.col("word").rlike(_HAN)).groupBy("word", F.col("tag").alias("pos")).agg(F.count(F.lit(1)).alias("n"))


def _word_entity(s, d):
    e = table(s, d, "annotation").select(F.explode("entities").alias("e")).select(F.col("e.text").alias("word"), "e.label")
    return e.where(F.col("label").isin(*spec.NAMED_ENTITIES) & F.col("word").rlike(_HAN)).groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"))


query("tr_word_pos", f"SELECT * FROM {_WORD_POS}")(_word_pos)
query("tr_word_entity", f"SELECT * FROM {_WORD_ENTITY}")(_word_entity)


@query("tr_grouped", f"SELECT word, list(pos || '=' || n ORDER BY pos) AS counts FROM {_WORD_POS} GROUP BY word")
def tr_grouped(s, d):
    g = R.grouped(_word_pos(s, d), "word", "pos")
    return g.select("word", F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))).alias("counts"))


@query("tr_merge", f"SELECT word, coalesce(p.n, 0)::BIGINT AS tagged, coalesce(e.n, 0)::BIGINT AS entities FROM (SELECT word, sum(n)::BIGINT AS n FROM {_WORD_POS} GROUP BY word) p FULL JOIN (SELECT word, sum(n)::BIGINT AS n FROM {_WORD_ENTITY} GROUP BY word) e USING (word)")
def tr_merge(s, d):
    p, e = _word_pos(s, d).groupBy("word").agg(F.sum("n").alias("tagged")), _word_entity(s, d).groupBy("word").agg(F.sum("n").alias("entities"))
    return p.join(e, "word", "full_outer").fillna(0)


_DEFAULT = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in spec.ENTITY_TAG.items()) + " ELSE 'Na' END"
_EVIDENCE = f"""WITH wp AS (SELECT * FROM {_WORD_POS}), we AS (SELECT * FROM {_WORD_ENTITY}),
p AS (SELECT word, pos, n FROM wp UNION ALL SELECT word, {_DEFAULT} AS pos, sum(n) FROM we ANTI JOIN wp USING (word) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, pos) AS r FROM p),
a AS (SELECT word, sum(n)::BIGINT AS support, max(CASE WHEN r = 1 THEN pos END) AS primary_pos, max(CASE WHEN r = 1 THEN n END) AS n1, coalesce(max(CASE WHEN r = 2 THEN n END), 0) AS n2 FROM r GROUP BY word),
e AS (SELECT word, sum(n)::BIGINT AS es, max(n) AS e1 FROM we GROUP BY word),
ev AS (SELECT word, support, primary_pos, round(n1 / support, 6) AS confidence, round((n1 - n2) / support, 6) AS margin, coalesce(es, 0)::BIGINT AS entity_support, coalesce(round(e1 / es, 6), 0.0) AS entity_confidence FROM a LEFT JOIN e USING (word))
"""


@query("tr_dict_evidence", _EVIDENCE + "SELECT * FROM ev")
def tr_dict_evidence(s, d):
    return R.evidence(_word_pos(s, d), _word_entity(s, d))


@query("tr_dict_reason", _EVIDENCE + """SELECT word, CASE WHEN support < 10 THEN 'insufficient-support' WHEN confidence >= 0.8 AND margin >= 0.2 THEN 'accepted-general' WHEN entity_support >= 2 AND entity_confidence >= 0.8 AND confidence >= 0.8 THEN 'accepted-entity'
WHEN confidence < 0.8 THEN 'ambiguous-pos' WHEN margin < 0.2 AND entity_support < 2 THEN 'small-pos-margin' ELSE 'ambiguous-entity' END AS reason FROM ev""")
def tr_dict_reason(s, d):
    return tr_dict_evidence(s, d).select("word", R.dictionary_reason().alias("reason"))


@query("dict_entries", _EVIDENCE + "SELECT (SELECT count(*) FROM ev)::BIGINT AS evidence, (SELECT count(*) FROM ev WHERE support >= 10 AND confidence >= 0.8 AND (margin >= 0.2 OR entity_support >= 2 AND entity_confidence >= 0.8) AND length(word) >= 2)::BIGINT AS entries")
def dict_entries(s, d):
    e = tr_dict_evidence(s, d).withColumn("reason", R.dictionary_reason())
    return e.agg(F.count(F.lit(1)).alias("evidence"), F.count(F.when(F.col("reason").startswith("accepted") & (F.length("word") >= 2), 1)).alias("entries"))


@query("poslex_logp", f"SELECT word, pos, round(ln(n / sum(n) OVER (PARTITION BY word)), 6) AS logp FROM {_WORD_POS}")
def poslex_logp(s, d):
    return _word_pos(s, d).select("word", "pos", F.round(F.log(F.col("n") / F.sum("n").over(Window.partitionBy("word"))), 6).alias("logp"))


# A dictionary is made of all tagged words here; frequencies below 10, the tag of found words and measures with their noun are left out.
_CROSSING = f"^[{spec.CROSSING_NUMERALS}]*({'|'.join(spec.MEASURE_CROSSING)})\\z"


@query("dict_filter", f"SELECT word, freq, tag FROM (SELECT word, sum(n)::BIGINT AS freq, arg_min(pos, (-n, pos)) AS tag FROM {_WORD_POS} GROUP BY word) WHERE length(word) BETWEEN 2 AND 255 AND freq >= 10 AND tag <> 'unknownnew' AND NOT regexp_matches(word, '{_CROSSING}')")
def dict_filter(s, d):
    w = _word_pos(s, d).groupBy("word").agg(F.sum("n").alias("freq"), F.min_by("pos", F.struct((-F.col("n")).alias("m"), "pos")).alias("tag"))
    return w.where(F.length("word").between(2, 255) & (F.col("freq") >= 10) & (F.col("tag") != "unknownnew") & ~F.col("word").rlike(_CROSSING))


_LOGP = f"(SELECT word, freq, ln(freq) - ln(sum(freq) OVER ()) AS logp FROM (SELECT word, sum(n) AS freq FROM {_WORD_POS} WHERE length(word) >= 2 GROUP BY word))"


def _logp(s, d):
    freq = _word_pos(s, d).where(F.length("word") >= 2).groupBy("word").agg(F.sum("n").alias("freq"))
    total = freq.agg(F.sum("freq").alias("total"))
    return freq.crossJoin(F.broadcast(total)).withColumn("logp", F.log("freq") - F.log("total"))  # one row


@query("dict_logp", f"SELECT word, round(logp, 6) AS logp FROM {_LOGP}")
def dict_logp(s, d):
    return _logp(s, d).select("word", F.round("logp", 6).alias("logp"))


@query("cv_quant", f"WITH l AS (SELECT * FROM {_LOGP}), m AS (SELECT max(abs(logp)) / 32767 AS scale FROM l) SELECT word, round(logp / scale)::INT AS code, round(round(logp / scale) * scale, 4) AS decoded FROM l, m")
def cv_quant(s, d):
    return R.quantise(_logp(s, d), "logp").select("word", "code", F.round("decoded", 4).alias("decoded"))


@query("cv_validate", f"WITH e AS (SELECT state, ch, count(*) AS n FROM {_STATES} GROUP BY ALL) SELECT state, round(sum(p), 4) AS mass, abs(sum(p) - 1) < 2e-4 AS valid FROM (SELECT state, n / sum(n) OVER (PARTITION BY state) AS p FROM e) GROUP BY state")
def cv_validate(s, d):
    """Rows of log probabilities must sum to one, the impossible left out."""
    e = R.counts(_states(s, d), "state", "ch")
    logp = F.log(F.col("n") / F.sum("n").over(Window.partitionBy("state")))
    mass = F.sum(F.exp("logp"))
    return e.withColumn("logp", logp).where("logp > -1e29").groupBy("state").agg(F.round(mass, 4).alias("mass"), (F.abs(mass - 1) < 2e-4).alias("valid"))


_ODD = "CASE event_id % 7 WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN -1e35 WHEN 4 THEN -1e29 WHEN 5 THEN '-Infinity'::DOUBLE ELSE -value END"


@query("cv_clamp", f"SELECT event_id, (CASE WHEN x IS NULL OR isnan(x) OR isinf(x) OR x < -1e29 THEN -1e30 ELSE x END)::FLOAT::DOUBLE AS x FROM (SELECT event_id, {_ODD} AS x FROM events)")
def cv_clamp(s, d):
    """Values that are not finite or below -1e29 become the sentinel, as floats; the table's values and some odd ones."""
    odd = F.expr("CASE event_id % 7 WHEN 1 THEN double('NaN') WHEN 2 THEN double('Infinity') WHEN 3 THEN -1e35D WHEN 4 THEN -1e29D WHEN 5 THEN double('-Infinity') ELSE -value END")
    return table(s, d, "events").select("event_id", R.clamp_log(odd).cast("double").alias("x"))


_PAIR = "(VALUES ('B','M'),('B','E'),('M','M'),('M','E'),('E','B'),('E','S'),('S','B'),('S','S'))"


@query("cv_bmes", f"WITH st(x) AS (VALUES ('B'),('M'),('E'),('S')), c AS (SELECT s2, s1, state, count(*) AS n FROM {_STATES} WHERE s2 IS NOT NULL GROUP BY ALL), f AS (SELECT a.x AS s2, b.x AS s1, k.x AS state, coalesce(n, 0) AS n, (a.x, b.x) IN (SELECT (col0, col1) FROM {_PAIR}) AND (b.x, k.x) IN (SELECT (col0, col1) FROM {_PAIR}) AS legal FROM st a, st b, st k LEFT JOIN c ON c.s2 = a.x AND c.s1 = b.x AND c.state = k.x) SELECT s2, s1, state, (CASE WHEN legal THEN round(ln((n + 0.1) / (sum(n) OVER (PARTITION BY s2, s1) + 0.2)), 5) ELSE -1e30 END)::FLOAT::DOUBLE AS logp FROM f")
def cv_bmes(s, d):
    """The dense second-order table of the segmentation model."""
    return R.dense_transitions(R.counts(_states(s, d), "s2", "s1", "state")).withColumn("logp", F.col("logp").cast("double"))


@query("cv_pos", f"WITH e AS (SELECT joint, ch, count(*) AS n FROM {_STATES} GROUP BY ALL), t AS (SELECT joint, sum(n) AS total FROM e GROUP BY joint), v AS (SELECT count(DISTINCT ch) AS v FROM e) SELECT ch, list(joint ORDER BY joint) AS states, list(round(ln((n + 0.1) / (total + 0.1 * (v + 1))), 4) ORDER BY joint) AS logps FROM e JOIN t USING (joint), v GROUP BY ch")
def cv_pos(s, d):
    """The sparse emissions of the tagging model, a row for each character."""
    return R.emission_rows(R.counts(_states(s, d), "joint", "ch"), "joint")


@query("cv_report", f"SELECT length(word)::BIGINT AS chars, count(*)::BIGINT AS words, sum(freq)::BIGINT AS freq FROM {_LOGP} GROUP BY ALL")
def cv_report(s, d):
    return _logp(s, d).groupBy(F.length("word").cast("long").alias("chars")).agg(F.count(F.lit(1)).alias("words"), F.sum("freq").alias("freq"))


@query("dict_merge_norm", f"SELECT norm, max(n)::BIGINT AS freq, coalesce((list(pos ORDER BY n DESC, pos) FILTER (WHERE pos <> 'unknown'))[1], 'unknown') AS tag FROM (SELECT translate(word, '{spec.NORM_FROM}', '{spec.NORM_TO}') AS norm, pos, n FROM {_WORD_POS}) GROUP BY norm")
def dict_merge_norm(s, d):
    w = _word_pos(s, d).withColumn("norm", F.translate("word", spec.NORM_FROM, spec.NORM_TO))
    known = F.min_by("pos", F.when(F.col("pos") != "unknown", F.struct((-F.col("n")).alias("m"), "pos")))
    return w.groupBy("norm").agg(F.max("n").alias("freq"), F.coalesce(known, F.lit("unknown")).alias("tag"))


# ---------------------------------------------------------------- retokenisation evidence
_SPANT = f"(SELECT source, source_index, rid, i, word, tag, (sum(length(word)) OVER w - length(word))::BIGINT AS a, (sum(length(word)) OVER w)::BIGINT AS b FROM (SELECT source, source_index, rid, i, k.text AS word, k.ckip_pos AS tag FROM (SELECT source, source_index, rid, unnest(tokens) AS k, generate_subscripts(tokens, 1) - 1 AS i FROM (SELECT *, md5(to_json(tokens)::VARCHAR || source || source_index || loaded_at::VARCHAR) AS rid FROM annotation)) WHERE k.text <> '') WINDOW w AS (PARTITION BY source, source_index, rid ORDER BY i))"


@query("rt_suffix_pairs", f"SELECT word || nw AS surface, count(*)::BIGINT AS n FROM (SELECT word, lead(word) OVER (PARTITION BY source, source_index ORDER BY i) AS nw, lead(tag) OVER (PARTITION BY source, source_index ORDER BY i) AS nt FROM (SELECT source, source_index, i, any_value(word) AS word, any_value(tag) AS tag FROM {SILVER} GROUP BY ALL HAVING count(DISTINCT word) = 1)) WHERE nw IN ('師','員','家','者','手') AND starts_with(nt, 'N') AND regexp_matches(word, '{_HAN}') GROUP BY ALL")
def rt_suffix_pairs(s, d):
    """Tokens with the noun suffix behind them. The records of one key come together as arrays, a position counts where they agree on
    its word; tokens are never rows."""
    r = table(s, d, "annotation").where("tokens IS NOT NULL").select("source", "source_index", F.struct(F.col("tokens.text").alias("w"), F.col("tokens.ckip_pos").alias("g")).alias("r"))
    r = r.groupBy("source", "source_index").agg(F.array_sort(F.collect_set("r")).alias("r"))
    one = "filter(transform(r[0].w, (w, i) -> struct(w AS w, r[0].g[i] AS g)), x -> x.w <> '')"
    at = "filter(transform(r, o -> struct(get(o.w, i) AS w, get(o.g, i) AS g)), x -> x.w <> '')"
    words = f"transform(sequence(0, array_max(transform(r, o -> size(o.w)))), i -> {at})"
    several = f"transform(filter({words}, o -> size(array_distinct(o.w)) = 1), o -> struct(o[0].w AS w, get(filter(o.g, g -> g IS NOT NULL), 0) AS g))"
    kept = r.select(F.expr(f"CASE WHEN size(r) = 1 THEN {one} ELSE {several} END").alias("k"))
    suffixes = ", ".join(q(x) for x in spec.NOUN_SUFFIXES)
    pairs = F.expr(f"filter(transform(k, (x, i) -> CASE WHEN i > 0 AND x.w IN ({suffixes}) AND startswith(x.g, 'N') THEN struct(k[i - 1].w AS w, x.w AS nw) END), x -> x IS NOT NULL)")
    p = kept.select(F.explode(pairs).alias("p")).where(F.col("p.w").rlike(_HAN))
    return p.groupBy(F.concat("p.w", "p.nw").alias("surface")).agg(F.count(F.lit(1)).alias("n"))


@query("rt_suffix_policy", f"SELECT surface, n AS support FROM ({registry.ORACLES['rt_suffix_pairs']}) WHERE n >= 2")
def rt_suffix_policy(s, d):
    """Words with a noun suffix that are approved: pairs seen at least twice."""
    return rt_suffix_pairs(s, d).where("n >= 2").select("surface", F.col("n").alias("support"))


@query("rt_policy", f"SELECT word AS surface, label, n AS support, total::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, label) AS r, sum(n) OVER (PARTITION BY word) AS total FROM {_WORD_ENTITY}) WHERE r = 1 AND n >= 2 AND n / total >= 0.8")
def rt_policy(s, d):
    """Entities that are approved: enough support for the first label, and enough of its share."""
    e = _word_entity(s, d).withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "label"))).withColumn("total", F.sum("n").over(Window.partitionBy("word")))
    return e.where("r = 1 AND n >= 2 AND n / total >= 0.8").select(F.col("word").alias("surface"), "label", F.col("n").alias("support"), "total")


_SUFFIX_SQL = registry.ORACLES["rt_suffix_pairs"]


@query("rt_evidence", f"SELECT 'entity' AS kind, word AS surface, label, n FROM {_WORD_ENTITY} UNION ALL SELECT 'word', word, '', sum(n)::BIGINT FROM {_WORD_POS} GROUP BY word UNION ALL SELECT 'suffix', surface, '', n FROM ({_SUFFIX_SQL}) UNION ALL SELECT 'invalid', reason, '', count(*)::BIGINT FROM ({registry.ORACLES['entity_validate']}) WHERE reason <> 'valid' GROUP BY reason")
def rt_evidence(s, d):
    """Counts of entities by label, of words, of words with a noun suffix, and of invalid entities by reason."""
    e = _word_entity(s, d).select(F.lit("entity").alias("kind"), F.col("word").alias("surface"), "label", "n")
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), "surface", F.lit("").alias("label"), "n")
    words = _word_pos(s, d).groupBy(F.col("word").alias("surface")).agg(F.sum("n").alias("n"))
    invalid = entity_validate(s, d).where("reason <> 'valid'").groupBy(F.col("reason").alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    return e.unionByName(one("word", words)).unionByName(one("suffix", rt_suffix_pairs(s, d))).unionByName(one("invalid", invalid))


@query("rt_load_evidence", f"SELECT word, sum(n)::BIGINT AS n FROM {_WORD_POS} WHERE substr(word, -1) IN ('師','員','家','者','手') GROUP BY word")
def rt_load_evidence(s, d):
    return _word_pos(s, d).where(F.substring("word", -1, 1).isin(*spec.NOUN_SUFFIXES)).groupBy("word").agg(F.sum("n").alias("n"))


def _rt_records(s, d):
    """Annotation records as (rid, text, entities, w, g), w and g being the words of their tokens and the tags; one that was delivered twice is there twice."""
    a = table(s, d, "annotation").where("text IS NOT NULL AND tokens IS NOT NULL")
    k = F.filter("tokens", lambda k: k["text"] != "")
    return a.select(F.sha2(F.to_json(F.struct("source", "source_index", "text", "tokens")), 256).alias("rid"), "text", "entities", k["text"].alias("w"), k["ckip_pos"].alias("g"))


def _rt_selected(s, d):
    """The records, and of the entities whose text is that of the record and whose ends are ends of tokens those that become one token."""
    records = _rt_records(s, d)
    may = F.col("e.label").isin(*spec.NAMED_ENTITIES, *spec.QUANTITY_ENTITIES) & (F.col("e.end") > F.col("e.start")) & (F.expr("substring(text, int(e.start + 1), int(e.`end` - e.start))") == F.col("e.text"))
    e = records.select("rid", "text", "entities", RT.token_ends(F.col("w")).alias("ends"))  # before the entities become rows
    e = e.select("rid", "text", "ends", F.explode("entities").alias("e")).where(may)
    e = e.select("rid", F.col("e.start").cast("long").alias("s"), F.col("e.end").cast("long").alias("t"), (F.expr("array_position(ends, e.start)") - 1).alias("first"), (F.expr("array_position(ends, e.`end`)") - 2).alias("last"), F.col("e.label").alias("label"), F.col("e.text").alias("surface"))
    spans = e.where("first >= 0 AND last >= 0").where((F.col("last") > F.col("first")) | F.col("label").isin(*spec.QUANTITY_ENTITIES))
    return records, RT.selected_spans(RT.span_candidates(spans, rt_policy(s, d), lambda c: c.rlike(spec.QTY_SURFACE)))


@query("ivl_entity_select")
def ivl_entity_select(s, d):
    """The entities of every record that become one token."""
    return _rt_selected(s, d)[1].select("rid", F.col("s").alias("char_start"), F.col("t").alias("char_end"), "label", "surface", "reason")


@query("rt_canonical")
def rt_canonical(s, d):
    """The canonical tokens of every annotation record by the approved entities and suffix words."""
    records, selected = _rt_selected(s, d)
    return RT.canonical_records(records.select("rid", "w", "g"), selected, rt_suffix_policy(s, d).select("surface")).withColumnRenamed("s", "char_start").withColumnRenamed("t", "char_end")


@query("tr_canonical_pos")
def tr_canonical_pos(s, d):
    """Words by tag over the canonical tokens that may be dictionary words; quantities count as their canonical form."""
    t = rt_canonical(s, d).select(F.coalesce("canonical", "word").alias("word"), F.col("tag").alias("pos"), "eligible").where("pos IS NOT NULL")
    return t.groupBy("word", "pos", "eligible").agg(F.count(F.lit(1)).alias("n"))
