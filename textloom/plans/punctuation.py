"""Queries of punctuation data, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.operators import punctuation as P
from textloom.plans.common import documents, q, reviewed, table
from textloom.plans.registry import query
from textloom.session import spread

_MARKS = "CASE ch " + " ".join(f"WHEN {q(c)} THEN {v}" for c, v in spec.PUNCTUATION.items()) + " ELSE 0 END"
_CHARS = "(SELECT row_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM reviewed)"


def _labels(s, d):
    ch = reviewed(s, d).select("row_id", F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("ch"))
    return ch.select("row_id", F.coalesce(F.create_map(*[F.lit(x) for kv in spec.PUNCTUATION.items() for x in kv])[F.col("ch")], F.lit(0)).alias("label"))


@query("pu_labels", f"SELECT label, count(*)::BIGINT AS n FROM (SELECT {_MARKS} AS label FROM {_CHARS}) GROUP BY label")
def pu_labels(s, d):
    return _labels(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("pu_vocab", "SELECT ch, n, row_number() OVER (ORDER BY n DESC, ch)::BIGINT + 2 AS rank FROM (SELECT ch, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY ch ORDER BY n DESC, ch LIMIT 1021)")
def pu_vocab(s, d):
    return P.vocabulary(documents(s, d), "text", 1024)


@query("pu_weights", f"WITH c AS (SELECT label, count(*)::BIGINT AS n FROM (SELECT {_MARKS} AS label FROM {_CHARS}) GROUP BY label), r AS (SELECT label, n, least(8.0, sqrt(sum(n) OVER () / (count(*) OVER () * n))) AS raw FROM c) SELECT label, n, round(raw / avg(raw) OVER (), 6) AS weight FROM r")
def pu_weights(s, d):
    return P.balanced_weights(pu_labels(s, d))


@query("pu_class_metrics", f"WITH x AS (SELECT {_MARKS} AS g, lag({_MARKS}) OVER (PARTITION BY row_id ORDER BY i) AS p FROM (SELECT row_id, unnest(l) AS ch, generate_subscripts(l, 1) AS i FROM (SELECT row_id, regexp_extract_all(text, '(?s).') AS l FROM reviewed))), y AS (SELECT g, p FROM x WHERE p IS NOT NULL) SELECT label, coalesce(gold, 0)::BIGINT AS support, round(coalesce(correct / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(correct / nullif(gold, 0), 0), 6) AS recall, round(coalesce(2 * correct / (predicted + gold), 0), 6) AS f1 FROM (SELECT g AS label, count(*) AS gold, sum((g = p)::INT) AS correct FROM y GROUP BY g) FULL JOIN (SELECT p AS label, count(*) AS predicted FROM y GROUP BY p) USING (label)")
def pu_class_metrics(s, d):
    """Precision, recall and F1; as a prediction stands the label of the character before."""
    marks = F.create_map(*[F.lit(x) for kv in spec.PUNCTUATION.items() for x in kv])
    labels = F.transform(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(marks[c], F.lit(0)))
    t = reviewed(s, d).select(labels.alias("l"))
    pairs = t.select(F.explode(F.arrays_zip(F.slice("l", 2, 1_000_000_000).alias("g"), F.col("l").alias("p"))).alias("x")).select("x.g", "x.p").where("g IS NOT NULL")
    return P.class_metrics(pairs)


def _examples(s, d):
    return P.labelled(spread(reviewed(s, d)), "row_id", "text")


query("pu_extract")(_examples)


@query("pu_prepare")
def pu_prepare(s, d):
    """Outcomes of the extraction: rows and units by error."""
    r = _examples(s, d)
    return r.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.greatest(F.size("units"), F.lit(0))).alias("units"))


@query("pu_bmes_feats")
def pu_bmes_feats(s, d):
    """Position in the token and its length for every unit, from the reviewed tokens."""
    r = _examples(s, d).where("error IS NULL").select("row_id", "units")
    t = table(s, d, "reviewed").select("row_id", F.col("review.tokens.text").alias("tokens"))
    return P.token_features(r.join(t, "row_id"), "row_id", "units", "tokens")


@query("pu_encode")
def pu_encode(s, d):
    return P.encoded(_examples(s, d).where("error IS NULL"), "row_id", P.vocabulary(reviewed(s, d), "text", 4096), 1024)


query("pu_augment")(lambda s, d: P.augmented(_examples(s, d), "row_id"))


@query("pu_render")
def pu_render(s, d):
    """Extracted labels put back as text."""
    return _examples(s, d).where("error IS NULL").select("row_id", P.rendered("units", "punctuation", "quotes").alias("text"))


def _split(s, d, *splits):
    r = table(s, d, "reviewed").where(F.col("split").isin(*splits)).select("row_id", "text")
    return P.boundaries(P.labelled(spread(r), "row_id", "text"), "row_id")


query("pu_model")(lambda s, d: P.boundary_counts(_split(s, d, "train"), ["left", "right"]))


@query("pu_decode")
def pu_decode(s, d):
    """Marks and quotes of the dev and test texts, restored by a model of the train texts."""
    return P.restored(P.scored(_split(s, d, "dev", "test"), _split(s, d, "train")), "row_id")


def _decoded(s, d):
    x = F.arrays_zip(F.col("gold_marks").alias("gm"), F.col("gold_quotes").alias("gq"), F.col("marks").alias("pm"), F.col("quotes").alias("pq"))
    return pu_decode(s, d).select(F.col("row_id").alias("key"), F.explode(x).alias("x")).select("key", "x.*")


@query("pu_metrics")
def pu_metrics(s, d):
    """Precision, recall and F1 of every mark and quote on the dev and test texts."""
    r = _decoded(s, d)
    parts = [P.class_metrics(r.select(F.col(f"g{k}").alias("g"), F.col(f"p{k}").alias("p"))).select(F.lit(name).alias("kind"), "*") for k, name in (("m", "mark"), ("q", "quote"))]
    return parts[0].unionByName(parts[1])


query("pu_report")(lambda s, d: P.boundary_metrics(_decoded(s, d)))


@query("pu_greedy_unclosed", f"SELECT row_id, NOT regexp_matches(regexp_replace(text, '[^{spec.OPEN_QUOTES}{spec.CLOSE_QUOTES}]+', '', 'g'), '^([{spec.OPEN_QUOTES}][{spec.CLOSE_QUOTES}])*\\z') AS unclosed FROM reviewed")
def pu_greedy_unclosed(s, d):
    return reviewed(s, d).select("row_id", P.unclosed(F.col("text")).alias("unclosed"))


query("rx_protect_punct")(lambda s, d: documents(s, d).select("doc_id", P.protected_count(F.col("text")).alias("protected_chars")))


@query("char_type", "SELECT ch, CASE WHEN regexp_matches(ch, '[㐀-鿿豈-\\x{FAFF}]') THEN 2 WHEN ch BETWEEN 'a' AND 'z' THEN 3 WHEN ch BETWEEN 'A' AND 'Z' THEN 4 WHEN regexp_matches(ch, '\\p{Nd}|[²³¹⁰⁴-⁹₀-₉①-⑨]') THEN 5 WHEN regexp_matches(ch, '[" + spec.SPACE + "\\x{1C}-\\x{1F}]') THEN 6 WHEN regexp_matches(ch, '\\p{M}') THEN 7 WHEN regexp_matches(ch, '\\p{P}|\\p{S}') THEN 8 ELSE 9 END AS type FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM reviewed)")
def char_type(s, d):
    ch = reviewed(s, d).select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("ch")).distinct()
    return ch.select("ch", P.char_types(F.array("ch")).alias("t")).select("ch", F.col("t")[0].alias("type"))
