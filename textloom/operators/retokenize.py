"""Canonical tokens of annotated records: approved entities and quantities become one token, approved noun suffixes are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import spec
from textloom.functions.text import canon_qty

NAMED_PRIORITY, QUANTITY_PRIORITY = 300, 200


def span_candidates(spans: DataFrame, approved: DataFrame, is_quantity) -> DataFrame:
    """Spans (rid, s, t, first, last, label, surface; first and last token) that may become one token, with (priority, reason): named
    entities of two tokens or more whose label is the approved one (surface, label), and quantities by ``is_quantity``."""
    known = approved.select("surface", F.col("label").alias("approved"))
    j = spans.join(known, "surface", "left")
    named = F.col("label").isin(*spec.NAMED_ENTITIES) & (F.col("approved") == F.col("label")) & (F.col("last") > F.col("first"))
    quantity = F.col("label").isin(*spec.QUANTITY_ENTITIES) & is_quantity(F.col("surface"))
    j = j.withColumn("priority", F.when(named, NAMED_PRIORITY).when(quantity, QUANTITY_PRIORITY))
    return j.where("priority IS NOT NULL").withColumn("reason", F.when(F.col("priority") == NAMED_PRIORITY, "named-entity").otherwise("quantity")).drop("approved")


def selected_spans(candidates: DataFrame) -> DataFrame:
    """The candidates that are taken, record by record: higher priority, longer, earlier first; none overlaps another. The few spans of
    a record are folded as one array."""
    order = F.struct((-F.col("priority")).alias("p"), (F.col("s") - F.col("t")).alias("n"), F.col("s"), F.col("t"), F.col("first"), F.col("last"), F.col("label"), F.col("surface"), F.col("reason"))
    packed = candidates.groupBy("rid").agg(F.array_sort(F.collect_set(order)).alias("x"))
    taken = F.aggregate("x", F.filter("x", lambda c: F.lit(False)), lambda a, c: F.when(F.exists(a, lambda o: (c["s"] < o["t"]) & (o["s"] < c["t"])), a).otherwise(F.concat(a, F.array(c))))
    return packed.select("rid", F.inline(taken)).select("rid", "s", "t", "first", "last", "label", "surface", "reason")


def canonical_tokens(tokens: DataFrame, selected: DataFrame, suffix_words: DataFrame) -> DataFrame:
    """(rid, position, word, tag, s, t, reason, canonical, eligible) of tokens (rid, i, word, tag, s, t).

    A selected span is one token: of a person with tag Nb, of another name with its last tag, of a quantity with the tag of
    its label and a canonical form, not for the dictionary. Then a suffix behind a token is merged with it where the
    two are one of ``suffix_words`` (surface) and neither is a span; in a chain of such pairs every other one merges, from the
    left.
    """
    k = tokens.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("i", "word", "tag"))).alias("k"))
    return canonical_records(k.select("rid", F.col("k.word").alias("w"), F.col("k.tag").alias("g")), selected, suffix_words)


def token_ends(words):
    """0 and the ends of the words in the text that they make."""
    return F.aggregate(words, F.array(F.lit(0)), lambda a, w: F.array_append(a, F.length(w) + F.element_at(a, -1)))


def canonical_records(records: DataFrame, selected: DataFrame, suffix_words: DataFrame) -> DataFrame:
    """``canonical_tokens`` of records (rid, w, g: the words, none empty, and tags of their tokens, which make the text). A record moves once,
    as arrays; spans and the few pairs with a suffix come to it. Records of one rid are taken once."""
    suffixes = ", ".join(f"'{x}'" for x in spec.NOUN_SUFFIXES)
    pairs = F.expr(f"filter(transform(w, (x, n) -> CASE WHEN n > 0 AND x IN ({suffixes}) AND startswith(g[n], 'N') THEN struct(n AS n, concat(w[n - 1], x) AS pair) END), x -> x IS NOT NULL)")
    p = records.select("rid", F.explode(pairs).alias("p")).select("rid", "p.n", "p.pair").join(suffix_words.select(F.col("surface").alias("pair")).distinct(), "pair")
    p = p.groupBy("rid").agg(F.array_sort(F.collect_set("n")).alias("may"))
    taken = selected.groupBy("rid").agg(F.collect_list(F.struct("s", "t", "label", "surface", "reason")).alias("spans"))
    t = records.groupBy("rid").agg(F.first(F.struct("w", "g")).alias("r")).join(taken, "rid", "left").join(p, "rid", "left")
    t = t.select("rid", "r.w", "r.g", "spans", "may", token_ends(F.col("r.w")).alias("e"))
    # In a chain of pairs of which neither is a span, the odd ones merge, the even ones have lost their partner.
    free = "filter(may, n -> NOT exists(coalesce(spans, array()), c -> c.s < e[n + 1] AND e[n - 1] < c.t))"
    t = t.select("rid", "w", "g", "spans", "e", F.expr(f"aggregate({free}, cast(array() AS array<int>), (a, n) -> CASE WHEN array_contains(a, n - 1) THEN a ELSE array_append(a, n) END)").alias("merged"))
    t = t.select("rid", F.expr("""filter(transform(w, (x, n) -> struct(x AS word, g[n] AS tag, e[n] AS s, e[n + 1] AS t, get(filter(spans, c -> c.s <= e[n] AND e[n] < c.t), 0) AS c,
        CASE WHEN array_contains(merged, n + 1) THEN n + 1 END AS m, coalesce(array_contains(merged, n), false) AS gone)), o -> NOT o.gone AND (o.c IS NULL OR o.c.s = o.s))""").alias("z"), "w", "g", "e")
    z = F.expr("""transform(z, o -> struct(o.word AS word, o.tag AS tag, o.s AS s, o.t AS t, o.c AS c, CASE WHEN o.m IS NOT NULL THEN struct(w[o.m] AS word, g[o.m] AS tag, e[o.m + 1] AS t) END AS next,
        CASE WHEN o.c IS NOT NULL THEN get(reverse(filter(g, (y, n) -> y IS NOT NULL AND o.c.s <= e[n] AND e[n] < o.c.t)), 0) END AS last_tag))""")
    t = t.select("rid", F.posexplode(z).alias("position", "z")).select("rid", F.col("position").cast("long").alias("position"), "z.*")
    span, joins, quantity = F.col("c").isNotNull(), F.col("next").isNotNull(), F.coalesce(F.col("c.reason") == "quantity", F.lit(False))
    by_label = F.create_map(*[F.lit(x) for kv in spec.QUANTITY_TAG.items() for x in kv])
    tag_ = F.when(quantity, by_label[F.col("c.label")]).when(span, F.when(F.col("c.label") == "PERSON", "Nb").otherwise(F.coalesce("last_tag", F.lit("Nb")))).when(joins, F.col("next.tag")).otherwise(F.col("tag"))
    return t.select(
        "rid", F.when(span, F.col("c.surface")).when(joins, F.concat("word", "next.word")).otherwise(F.col("word")).alias("word"), tag_.alias("tag"), F.when(span, F.col("c.s")).otherwise(F.col("s")).cast("long").alias("s"),
        F.when(span, F.col("c.t")).when(joins, F.col("next.t")).otherwise(F.col("t")).cast("long").alias("t"), F.when(span, F.col("c.reason")).when(joins, "noun-suffix").otherwise("original").alias("reason"),
        F.when(quantity, canon_qty(F.col("c.surface"), F.col("c.label"))).alias("canonical"), (~quantity).alias("eligible"), "position",
    )
