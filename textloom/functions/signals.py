"""Signals of importance in a text: counts, scores and discourse markers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import spec

# Weights of the signals in the score.
SCORE_WEIGHTS = {"proper": 0.30, "money": 0.25, "date": 0.15, "quantity": 0.10, "number": 0.10, "acronym": 0.05, "object": 0.05}


_WORD = r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]"


def java_pattern(name: str) -> str:
    """A signal's pattern for the JVM: a word boundary is one of letters of any script."""
    return spec.SIGNALS[name].replace(r"\p{Han}", r"\p{IsHan}").replace(r"\b", f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))")


def signal_count(c: Column, name: str) -> Column:
    return F.regexp_count(c, F.lit(java_pattern(name))).cast("long")


def signal_score(c: Column) -> Column:
    """The weights of the signals that a text has, at most 1."""
    some = lambda *names: c.rlike("|".join(f"(?:{java_pattern(n)})" for n in names)).cast("int")
    total = sum((F.lit(w) * (some("proper_en", "proper_cjk") if n == "proper" else some(n)) for n, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    return F.least(F.lit(1.0), total)


def negations(c: Column) -> tuple[Column, Column]:
    """Counts of Han and of English negations that are not part of another construction."""
    excluded = "|".join(x for x in spec.NEGATION_EXCLUDED if x[0] in spec.NEGATION_CHARS)
    han = F.regexp_count(c, F.lit(f"(?!{excluded})[{spec.NEGATION_CHARS}]")) - F.regexp_count(c, F.lit("是否(?!則)"))
    english = F.regexp_replace(F.lower(c), F.lit("[^\\x00-\\x7F]+"), F.lit(" "))
    count = lambda p: F.regexp_count(english, F.lit(p))
    return han.cast("long"), (count(spec.NEGATION_EN) - count(r"\bnot only") - count(r"whether or not\b") - count(r"neither nor\b")).cast("long")


def _any(c: Column, markers: tuple[str, ...]) -> Column:
    return c.rlike("|".join(markers))


def discourse_score(c: Column) -> Column:
    t = F.lower(c)
    return F.when(_any(t, spec.DISCOURSE_1), 1.0).when(_any(t, spec.DISCOURSE_2), 0.75).otherwise(0.25)


DISCOURSE_SQL = f"CASE WHEN regexp_matches(t, '{'|'.join(spec.DISCOURSE_1)}') THEN 1.0::DOUBLE WHEN regexp_matches(t, '{'|'.join(spec.DISCOURSE_2)}') THEN 0.75 ELSE 0.25 END"
