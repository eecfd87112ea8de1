"""Column functions of the text core: normalisation, classes, hashing, shapes. All run inside the JVM unless noted."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import spec


def norm_text(c: Column) -> Column:
    """ASCII lower case and one-to-one variants; keeps the length."""
    return F.translate(c, spec.NORM_FROM, spec.NORM_TO)


def norm_js(c: Column) -> Column:
    return F.translate(F.lower(c), "臺", "台")


def _unicode(f):
    @F.pandas_udf("string")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([None if x is None else f(x) for x in s], index=s.index, dtype=object)

    return run


def norm_nfc(c: Column) -> Column:
    """NFC; Spark has no expression for it, so an Arrow batch goes to Python."""
    return _unicode(lambda x: x if x.isascii() else unicodedata.normalize("NFC", x))(c)


def dedupe_key(c: Column) -> Column:
    """NFKC, no white space, case folded."""
    return _unicode(lambda x: "".join(unicodedata.normalize("NFKC", x).split()).casefold())(c)


def count_class(c: Column, body: str) -> Column:
    """Characters of a class."""
    return F.length(F.regexp_replace(c, F.lit(f"[^{body}]"), F.lit(""))).cast("long")


def char_class(c: Column) -> Column:
    """Class of a single character."""
    return (
        F.when(c.rlike(f"^[{spec.HAN_CORE}]"), "Han").when(c.rlike(f"^[{spec.ALNUM}]"), "Alnum").when(c.rlike(f"^[{spec.SPACE}]"), "Space").when(c.rlike(f"^[{spec.PUNCT}]"), "Punct").otherwise("Other")
    )


def chars(c: Column) -> Column:
    """The code points of a text as an array."""
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def stable_mod(parts: list[Column], n: int) -> Column:
    """SHA-256 of the joined parts as a big-endian number, modulo ``n`` (below 2^31)."""
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda a, i: (a * 4294967296 + F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long")) % n)


def stable_digest(parts: list[Column]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def record_id(parts: list[Column]) -> Column:
    return F.substring(stable_digest(parts), 1, 24)


def hash_bucket(c: Column, buckets: int) -> Column:
    return 2 + F.crc32(F.encode(c, "UTF-8")) % buckets


def bmes_shape(c: Column) -> Column:
    """S, or B, M for every inner character, E."""
    n = F.length(c)
    return F.when(n == 0, "").when(n == 1, "S").otherwise(F.concat(F.lit("B"), F.repeat(F.lit("M"), n - 2), F.lit("E")))


def bmes_valid(sentence: Column, labels: Column) -> Column:
    """Whether labels are whole words (S, or B, any M, E) and as many as the characters of the sentence."""
    return F.coalesce(labels.rlike(r"^(?:S|BM*E)*\z") & (F.length(sentence) == F.length(labels)), F.lit(False))


def count_occurrences(text: Column, target: Column) -> Column:
    """Non-overlapping occurrences of a plain string."""
    return ((F.length(text) - F.length(F.replace(text, target))) / F.length(target)).cast("long")


def clip_unit(x: Column, fallback: float) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(fallback)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def divide0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def harmonic_mean(p: Column, r: Column) -> Column:
    return divide0(2 * p * r, p + r)


def reduction(before: Column, after: Column) -> Column:
    """Percent saved, at least 0; 0 for an empty input."""
    return F.when(before > 0, F.greatest(F.lit(0.0), (1 - after / before) * 100)).otherwise(0.0)


def map_tag(tag: Column) -> Column:
    """struct(target, status, candidates) of an external tag: exact, broad, ambiguous, skipped, unmapped."""
    table = {t: (v, "exact", None) for t, v in spec.TAG_EXACT.items()} | {t: (v, "broad", None) for t, v in spec.TAG_BROAD.items()}
    target = F.create_map(*[F.lit(x) for t, (v, _, _) in table.items() for x in (t, v)])[tag]
    status = F.create_map(*[F.lit(x) for t, (_, s, _) in table.items() for x in (t, s)])[tag]
    several = F.create_map(*[x for t, v in spec.TAG_AMBIGUOUS.items() for x in (F.lit(t), F.lit("|".join(v)))])[tag]
    skipped = tag.rlike("^(" + "|".join(spec.TAG_SKIP) + ")")
    return F.struct(
        target.alias("target"),
        F.when(status.isNotNull(), status).when(several.isNotNull(), "ambiguous").when(skipped, "skipped").otherwise("unmapped").alias("status"),
        several.alias("candidates"),
    )


def canon_qty(c: Column, label: Column) -> Column:
    """Numbers replaced by a representative; years and 百分之 keep their kind."""
    out = F.regexp_replace(c, r"民國[0-9]{1,3}年", "\ufff0A\ufff1年")
    out = F.regexp_replace(out, r"民國[〇零一二兩三四五六七八九十百千壹貳參肆伍陸柒捌玖拾佰仟]+年", "\ufff0B\ufff1年")
    dated = F.regexp_replace(out, r"(^|[^0-9])[12][0-9]{3}年", "$1\ufff0C\ufff1年")
    dated = F.regexp_replace(dated, r"[〇零一二兩三四五六七八九壹貳參肆伍陸柒捌玖]{4}年", "\ufff0D\ufff1年")
    out = F.when(label == "DATE", dated).otherwise(out)
    out = F.regexp_replace(out, "百分之", "\ufff0E\ufff1")
    body = "0-9" + spec.HAN_NUMERALS + "多餘余約.,/"
    han = spec.HAN_NUMERALS + "多餘余約.,/"
    out = F.regexp_replace(out, f"[{han}]*[0-9][{body}]*", "\ufff2")
    out = F.regexp_replace(out, f"[{han}]+", "一")
    for mark, value in (("\ufff2", "1"), ("\ufff0A\ufff1", "民國100"), ("\ufff0B\ufff1", "民國一百"), ("\ufff0C\ufff1", "2000"), ("\ufff0D\ufff1", "二〇〇〇"), ("\ufff0E\ufff1", "百分之")):
        out = F.regexp_replace(out, mark, value)
    return out


def contains_fold(text: Column, query: str) -> Column:
    """Substring test that folds case only for queries with Latin letters."""
    return F.contains(F.lower(text), F.lit(query.lower())) if any(c.isascii() and c.isalpha() for c in query) else F.contains(text, F.lit(query))
