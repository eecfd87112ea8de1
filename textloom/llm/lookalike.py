"""Problem 1: one consistent form for text that looks the same but is stored in different characters.

``canonical`` folds, in this order: invisible characters away; width and presentation variants, joined letters,
kinds of space and of hyphen to their plain forms; composed and decomposed sequences to NFC; and, token by
token, look-alike letters. For a token the sets of scripts that each letter could stand for are intersected:
if Latin is left (mixed or whole-script look-alikes), the Latin spelling is taken, else the first other script that is
left; if no single script is left, every look-alike takes its Latin shape. A Katakana letter with the shape of a Han
character is Katakana beside other Katakana, else Han. Case, accents, raised digits, enclosed characters and Han
variants stay as they are: they look different.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import cut_lineage, table

# Letters of other scripts that have the shape of a Latin letter.
CYRILLIC_TO_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "h", "Ԁ": "d", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "у": "y", "ү": "y", "ѵ": "v", "ԝ": "w", "х": "x",
}
GREEK_TO_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "κ": "k",
}
ARMENIAN_TO_LATIN = {"Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g"}
CHEROKEE_TO_LATIN = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L",
    "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
LISU_TO_LATIN = {
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Katakana letters with the shape of a Han character.
KATAKANA_TO_HAN = {"カ": "力", "ニ": "二", "ハ": "八", "エ": "工", "タ": "夕", "ト": "卜", "ロ": "口"}
# Characters with the shape of a plain hyphen.
HYPHENS = "‐‑‒⁃−﹣－"
# Characters without a shape that are not of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍᠏"

_SCRIPTS = {"Cyrillic": CYRILLIC_TO_LATIN, "Greek": GREEK_TO_LATIN, "Armenian": ARMENIAN_TO_LATIN, "Cherokee": CHEROKEE_TO_LATIN, "Lisu": LISU_TO_LATIN}
_TO_LATIN = {k: v for m in _SCRIPTS.values() for k, v in m.items()}
_FROM_LATIN = {script: {v: k for k, v in reversed(m.items())} for script, m in _SCRIPTS.items()}
_TO_KATAKANA = {v: k for k, v in KATAKANA_TO_HAN.items()}
_KEEP_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>", "<font>"}
_NOT_LATIN = "Ͱ-ϿЀ-ԯԱ-֏Ꭰ-ᏽᲀ-᲏ἀ-῿ⷠ-ⷿꓐ-ꓽꙀ-ꚟ"
_OTHER_SCRIPT = re.compile(f"[{_NOT_LATIN}]")
_TOKEN = re.compile(f"[A-Za-zÀ-ÖØ-öø-ɏ\u0300-\u036fḀ-ỿ{_NOT_LATIN}]+")
_KATAKANA_SHAPES = re.compile(f"[{''.join(KATAKANA_TO_HAN)}{''.join(KATAKANA_TO_HAN.values())}]+")
_KATAKANA = re.compile("[ァ-ヺー]")


def is_invisible(ch: str) -> bool:
    return ch in INVISIBLE or unicodedata.category(ch) == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF


def _fold_char(ch: str) -> str:
    if is_invisible(ch):
        return ""
    if ch in HYPHENS:
        return "-"
    if unicodedata.category(ch) == "Zs":
        return " "
    o = ord(ch)
    if 0x2460 <= o <= 0x24FF or 0x3200 <= o <= 0x33FF or 0x1F100 <= o <= 0x1F2FF:  # enclosed and squared: they look different
        return ch
    parts = unicodedata.decomposition(ch).split()
    if not parts or parts[0] not in _KEEP_TAGS or parts[1] == "0020":
        return ch
    out = "".join(chr(int(p, 16)) for p in parts[1:])
    return out if out == ch else "".join(_fold_char(c) for c in out)


class CharMap(dict):
    """A ``str.translate`` table that is filled by a rule as characters turn up."""

    def __init__(self, rule: Callable[[str], str]):
        super().__init__()
        self.rule = rule

    def __missing__(self, o: int) -> str:
        self[o] = out = self.rule(chr(o))
        return out


_FOLD = CharMap(_fold_char)


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x370 or 0x1E00 <= o <= 0x1EFF:
        return "Latin"
    if o < 0x400 or 0x1F00 <= o < 0x2000:
        return "Greek"
    return "Armenian" if 0x530 <= o < 0x590 else "Cherokee" if 0x13A0 <= o < 0x1400 else "Lisu" if 0xA4D0 <= o < 0xA500 else "Cyrillic"


def _could_be(ch: str) -> set[str]:
    """The scripts that a base letter could stand for."""
    own = _script(ch)
    if own == "Latin":
        return {"Latin"} | {s for s, m in _FROM_LATIN.items() if ch in m}
    if ch not in _SCRIPTS[own]:
        return {own}
    return {own, "Latin"} | {s for s, m in _FROM_LATIN.items() if _TO_LATIN[ch] in m}


def resolve_token(token: str) -> str:
    """The spelling of a token in the one script that all of its letters could belong to."""
    letters = unicodedata.normalize("NFD", token)
    left = {"Latin", *_SCRIPTS}
    for ch in letters:
        if not unicodedata.combining(ch):
            left &= _could_be(ch)
    if "Latin" in left or not left:
        out = "".join(_TO_LATIN.get(c, c) for c in letters)
    else:
        script = next(x for x in _SCRIPTS if x in left)
        back = _FROM_LATIN[script]
        out = "".join(c if _script(c) == script or unicodedata.combining(c) else back.get(_TO_LATIN.get(c, c), c) for c in letters)
    return unicodedata.normalize("NFC", out)


def _resolve_katakana(m: re.Match) -> str:
    """A run of shapes that are Katakana or Han: Katakana if a neighbour of the run is."""
    s, (a, b) = m.string, m.span()
    beside = _KATAKANA.match(s[b : b + 1]) or _KATAKANA.match(s[a - 1 : a] if a else "")
    return "".join((_TO_KATAKANA if beside else KATAKANA_TO_HAN).get(c, c) for c in m[0])


def canonical(text: str) -> str:
    """The consistent form of a text. Idempotent; equal exactly for texts that look the same."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    text = unicodedata.normalize("NFC", text.translate(_FOLD))
    if _OTHER_SCRIPT.search(text):
        text = _TOKEN.sub(lambda m: resolve_token(m[0]) if _OTHER_SCRIPT.search(m[0]) else m[0], text)
    if _KATAKANA.search(text):
        text = _KATAKANA_SHAPES.sub(_resolve_katakana, text)
    return text


def canonical_text(column):
    """``canonical`` as a column; null stays null."""

    @F.pandas_udf("string")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([None if x is None else canonical(x) for x in s], index=s.index, dtype=object)

    return run(column)


def _digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (k, c, r): the key and digests of 128 bits of the consistent form and of the text as stored, for rows that share
    their form with another string. The forms that are stored in several ways come out of an aggregate with map-side
    combine, so that identical copies (a third of all rows may be one stock phrase) cost one row each."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    rows = cut_lineage(rows.select("k", F.unhex(F.md5(canonical_text("t"))).alias("c"), F.unhex(F.md5("t")).alias("r")))
    several = rows.groupBy("c").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo < hi").select("c")
    return rows.join(several, "c", "left_semi")


def same_looking_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, class_key, form_key): the rows whose text looks like a different string, with the least key of all rows
    that look like it and the least key of those that are the same string. Unlike pairs, in proportion to the rows. Null texts
    and keys are left out, repeated rows come out once, a table without such rows gives none."""
    kept = _digests(df, key, text)
    forms = kept.groupBy("c", "r").agg(F.min("k").alias("form_key"))
    classes = forms.groupBy("c").agg(F.min("form_key").alias("class_key"))
    return kept.join(forms, ["c", "r"]).join(classes, "c").select(F.col("k").alias("key"), "class_key", "form_key").distinct()


def same_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (key_a, key_b), key_a < key_b, of rows whose texts look the same but are not the same string.

    Only the key and two digests are shuffled. The pairs of a class of many copies of several strings are all rows of the
    result; ``same_looking_classes`` says the same without them. Null texts and keys are left out; empty texts look like
    each other and like texts of invisible characters only; repeated keys give the pair once.
    """
    kept = _digests(df, key, text).distinct()
    a, b = kept.select("c", F.col("k").alias("key_a"), F.col("r").alias("ra")), kept.select("c", F.col("k").alias("key_b"), F.col("r").alias("rb"))
    return a.join(b, "c").where("key_a < key_b AND ra <> rb").select("key_a", "key_b").distinct()


def _both(spark: SparkSession, sf_dir: str, f: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    parts = [f(table(spark, sf_dir, name), key, text).select(F.lit(name).alias("table_name"), "*") for name, key, text in (("reviewed", "row_id", "text"), ("emotion_lexicon", "entry_id", "word"))]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, same_looking_pairs)


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, same_looking_classes)


def consistent_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, form): the consistent form of every text, null for a null text."""
    return df.select(F.col(key).cast("long").alias("key"), canonical_text(F.col(text)).alias("form"))


def p1_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every reviewed text and every word of the lexicon."""
    return _both(spark, sf_dir, consistent_forms)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_changed": p1_changed}
ORACLES: dict[str, str] = {}
