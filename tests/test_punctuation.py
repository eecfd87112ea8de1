import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import punctuation as P


def labels(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return df, {r["id"]: r for r in P.labelled(df, "id", "text").collect()}


def test_labels_of_boundaries(spark):
    texts = ["他說：「你好。」", "請看 https://example.com/a,b，價格是 12.5 元。", '他說"好"了', "U.S.A. 在1,000.5。", None, "", "。「」", "a？？b"]
    df, got = labels(spark, texts)
    assert (got[0]["units"], got[0]["punctuation"], got[0]["quotes"]) == (list("他說你好"), [0, 0, 5, 0, 2], [0, 0, 1, 0, 2])
    assert "https://example.com/a,b" in "".join(got[1]["units"]) and "12.5" in "".join(got[1]["units"]) and got[1]["punctuation"].count(1) == 1 and got[1]["punctuation"].count(2) == 1
    assert got[2]["quotes"] == [0, 0, 1, 2, 0] and " " in got[1]["units"]
    assert "".join(got[3]["units"]) == "U.S.A. 在1,000.5" and got[3]["punctuation"][-1] == 2
    assert [got[i]["error"] for i in range(8)] == [None, None, None, None, "null", "null", "conflicting_quotes", None] and got[7]["punctuation"] == [0, 3, 0]
    for i in (0, 1, 2, 3, 7):
        assert len(got[i]["punctuation"]) == len(got[i]["quotes"]) == len(got[i]["allowed"]) == len(got[i]["units"]) + 1
    a = dict(zip(itertools.count(), got[1]["allowed"]))
    at = "".join(got[1]["units"]).index("https")
    assert not a[0] and not any(a[at + k] for k in range(1, 20)) and got[7]["allowed"] == [False, False, True]


@pytest.mark.parametrize("text,error", [("他說：「你好。", "unclosed_quote"), ("「一「二」三」", "nested_quotes"), ("一」二「", "unmatched_quote"), ("一。？二", "conflicting_punctuation"), ("「一」「二」", "conflicting_quotes"), ("，，", "empty")])
def test_rejected(spark, text, error):
    assert labels(spark, [text])[1][0]["error"] == error


def test_rendering_gives_the_text_back(spark):
    texts = ["他說：「你好。」", "一，二；三！「四」五", "a、b"]
    df, _ = labels(spark, texts)
    out = P.labelled(df, "id", "text").select("id", P.rendered("units", "punctuation", "quotes").alias("t"), P.rendered("units", "punctuation", "quotes", "half").alias("h")).orderBy("id").collect()
    assert [r["t"] for r in out] == ["他說：「你好」。", "一，二；三！「四」五", "a、b"] and out[1]["h"] == '一,二;三!"四"五'


def test_decoder_against_every_sequence():
    rng = np.random.default_rng(3)
    for n in range(1, 6):
        for _ in range(20):
            m, q, pairs, allowed = rng.normal(size=(n, 3)), rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.random(n) < 0.7
            best = -np.inf
            for quotes in itertools.product(range(3), repeat=n):
                depth, ok = 0, True
                for x in quotes:
                    depth += (x == 1) - (x == 2)
                    ok &= depth in (0, 1)
                if ok and not depth:
                    best = max(best, sum(max(m[t, k] + q[t, x] + pairs[k, x] for k in (range(3) if allowed[t] else (0,))) for t, x in enumerate(quotes)))
            marks, quotes, score = P.constrained_decode(m, q, pairs, allowed)
            assert abs(score - best) < 1e-9 and abs(sum(m[t, a] + q[t, b] + pairs[a, b] for t, (a, b) in enumerate(zip(marks, quotes))) - best) < 1e-9
            assert all(allowed[t] or not a for t, a in enumerate(marks))
    with pytest.raises(ValueError):
        P.constrained_decode(np.zeros((1, 3)), np.array([[-np.inf, 0, 0]]))
    with pytest.raises(ValueError):
        P.constrained_decode(np.zeros((2, 3)), np.zeros((1, 3)))


def test_unclosed(spark):
    texts = ["「一」", "」「", "「「」」", "一", "「一", "「一』"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.unclosed(F.col("t"))).collect()]
    assert got == [False, True, True, False, True, False]


def test_features_of_tokens(spark):
    rows = [(1, ["他", "說：", "「你好嗎", "。」"]), (2, ["他說"]), (3, None), (4, ["他", "說", "你好嗎", "x"])]
    df = spark.createDataFrame([(k, list("他說你好嗎"), t) for k, t in rows], "id int, units array<string>, tokens array<string>")
    got = {r["id"]: (r["bmes"], r["word_lengths"]) for r in P.token_features(df, "id", "units", "tokens").collect()}
    assert got[1] == ([4, 4, 1, 2, 3], [1, 1, 3, 3, 3]) and got[2] == got[3] == got[4] == ([5] * 5, [6] * 5)


def test_augmentation(spark):
    df, _ = labels(spark, ["一，二。三！四", "五六", "「一，二」三"])
    got = sorted((r["id"], r["part"], "".join(r["units"]), r["punctuation"]) for r in P.augmented(P.labelled(df, "id", "text"), "id").collect())
    assert got == [(0, 0, "一二三四", [0, 1, 2, 4, 0]), (0, 1, "一二", [0, 1, 2]), (0, 2, "三四", [0, 4, 0]), (1, 0, "五六", [0, 0, 0]), (2, 0, "一二三", [0, 1, 0, 0])]


def test_metrics(spark):
    rows = [("a", 0, 0, 0, 0), ("a", 1, 0, 1, 0), ("a", 2, 1, 1, 1), ("b", 0, 2, 0, 2), ("b", 0, 0, 3, 0)]
    m = P.boundary_metrics(spark.createDataFrame(rows, "key string, gm int, gq int, pm int, pq int")).first()
    assert (m["texts"], m["boundaries"], m["accuracy"], m["event_accuracy"], m["insertion_rate"], m["event_precision"], m["event_recall"], m["quotes_exact"]) == (2, 5, 0.6, 0.666667, 0.5, 0.75, 1.0, 1.0)
    c = {r["label"]: r for r in P.class_metrics(spark.createDataFrame([(1, 1), (1, 2), (2, 2), (0, 2)], "g int, p int")).collect()}
    assert (c[1]["precision"], c[1]["recall"], c[2]["precision"], c[2]["f1"], c[0]["f1"]) == (1.0, 0.5, 0.333333, 0.5, 0.0)


def test_a_model_restores_what_it_has_seen(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["今天好，", "天氣熱。", "你說「是」嗎？"]) for _ in range(4)) for _ in range(60)]
    df, _ = labels(spark, texts)
    rows = P.boundaries(P.labelled(df, "id", "text"), "id")
    got = P.restored(P.scored(rows.where("id < 5"), rows.where("id >= 5")), "id").collect()
    assert len(got) == 5 and all(r["gold_marks"] == r["marks"] and r["gold_quotes"] == r["quotes"] for r in got)
