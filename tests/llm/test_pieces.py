import os

import pytest

from textloom.llm.pieces import boundaries, pieces, split_text
from textloom.llm.tokens import DEFAULT_VOCABULARY, Tokenizer

VOCABULARIES = ["bytes"] + [DEFAULT_VOCABULARY] * os.path.exists(DEFAULT_VOCABULARY)
TEXTS = [
    "段落一。" * 300 + "\n\n" + "# 標題\n\n" + "Some words here, and more. " * 200,
    "無標點的長文字" * 900,
    "a" * 5000,
    "字 " * 3000,
    "```\ncode line\n\nmore\n" + "x = 1\n" * 900 + "```\nafter",
    "🀀👩‍👩‍👧" * 600,
]


@pytest.mark.parametrize("vocabulary", VOCABULARIES)
@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("limit,overlap", [(200, 0), (200, 40), (64, 63)])
def test_pieces_cover_and_fit(text, vocabulary, limit, overlap):
    t = Tokenizer(vocabulary)
    got = split_text(text, limit, overlap, t)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, n), (c, d, _) in zip(got, got[1:]):
        assert a < c <= b < d and n <= limit and t.count(text[a:b]) == n
        shared = t.count(text[c:b])
        assert shared <= overlap + max(8, overlap // 8) + 8 and (overlap > 0 or c == b)
    assert got[-1][2] <= limit


def test_natural_cut():
    text = "一句話。" * 20 + "\n\n" + "另一句。" * 20
    got = split_text(text, 300, 0, Tokenizer("bytes"))
    assert got[0][1] == 82 and boundaries(text)[0].tolist() == [82]


def test_table(spark):
    rows = [(1, "short", "x"), (2, "長" * 3000, "x"), (2, "長" * 3000, "x"), (3, None, "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, "key long, text string, piece string")
    got = pieces(df, "key", "text", limit=1000, overlap=10, vocabulary="bytes").toPandas()
    assert sorted(got[got["piece"] == 1]["key"]) == [2, 2] and set(got["key"]) == {1, 2, 4} and (got["n_tokens"].dropna() <= 1000).all()
    assert pieces(df.where("false"), "key", "text").count() == 0
    with pytest.raises(ValueError):
        pieces(df, "key", "text", limit=5, overlap=5)
