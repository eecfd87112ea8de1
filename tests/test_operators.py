from textloom.operators.documents import depends, page_rank, parse_blocks, select_diverse, split_clauses, split_sentences
from textloom.sources import files


def texts(text, spans):
    return [text[a:b] for *_, a, b in spans]


def test_sentences():
    t = "今天好。「走吧！」他說，\n然後呢？ ok"
    assert texts(t, split_sentences(t)) == ["今天好。", "「走吧！」", "他說，", "然後呢？", "ok"]
    t = "如果下雨，\n就不去。"
    assert texts(t, split_sentences(t)) == ["如果下雨，\n就不去。"]
    assert split_sentences("") == []


def test_dependent():
    assert depends("雖然很遠，") and depends("溫度超過30秒，") and depends("圖形處理器（GPU），") and not depends("他走了，") and not depends("先生，")


def test_clauses():
    t = "他來了，我走（甲，乙），1,000元；好：是。"
    assert texts(t, split_clauses(t)) == ["他來了，", "我走（甲，乙），", "1,000元；", "好：", "是。"]


def test_blocks():
    t = "# 標題\n\n段落一\n續行\n\n- 甲\n  - 乙\n\n```\ncode\n\n```\n> 引\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n***\n末段\n---\n"
    assert [k for k, *_ in parse_blocks(t)] == ["heading", "paragraph", "unordered-list-item", "unordered-list-item", "fenced-code", "blockquote", "table", "thematic-break", "heading"]


def test_rank_and_choice():
    ranks = page_rank({(0, 1): 1.0, (1, 2): 1.0}, 3)
    assert ranks[1] > ranks[0] and abs(sum(ranks) - 1) < 1e-6
    items = [{"relevance": r, "signal": 0.0, "terms": {str(i)}} for i, r in enumerate((0.9, 0.9, 0.1))]
    assert [i for i, _ in select_diverse(items, {(0, 1): 0.9}, 3)] == [0, 2] or [i for i, _ in select_diverse(items, {(0, 1): 0.9}, 3)] == [0]


def test_files(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# 註\n甲乙 5 Na\n丙丁 Nb\n戊己\n", encoding="utf-8")
    got = [tuple(r) for r in files.parse_user_dictionary(files.read_lines(spark, str(tmp_path / "u.txt"))).collect()]
    assert got == [("甲乙", 5.0, "Na"), ("丙丁", None, "Nb"), ("戊己", None, None)]
    (tmp_path / "m.toml").write_text('[[source]]\nid = "a"\nrevision = "r"\n', encoding="utf-8")
    assert files.read_manifest(spark, str(tmp_path / "m.toml")).collect()[0]["id"] == "a"
    (tmp_path / "d.json").write_text('﻿{"甲乙": ["Na", "3"]}', encoding="utf-8")
    assert files.read_dictionary(spark, str(tmp_path / "d.json")).collect()[0]["value"] == ["Na", "3"]
    assert files.parse_lexicon('{"id": "a", "priority": 3, "entries": []}')["id"] == "a"
