import json
import threading
import urllib.error
import urllib.request

import pytest

from textloom.__main__ import parser, run
from textloom.api.analysis import Analyzer, Segmenter
from textloom.api.service import MAX_BYTES, analyze, serve
from textloom.api.sql import register

TEXT = "台北市政府今天宣布新政策。GPU 12，好！\n第二行沒有句號"


def test_object():
    s = Segmenter()
    assert "".join(s.cut(TEXT)) == TEXT and s.split_sentences(TEXT) == ["台北市政府今天宣布新政策。", "GPU 12，好！", "第二行沒有句號"]
    assert s.tokenize("GPU 12")[0] == {"word": "GPU", "tag": "FW", "start": 0, "end": 3, "kind": "Eng"} and s.cut("") == []
    assert [b["kind"] for b in s.blocks("# a\n\n- b\n  - c")] == ["heading", "unordered-list-item", "unordered-list-item"] and s.blocks("- b\n  - c")[1]["parent"] == 0
    assert s.rule_trace("3個月")[0]["rule"] == "num_time"


def test_sql_functions(spark):
    names = register(spark, prefix="t_")
    assert "t_cut" in names and "t_rule_trace" in names
    spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("t_texts")
    s = Segmenter()
    assert [r[0] for r in spark.sql("SELECT t_cut(text) FROM t_texts ORDER BY id").collect()] == [s.cut(TEXT), None, []]
    assert [(r["id"], r["sentence"]) for r in spark.sql("SELECT id, sentence FROM t_texts, LATERAL t_sentences(text)").collect()] == [(1, x) for x in s.split_sentences(TEXT)]
    assert [tuple(r) for r in spark.sql("SELECT word, tag, start, end, kind FROM t_tokens('GPU 12')").collect()] == [("GPU", "FW", 0, 3, "Eng"), (" ", "FW", 3, 4, "Space"), ("12", "Neu", 4, 6, "Num")]
    assert spark.sql("SELECT * FROM t_blocks(NULL)").count() == 0


@pytest.mark.parametrize("options,first", [([], "台北市政府今天宣布新政策 。 gpu"), (["--sentences"], "台北市政府今天宣布新政策。"), (["--clauses"], "台北市政府今天宣布新政策。"), (["--format", "tsv"], "台北市政府今天宣布新政策\tNa"), (["--format", "jsonl"], '{"tokens":[{"w":"台北'), (["--keywords", "3"], None), (["--trace"], None), (["--summary", "1"], "台北市"), (["--report"], '{"documents":1')])
def test_command_line(spark, tmp_path, options, first):
    (tmp_path / "a.txt").write_text(TEXT, encoding="utf-8")
    rows = [r["value"] for r in run(spark, parser().parse_args([str(tmp_path / "a.txt"), *options])).collect()]
    assert rows and (first is None or rows[0].lower().startswith(first.lower()))
    with pytest.raises(SystemExit):
        parser().parse_args(["a", "--sentences", "--clauses"])


def test_service(spark):
    a = Analyzer(spark)
    ok = json.dumps({"text": "# 題\n\n結論：市府計畫有效。", "maxBlocks": 1, "threshold": 0}).encode()
    status, answer = analyze(a, ok)
    assert status == 200 and answer["summary"]["selected"] == 1 and answer["sentences"]
    for bad in (b"", b"[]", b'{"text": 1}', b'{"text": "a", "maxBlocks": 0}', b'{"text": "a", "maxBlocks": 101}', b'{"text": "a", "threshold": 2}', b'{"text": "a", "threshold": true}'):
        assert analyze(a, bad)[0] == 400
    assert analyze(a, b" " * (MAX_BYTES + 1))[0] == 413
    server = serve(a, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert json.load(urllib.request.urlopen(f"{base}/api/health", timeout=20)) == {"status": "ok"}
        assert "summary" in json.load(urllib.request.urlopen(urllib.request.Request(f"{base}/api/analyze", data=ok), timeout=60))
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{base}/nothing", timeout=20)
    finally:
        server.shutdown()
        server.server_close()


def test_readers_name_the_place_of_an_error(spark, tmp_path):
    from textloom.sources import files

    (tmp_path / "r.jsonl").write_text('{"schema_version": 1, "id": "a", "text": "x"}\n\n{"schema_version": 2, "id": "b"}\n', encoding="utf-8")
    with pytest.raises(Exception, match="r.jsonl:3: unsupported schema_version"):
        files.read_records(spark, str(tmp_path / "r.jsonl")).collect()
    (tmp_path / "s.jsonl").write_text('{"schema_version": 1, "id": "a", "text": "x"}\nno json\n', encoding="utf-8")
    with pytest.raises(Exception, match="s.jsonl:2: invalid JSON"):
        files.read_records(spark, str(tmp_path / "s.jsonl")).collect()
    (tmp_path / "t.json").write_text('{"labels": [{"id": "a", "family": "f", "defaultPolarity": "odd"}]}', encoding="utf-8")
    with pytest.raises(Exception, match="unknown polarity"):
        files.read_taxonomy(spark, str(tmp_path / "t.json")).collect()
    (tmp_path / "l.txt").write_text("﻿eins\r\n\r\n 　zwei\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_text_file(spark, str(tmp_path / "l.txt"), "s").collect()] == [("s", 0, "eins"), ("s", 2, "zwei")]
    assert [r["text"] for r in files.read_whole(spark, [str(tmp_path / "t.json"), str(tmp_path / "l.txt")]).orderBy("path").collect()][0].endswith("zwei\n")


def test_counts_of_a_stream_survive_a_second_run(spark, tmp_path):
    from textloom.streaming import incremental as I

    at = str(tmp_path)
    for words in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(w,) for w in words], "w string").write.mode("append").parquet(f"{at}/in")
        I.running_counts(spark, f"{at}/in", "w string", ["w"], f"{at}/out", f"{at}/state")
    I.running_counts(spark, f"{at}/in", "w string", ["w"], f"{at}/out", f"{at}/state")
    want = [("a", 2), ("b", 2), ("c", 1)]
    assert sorted(map(tuple, I.read_counts(spark, f"{at}/out", ["w"]).collect())) == want
    I.compact_counts(spark, f"{at}/out", ["w"], f"{at}/new")
    assert sorted(map(tuple, I.read_counts(spark, f"{at}/new", ["w"]).collect())) == want
