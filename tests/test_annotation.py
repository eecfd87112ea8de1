"""Queries over annotation records: what they move, and records that are odd."""

from __future__ import annotations

import datetime

import __spark_entry__ as entry

SCHEMA = "source string, source_index bigint, text string, tokens array<struct<text:string,ckip_pos:string,entity_labels:array<string>>>, entities array<struct<start:int,`end`:int,label:string,text:string>>, loaded_at timestamp"


def _table(spark, tmp_path, rows) -> str:
    at = datetime.datetime(2024, 1, 1)
    full = [(s, i, text, None if tokens is None else [(w, t, None) for w, t in tokens], entities, at) for s, i, text, tokens, entities in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/annotation.parquet")
    return str(tmp_path)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entity_validate_moves_records_once(spark, tmp_path):
    """Texts and tokens are not joined: one exchange, of records."""
    d = _table(spark, tmp_path, [("a", 1, "臺北車站", [("臺北", "Nc"), ("車站", "Nc")], [(0, 2, "GPE", "臺北")])])
    plan = _plan(entry.queries()["entity_validate"](spark, d))
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_entity_validate_odd_records(spark, tmp_path):
    two = [("臺北", "Nc"), ("車站", "Nc")]
    rows = [
        ("a", 1, "臺北車站", two, [(0, 2, "GPE", "臺北"), (1, 3, "GPE", "北車"), (0, 9, "GPE", "臺北"), (2, 4, "GPE", "臺北"), (3, 3, "GPE", "")]),
        ("a", 1, "臺北車站", two, [(0, 2, "GPE", "臺北"), (1, 3, "GPE", "北車"), (0, 9, "GPE", "臺北"), (2, 4, "GPE", "臺北"), (3, 3, "GPE", "")]),  # delivered twice
        ("b", 2, "臺北", [(None, "Nc"), ("臺", "Nc"), ("", "x"), ("北", "Nc")], [(0, 1, "GPE", "臺"), (1, 2, "GPE", "北"), (None, 2, "GPE", "北")]),
        (None, 3, "臺北", [("臺北", "Nc")], [(0, 2, "GPE", "臺北")]),
        ("c", 4, "臺北車", [("臺北", "Nc"), ("車", "Nc")], [(0, 2, "GPE", "臺北")]),
        ("c", 4, "臺北車", [("臺", "Nc"), ("北車", "Nc")], [(0, 1, "LOC", "臺")]),  # the same key and text, other tokens: the sums of both
        ("d", 5, "臺北", [("臺北", "Nc")], None),
        ("e", 6, "臺北", None, [(0, 2, "GPE", "臺北")]),
    ]
    got = sorted(map(tuple, entry.queries()["entity_validate"](spark, _table(spark, tmp_path, rows)).collect()), key=str)
    import duckdb

    want = duckdb.connect().execute(f"WITH annotation AS (SELECT * FROM '{tmp_path}/annotation.parquet/*.parquet') " + entry.oracle_sql()["entity_validate"]).fetchall()
    assert got == sorted(want, key=str) and len(got) == 11


def test_suffix_pairs_keep_tokens_in_records(spark, tmp_path):
    """Deliveries of one key count where they agree on a word; tokens are not exploded before they are grouped."""
    rows = [
        ("a", 1, "工程師教師", [("工程", "Na"), ("師", "Na"), ("教", "VC"), ("師", "Nb")], None),
        ("a", 1, "工程師教師", [("工程", "Na"), ("師", "Na"), ("教", "VC"), ("師", "Nb")], None),
        ("b", 1, "工程師", [("工程", "Na"), ("師", None), ("x", "N"), ("師", "Na")], None),
        ("b", 1, "工程師", [("工程", "Na"), ("師", "Na"), ("程", "N"), ("師", "Na"), ("員", "Na")], None),  # they differ at x: what stands around it is a pair
        (None, None, None, [(None, "Na"), ("", "Na"), ("公司", "Na"), ("", "Na"), ("員", "Na"), ("者", "VC"), ("家", None)], None),
        ("c", 1, "", [], None),
        ("d", 1, "師", None, None),
    ]
    d = _table(spark, tmp_path, rows)
    df = entry.queries()["rt_suffix_pairs"](spark, d)
    plan = _plan(df)
    assert "Window" not in plan and plan.count("Exchange") == 2
    import duckdb

    want = duckdb.connect().execute(f"WITH annotation AS (SELECT * FROM '{d}/annotation.parquet/*.parquet') " + entry.oracle_sql()["rt_suffix_pairs"]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) >= 3


def _canonical_rows():
    company = [("長榮", "Nb"), ("公司", "Nc"), ("工程", "Na"), ("師", "Na"), ("", "x"), ("三", "Neu"), ("隻", "Nf")]
    text = "".join(w for w, _ in company)
    org = [(0, 4, "ORG", "長榮公司")]
    return [("a", 1, text, company, [*org, (7, 9, "CARDINAL", "三隻")]), ("a", 1, text, company, org), ("b", 2, text, company, [*org, (1, 3, "ORG", "榮公"), (4, 6, "ORG", "錯字")])]


def test_canonical_keeps_records_whole(spark, tmp_path):
    """Tokens are rows only at the end; a record delivered twice with other entities counts once, with the entities of both."""
    d = _table(spark, tmp_path, _canonical_rows())
    df = entry.queries()["rt_canonical"](spark, d)
    got = {}
    for r in df.orderBy("rid", "position").collect():
        got.setdefault(r["rid"], []).append((r["word"], r["tag"], r["char_start"], r["char_end"], r["reason"]))
    start = [("長榮公司", "Nc", 0, 4, "named-entity"), ("工程師", "Na", 4, 7, "noun-suffix")]
    assert sorted(got.values()) == sorted([[*start, ("三隻", "Neu", 7, 9, "quantity")], [*start, ("三", "Neu", 7, 8, "original"), ("隻", "Nf", 8, 9, "original")]])


def test_canonical_pos_counts_records_once(spark, tmp_path):
    d = _table(spark, tmp_path, _canonical_rows())
    got = {(r["word"], r["pos"]): (r["eligible"], r["n"]) for r in entry.queries()["tr_canonical_pos"](spark, d).collect()}
    assert got[("長榮公司", "Nc")] == (True, 2) and got[("工程師", "Na")] == (True, 2) and len(got) == 5
