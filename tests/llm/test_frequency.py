import collections

from pyspark.sql import functions as F

from textloom.llm.frequency import mark_counts, value_counts


def counted(spark, rows):
    df = spark.createDataFrame(rows, "id long, vals array<string>, value string, n int")
    got = value_counts(df, {"f": F.col("vals")})
    return {r["value"]: (r["occurrences"], r["records"]) for r in got.collect()}


def test_counts_against_brute_force(spark):
    rows = [(1, ["a", "b", "a", None], "x", 1), (2, ["a", "", ""], "x", 1), (3, [], "x", 1), (4, None, "x", 1), (2, ["a", "", ""], "x", 1), (None, ["b"], None, None)]
    occ, rec = collections.Counter(), collections.Counter()
    for _, v, *_ in rows:
        v = [x for x in v or [] if x is not None]
        occ.update(v)
        rec.update(set(v))
    assert counted(spark, rows) == {k: (occ[k], rec[k]) for k in occ}


def test_very_long_record(spark):
    assert counted(spark, [(1, ["t%d" % (i % 7) for i in range(20000)], "x", 1)]) == {"t%d" % i: (20000 // 7 + (i < 20000 % 7), 1) for i in range(7)}


def test_empty_table_and_marks(spark):
    assert counted(spark, []) == {}
    df = spark.createDataFrame([(["c"] if i else ["c", "r"],) for i in range(40)], "vals array<string>")
    marks = mark_counts(value_counts(df, {"f": F.col("vals")}), df.agg(F.count("*").alias("n")))
    assert {r["value"]: r["mark"] for r in marks.collect()} == {"c": "common", "r": "rare"}
