"""Problem 4: occurrences and record counts of every distinct value of array fields.

Each record emits its values already counted (the sorted array's runs), the partial hash aggregate combines
them before the shuffle, and the final aggregate sums occurrences and records. A value that stands in a third
of all rows therefore reaches the shuffle once per map task, not once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import table


def value_counts(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Rows (field, value, occurrences, records) over all rows of ``df``.

    ``fields`` maps a field's name to an array-of-strings column. Values are compared exactly as stored. A null
    array or an empty one gives nothing, null elements are left out, the empty string is a value like any
    other, repeated rows all count, and an empty table gives no rows. Other columns of ``df`` play no part.

    A record's values are counted in O(n log n): the array is sorted, a run ends where the next element
    differs, and a run's count is the distance to the end before. Each step is a projection of its own, so
    that no lambda evaluates an array again.
    """
    names = list(fields)
    step = df.select(*[F.array_sort(F.filter(fields[name], lambda x: x.isNotNull())).alias(f"v{i}") for i, name in enumerate(names)])
    step = step.select(*[_run_ends(F.col(f"v{i}")).alias(f"e{i}") for i in range(len(names))])
    step = step.select(*[_run_counts(F.col(f"e{i}"), name).alias(f"c{i}") for i, name in enumerate(names)])
    empty = F.array().cast("array<struct<field:string,value:string,n:bigint>>")
    return (
        step.select(F.explode(F.concat(*[F.coalesce(f"c{i}", empty) for i in range(len(names))])).alias("r"))
        .select("r.*")
        .groupBy("field", "value")
        .agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    )


def _run_ends(values: Column) -> Column:
    marked = F.transform(values, lambda x, k: F.struct(x.alias("value"), (k + 1).cast("long").alias("end"), F.coalesce(F.get(values, k + 1) != x, F.lit(True)).alias("last")))
    return F.filter(marked, lambda r: r["last"])


def _run_counts(ends: Column, field: str) -> Column:
    return F.transform(ends, lambda r, k: F.struct(F.lit(field).alias("field"), r["value"].alias("value"), (r["end"] - F.coalesce(F.get(ends, k - 1)["end"], F.lit(0))).alias("n")))


def mark_counts(counts: DataFrame, total: DataFrame, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """Adds ``mark``: 'rare' in fewer than ``rare_below`` records, 'common' in more than ``common_above`` of
    the one number in ``total``, else null. A value that is both (tiny tables) is 'rare'."""
    n = total.select(F.first(total[total.columns[0]]).alias("__total"))
    return (
        counts.crossJoin(F.broadcast(n))  # one row
        .withColumn("mark", F.when(F.col("records") < rare_below, F.lit("rare")).when(F.col("records") > common_above * F.col("__total"), F.lit("common")))
        .drop("__total")
    )


def _token_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens = table(spark, sf_dir, "reviewed").select(F.col("review.tokens").alias("tokens")).where(F.col("tokens").isNotNull())
    counts = value_counts(tokens, {"text": F.col("tokens.text"), "pos": F.col("tokens.pos")})
    return counts, tokens.agg(F.count(F.lit(1)).alias("n"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_counts(*_token_counts(spark, sf_dir)).where(F.col("mark").isNotNull()).select("field", "value", "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_counts(*_token_counts(spark, sf_dir))


_COUNTS_SQL = """
WITH r AS (SELECT row_number() OVER () AS rid, review.tokens AS tokens FROM reviewed WHERE review.tokens IS NOT NULL),
t AS (SELECT rid, unnest(tokens) AS k FROM r),
v AS (SELECT rid, 'text' AS field, k.text AS value FROM t UNION ALL SELECT rid, 'pos', k.pos FROM t),
c AS (SELECT field, value, count(*)::BIGINT AS occurrences, count(DISTINCT rid)::BIGINT AS records FROM v WHERE value IS NOT NULL GROUP BY ALL),
m AS (SELECT c.*, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_counts": p4_counts}
ORACLES = {
    "p4_found": _COUNTS_SQL + "SELECT field, value, mark FROM m WHERE mark IS NOT NULL",
    "p4_counts": _COUNTS_SQL + "SELECT field, value, occurrences, records, mark FROM m",
}
