"""Queries through the SQL functions."""

from __future__ import annotations

from textloom.api.sql import register
from textloom.plans.common import reviewed
from textloom.plans.registry import query


def _view(s, d) -> None:
    register(s, prefix="tl_")
    reviewed(s, d).createOrReplaceTempView("tl_reviewed")


@query("udf")
def udf(s, d):
    """The scalar functions over every text, by SQL."""
    _view(s, d)
    return s.sql("SELECT row_id, size(tl_cut(text)) AS words, size(tl_tokenize(text)) AS tokens, size(tl_split_sentences(text)) AS sentences, size(tl_split_clauses(text)) AS clauses FROM tl_reviewed")


@query("udtf")
def udtf(s, d):
    """The table functions over every text, by SQL, counted by function and text."""
    _view(s, d)
    parts = [f"SELECT '{t}' AS name, row_id, count(*) AS n FROM tl_reviewed, LATERAL tl_{t}(text) GROUP BY row_id" for t in ("tokens", "sentences", "clauses", "blocks", "rule_trace")]
    return s.sql(" UNION ALL ".join(parts))
