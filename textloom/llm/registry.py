"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import frequency, leakage, lookalike, mixture, overlaps, personal, pieces, sentences

MODULES = (lookalike, sentences, personal, frequency, overlaps, leakage, mixture, pieces)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
