"""All queries of the core with the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import corpus, logs, sources, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = words.QUERIES | corpus.QUERIES | logs.QUERIES | sources.QUERIES
ORACLE: dict[str, str] = words.ORACLE | corpus.ORACLE | logs.ORACLE | sources.ORACLE
FLAGSHIP = "agg1_bigrams"
