"""Similarity joins of words (JOIN-7, JOIN-8): blocking by equi-joins, then an exact check of the pairs.

Words within a distance share a delete of as many letters, so that the blocks are equi-joins on deletes. No block is
capped, and the result is whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import anchor, key

MAX_LENGTH = 32


def deletes(word: Column, distance: int = 2) -> Column:
    """The word and what is left of it after up to ``distance`` letters are taken out."""

    def less(w: Column) -> Column:
        g = F.regexp_extract_all(w, F.lit("(?s:.)"), F.lit(0))
        return F.when(F.size(g) > 0, F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_join(F.concat(F.slice(g, F.lit(1), i), F.slice(g, i + 2, F.size(g))), ""))).otherwise(F.array().cast("array<string>"))

    out = level = F.array(word)
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, less)))
        out = F.array_union(out, level)
    return out


def indexed(words: DataFrame, word: str = "word") -> DataFrame:
    """Words fit for the index, in their key form."""
    rows = words.select(key(F.col(word)).alias("word")).distinct()
    return rows.where((F.length("word") <= MAX_LENGTH) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike("[-' ]"))


def near(queries: DataFrame, words: DataFrame, distance: int = 2, limit: int | None = None) -> DataFrame:
    """(query, word, distance) within ``distance`` edits of single letters, by common deletes (JOIN-7).

    With ``limit`` the nearest words of each query (a top-k report); the ties go by the word.
    """
    left = indexed(queries).select(F.col("word").alias("query"), F.explode(deletes(F.col("word"), distance)).alias("k"))
    right = indexed(words).select("word", F.explode(deletes(F.col("word"), distance)).alias("k"))
    pairs = left.join(right, "k").select("query", "word").distinct()
    checked = pairs.withColumn("distance", F.levenshtein("query", "word", distance)).where("distance >= 0")
    if limit is None:
        return checked
    order = Window.partitionBy("query").orderBy("distance", "word")
    return checked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


def near_anchors(queries: DataFrame, words: DataFrame, distance: int = 1) -> DataFrame:
    """(query, anchor): the query's anchor if a word has it, else anchors of its first letter within one edit (JOIN-8)."""
    q = queries.select(anchor(key(F.col("word"))).alias("query")).where("query <> ''").distinct()
    known = words.select(anchor(key(F.col("word"))).alias("anchor")).where("anchor <> ''").distinct()
    exact = q.join(known, q["query"] == known["anchor"]).select("query", "anchor")
    rest = q.join(known, q["query"] == known["anchor"], "left_anti")
    first = lambda c: F.substring(c, 1, 1).alias("first")
    left = rest.select("query", first("query"), F.explode(deletes(F.col("query"), distance)).alias("k"))
    right = known.select("anchor", first("anchor"), F.explode(deletes(F.col("anchor"), distance)).alias("k"))
    close = left.join(right, ["first", "k"]).select("query", "anchor").distinct().where(F.levenshtein("query", "anchor", distance) >= 0)
    return exact.unionByName(close)
