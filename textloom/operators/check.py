"""Checking texts and suggesting words: the batch forms of the request operators (API-1 to API-3, API-6).

Words are checked once each, however often they stand in the texts. Candidates come from the spelling variants and from
near words of the lexicon, are pooled as evidence, get corpus scores and are ranked; the best one of each word goes back
to its places by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import key
from textloom.operators.evidence import pool, with_corpus
from textloom.operators.orthography import EDITS, ENDINGS, variants
from textloom.operators.similarity import near
from textloom.session import cut

#: Generators whose hits count more than those of plain edit distance.
STRONG = ("shortcut", "gh_left", "gh_right", "g_to_gh", "insert_gh", "insert_h", "gh_h_hbar")


def candidates(words: DataFrame, lexicon: DataFrame, distance: int = 1) -> DataFrame:
    """(typed, word, source, candidate_type, level, confidence, reason, ord) for words that the lexicon lacks."""
    typed = words.select(key(F.col("word")).alias("word")).where("word <> ''").distinct()
    known = lexicon.select(key(F.col("word")).alias("word")).distinct()
    missing = typed.join(known, "word", "left_anti")
    # All generators in one pass over the words, and one join with the lexicon.
    def tagged(number: int, name: str) -> Column:
        return F.transform(variants(F.col("word"), name), lambda v, i: F.struct(F.lit(name).alias("type"), (F.lit(1000 * number) + i).alias("ord"), v.alias("variant")))

    made = [tagged(number, name) for number, name in enumerate([*EDITS, *ENDINGS])]
    rows = missing.select("word", F.explode(F.concat(*made)).alias("x")).select("word", "x.*")
    hits = rows.join(known.withColumnRenamed("word", "variant"), "variant", "left_semi")
    level = F.when(F.col("type").isin(*STRONG), "high").otherwise("medium")
    none = F.lit(None).cast("double").alias("confidence")
    spelled = hits.select(F.col("word").alias("typed"), F.col("variant").alias("word"), F.lit("orthography").alias("source"), F.col("type").alias("candidate_type"), level.alias("level"), none, F.lit("").alias("reason"), F.col("ord").cast("bigint").alias("ord"))
    close = near(missing, known, distance)
    edited = close.select(F.col("query").alias("typed"), "word", F.lit("edit").alias("source"), F.lit("near").alias("candidate_type"), F.lit("low").alias("level"), none, F.lit("").alias("reason"), (F.lit(1_000_000) + F.col("distance")).cast("bigint").alias("ord"))
    return spelled.unionByName(edited)


def ranked(words: DataFrame, lexicon: DataFrame, unigrams: DataFrame | None = None, distance: int = 1, most: float = 0.25) -> DataFrame:
    """(typed, word, confidence, sources, types, rank): candidates of each word, the best first."""
    pooled = pool(candidates(words, lexicon, distance), ("typed",))
    if unigrams is None:
        pooled = pooled.withColumn("corpus_score", F.lit(0.0))
    else:
        top = unigrams.agg(F.max("log_freq")).first()[0] or 1.0
        bonus = unigrams.select(F.col("w1").alias("word"), F.round(F.least(F.lit(most), F.col("log_freq") / F.lit(top) * most * 0.4), 4).alias("bonus"))
        pooled = with_corpus(pooled, pooled.select("typed", "word").join(bonus, "word"), ("typed",))
    w = Window.partitionBy("typed").orderBy(F.desc("confidence"), F.levenshtein("typed", "word"), "word")
    return pooled.withColumn("rank", F.row_number().over(w)).select("typed", "word", "confidence", "corpus_score", "sources", "types", "rank")


def suggest(words: DataFrame, lexicon: DataFrame, meanings: DataFrame | None = None, limit: int = 10, unigrams: DataFrame | None = None) -> DataFrame:
    """At most ``limit`` suggestions for each word with their meaning (API-2)."""
    best = ranked(words, lexicon, unigrams).where(F.col("rank") <= limit).select("typed", "rank", "word")
    if meanings is None:
        return best.withColumn("meaning", F.lit(""))
    return best.join(meanings.select("word", "meaning"), "word", "left").select("typed", "rank", "word", F.coalesce("meaning", F.lit("")).alias("meaning"))


def check(docs: DataFrame, lexicon: DataFrame, id_column: str, text_column: str, unigrams: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """(id, original_text, corrected_text, changed, unrecognized, corrections) of each text (API-1).

    A word is corrected if its best candidate has the confidence ``least``; a capital at its start is kept.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    split = rows.select("id", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}'’-]+"), F.lit(0)).alias("words"))
    tokens = split.select("id", F.posexplode("words").alias("pos", "word")).withColumn("norm", key(F.col("word")))
    lexicon = cut(lexicon.select(key(F.col("word")).alias("word")).distinct())
    unigrams = None if unigrams is None else cut(unigrams)
    known = lexicon.select(F.col("word").alias("norm"), F.lit(True).alias("known"))
    best = ranked(tokens.select(F.col("norm").alias("word")), lexicon, unigrams).where((F.col("rank") == 1) & (F.col("confidence") >= least)).select(F.col("typed").alias("norm"), F.col("word").alias("best"))
    judged = tokens.join(known, "norm", "left").join(best, "norm", "left")
    capital = F.substring("word", 1, 1) != F.lower(F.substring("word", 1, 1))
    fixed = F.when(capital, F.concat(F.upper(F.substring("best", 1, 1)), F.substring("best", F.lit(2), F.length("best")))).otherwise(F.col("best"))
    judged = judged.withColumn("new", F.coalesce(F.when(F.col("known").isNull(), fixed), F.col("word"))).withColumn("missing", F.col("known").isNull() & F.col("best").isNull())
    per = judged.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "word", "missing"))).alias("t"))
    out = rows.join(per, "id", "left").withColumn("gaps", F.split("text", r"[\p{L}\p{M}'’-]+", -1)).withColumn("t", F.coalesce("t", F.expr("array()")))
    text = F.concat(F.array_join(F.transform("t", lambda x, i: F.concat(F.get("gaps", i), x["new"])), ""), F.element_at("gaps", -1))
    changes = F.transform(F.filter("t", lambda x: x["new"] != x["word"]), lambda x: F.struct(x["pos"].alias("pos"), x["word"].alias("original"), x["new"].alias("corrected")))
    return out.select(F.col("id").alias(id_column), F.col("text").alias("original_text"), text.alias("corrected_text"), (text != F.col("text")).alias("changed"), F.size(F.filter("t", lambda x: x["missing"])).alias("unrecognized"), changes.alias("corrections"))


def health(lexicon: DataFrame, records: DataFrame, unigrams: DataFrame) -> DataFrame:
    """How many words, verb forms, paradigms and n-grams are loaded (API-6)."""
    return lexicon.agg(F.count_distinct("word").alias("words")).crossJoin(records.agg(F.count("*").alias("verb_forms"), F.count_distinct("short_tag").alias("paradigms"))).crossJoin(unigrams.agg(F.count("*").alias("unigrams")))
