"""Evidence for correction candidates (AGG-2 to AGG-4) and coverage of texts by a lexicon (AGG-5 to AGG-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import key

#: Weights of the named levels of confidence.
WEIGHTS = {"exact": 1.0, "very-high": 0.92, "high": 0.82, "medium": 0.62, "low": 0.38, "shadow": 0.18}


def weight(level: Column, number: Column) -> Column:
    """A level's weight, or the number where no level is given, within 0 and 1; unknown levels are medium."""
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), level), F.lit(WEIGHTS["medium"]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(level.isNotNull(), named).otherwise(F.coalesce(number, F.lit(WEIGHTS["medium"])))))


def pool(evidence: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a word of evidence(word, source, candidate_type, level, confidence, reason, ord) (AGG-2)."""
    rows = evidence.withColumn("word", key(F.col("word"))).where("word <> ''").withColumn("w", weight(F.col("level"), F.col("confidence")))
    values = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return rows.groupBy(*by, "word").agg(values("source").alias("sources"), values("candidate_type").alias("types"), values("reason").alias("reasons"), F.max("w").alias("confidence"), F.min("ord").alias("first"))


def with_corpus(pooled: DataFrame, bonus: DataFrame, by: tuple[str, ...] = (), reason: str = "corpus frequency bonus") -> DataFrame:
    """Corpus scores of bonus(word, bonus) added where they are positive (AGG-3)."""
    best = bonus.where("bonus > 0").groupBy(*by, "word").agg(F.max("bonus").alias("corpus_score"))
    rows = pooled.join(best, [*by, "word"], "left").withColumn("corpus_score", F.coalesce("corpus_score", F.lit(0.0)))
    scored = F.col("corpus_score") > 0
    add = lambda c, x: F.when(scored, F.array_sort(F.array_union(c, F.array(F.lit(x))))).otherwise(F.col(c))
    return rows.withColumns({"sources": add("sources", "corpus"), "reasons": add("reasons", reason), "confidence": F.when(scored, F.least(F.lit(1.0), F.round(F.col("confidence") + F.col("corpus_score"), 4))).otherwise(F.col("confidence"))})


def diagnostics(pooled: DataFrame, limit: int = 12) -> DataFrame:
    """The first words with rounded scores (AGG-4); the limit is the report's."""
    out = pooled.orderBy("first", "word").limit(limit)
    return out.select("word", "sources", "types", "reasons", F.round("confidence", 3).alias("confidence"), F.round(F.coalesce("corpus_score", F.lit(0.0)), 4).alias("corpus_score"))


def coverage(words: DataFrame, lexicon: DataFrame, by: str = "doc_id") -> DataFrame:
    """Share of each text's words that the lexicon holds, and how many different ones it lacks (AGG-5)."""
    rows = words.withColumn("word", key(F.col("word"))).where("word <> ''")
    known = lexicon.select(key(F.col("word")).alias("word")).distinct().withColumn("known", F.lit(True))
    # Counted before the join: a frequent word travels once for each text, not for each occurrence.
    joined = rows.groupBy(by, "word").agg(F.count("*").alias("n")).join(known, "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    out = joined.groupBy(by).agg(F.sum("n").alias("total_tokens"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("recognized_tokens"), F.sum((~F.col("known")).cast("bigint")).alias("unrecognized_words"))
    return out.withColumn("coverage_pct", F.round(100 * F.col("recognized_tokens") / F.col("total_tokens"), 1))


def unrecognized(words: DataFrame, lexicon: DataFrame, limit: int = 50) -> DataFrame:
    """The most frequent words that the lexicon lacks (AGG-5); the limit is the report's."""
    counted = words.withColumn("word", key(F.col("word"))).where("word <> ''").groupBy("word").agg(F.count("*").alias("frequency"))
    known = lexicon.select(key(F.col("word")).alias("word")).distinct()
    return counted.join(known, "word", "left_anti").orderBy(F.desc("frequency"), "word").limit(limit)


def accuracy(cases: DataFrame) -> DataFrame:
    """Hits before and after, and how many cases improved or regressed, of cases(expected, before, after) (AGG-7)."""
    ok = lambda c: F.coalesce(key(F.col(c)) == key(F.col("expected")), F.lit(False))
    rows = cases.select(ok("before").alias("b"), ok("after").alias("a"))
    label = F.when(~F.col("b") & F.col("a"), "improved").when(F.col("b") & ~F.col("a"), "regressed").when(F.col("a"), "right").otherwise("wrong")
    return rows.groupBy(label.alias("outcome")).agg(F.count("*").alias("cases"))


def counters(events: DataFrame, slow_ms: float) -> DataFrame:
    """Sums of hits and misses and the slow spans of each stage, of events(stage, name, amount, elapsed_ms) (AGG-6)."""
    amount = lambda suffix: F.sum(F.when(F.col("name").endswith(suffix), F.col("amount")).otherwise(0))
    return events.groupBy("stage").agg(amount("hit").alias("hits"), amount("miss").alias("misses"), F.sum((F.col("elapsed_ms") >= slow_ms).cast("bigint")).alias("slow"), F.max("elapsed_ms").alias("slowest_ms"))
