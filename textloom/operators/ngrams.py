"""Corpus statistics: n-grams of vertical files, and scores from them (SRC-8, AGG-1, RNK-1, SNK-1).

A file may hold any share of the rows, so that no window runs over a whole file. Files are cut into blocks of lines;
rows look back within their block, and the first two rows of a block take what the last rows before it carry over. The
carry comes from two rows a block. Repeated deliveries of a line are read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_LINES = 50_000
#: What makes a row malformed.
URL, MARKUP, SIGNS, DIGIT = r"(?i)https?://\S+|www\.\S+", r"<[^>]+>", r"^[^\p{L}\p{M}\p{N}_\s]+$", r"\p{Nd}"


def vertical(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with what they are: ``boundary``, ``sentence_end``, ``malformed`` or a ``token`` with its ``norm`` (SRC-8)."""
    text = F.btrim(F.coalesce(F.col(line), F.lit("")), F.lit(" \t\r\n"))
    boundary = (text == "") | text.startswith("#") | text.startswith("<")
    surface = F.btrim(F.split_part(text, F.lit("|"), F.lit(1)), F.lit(" \t\r\n"))
    malformed = ~boundary & ((surface == "") | surface.rlike(URL) | surface.rlike(MARKUP) | surface.rlike(SIGNS) | surface.rlike(DIGIT))
    rows = lines.withColumns({"boundary": boundary, "sentence_end": (text == "") | text.startswith("</s"), "malformed": malformed})
    token = F.when(~boundary & ~malformed & (F.char_length(surface) <= 80), surface)
    return rows.withColumn("token", token).withColumn("norm", F.lower("token"))


def tokens(lines: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line", block_lines: int = BLOCK_LINES) -> DataFrame:
    """(file, line_no, token, norm, p1, p2): every token with the two before it in its sentence."""
    rows = lines.select(F.col(file).alias("file"), F.col(line_no).alias("line_no"), F.col(line).alias("line")).withColumn("block", F.floor(F.col("line_no") / block_lines))
    rows = rows.repartition("file", "block")
    once = Window.partitionBy("file", "block", "line_no").orderBy("line")
    rows = rows.withColumn("copy", F.row_number().over(once)).where("copy = 1")
    kept = vertical(rows).where("boundary or token is not null").select("file", "block", "line_no", "token", "norm")
    order, back = Window.partitionBy("file", "block").orderBy("line_no"), Window.partitionBy("file", "block").orderBy(F.desc("line_no"))
    last_two = kept.withColumn("k", F.row_number().over(back)).where("k <= 2")
    by_file = Window.partitionBy("file").orderBy("line_no")
    ends = last_two.withColumn("before", F.lag("norm").over(by_file)).where("k = 1")
    blocks = Window.partitionBy("file").orderBy("block")
    carry = ends.select("file", "block", F.col("norm").alias("c1"), "before")
    every = rows.select("file", "block").distinct().join(carry, ["file", "block"], "left")
    seen = blocks.rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("has", F.when(F.col("c1").isNotNull() | F.col("before").isNotNull(), F.struct("c1", "before")))
    marked = every.join(ends.select("file", "block", F.lit(True).alias("real")), ["file", "block"], "left")
    carried = marked.withColumn("in", F.last(F.when(F.col("real"), F.struct("c1", "before")), ignorenulls=True).over(seen)).select("file", "block", F.col("in.c1").alias("c1"), F.col("in.before").alias("c2"))
    at = kept.withColumn("k", F.row_number().over(order)).withColumn("l1", F.lag("norm", 1).over(order)).withColumn("l2", F.lag("norm", 2).over(order))
    joined = at.join(carried, ["file", "block"], "left")
    p1 = F.when(F.col("k") == 1, F.col("c1")).otherwise(F.col("l1"))
    p2 = F.when(F.col("k") == 1, F.col("c2")).when(F.col("k") == 2, F.col("c1")).otherwise(F.col("l2"))
    out = joined.where("token is not null").withColumn("p1", p1).withColumn("p2", F.when(p1.isNotNull(), p2))
    return out.select("file", "line_no", "token", "norm", "p1", "p2")


def _kept(counts: DataFrame, columns: list[str], unigrams: DataFrame, min_freq: int) -> DataFrame:
    out = counts.where(F.col("cnt") >= min_freq)
    for c in columns:
        out = out.join(unigrams.select(F.col("w1").alias(c)), c, "left_semi")
    return out.select(*columns, "cnt", F.round(F.log(F.col("cnt").cast("double")), 4).alias("log_freq"))


def unigrams(toks: DataFrame, min_freq: int = 2) -> DataFrame:
    counts = toks.groupBy(F.col("norm").alias("w1")).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_freq)
    return counts.withColumn("log_freq", F.round(F.log(F.col("cnt").cast("double")), 4))


def bigrams(toks: DataFrame, min_freq: int = 2) -> DataFrame:
    counts = toks.where("p1 is not null").groupBy(F.col("p1").alias("w1"), F.col("norm").alias("w2")).agg(F.count("*").alias("cnt"))
    return _kept(counts, ["w1", "w2"], unigrams(toks, min_freq), min_freq)


def trigrams(toks: DataFrame, min_freq: int = 2) -> DataFrame:
    counts = toks.where("p2 is not null").groupBy(F.col("p2").alias("w1"), F.col("p1").alias("w2"), F.col("norm").alias("w3")).agg(F.count("*").alias("cnt"))
    return _kept(counts, ["w1", "w2", "w3"], unigrams(toks, min_freq), min_freq)


def capitals(toks: DataFrame, min_freq: int = 2) -> DataFrame:
    """(w1, preferred): the most frequent spelling of a frequent word, if it isn't the small one; ties by spelling."""
    by = toks.groupBy(F.col("norm").alias("w1"), "token").agg(F.count("*").alias("cnt"))
    best = by.groupBy("w1").agg(F.sum("cnt").alias("all"), F.max(F.struct(F.col("cnt"), F.col("token"))).alias("top"))
    return best.where(F.col("all") >= min_freq).select("w1", F.col("top.token").alias("preferred")).where("preferred <> w1")


def stats(lines: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Sentences, valid and malformed rows of each file; repeated deliveries of a line count once."""
    once = lines.groupBy(F.col(file).alias("file"), F.col(line_no).alias("line_no")).agg(F.min(line).alias("line"))
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    return vertical(once).groupBy("file").agg(n("sentence_end").alias("sentences"), n("malformed").alias("malformed_rows"), F.count("token").alias("valid_rows"))


def score(candidates: DataFrame, uni: DataFrame, bi: DataFrame, tri: DataFrame | None = None, most: float = 0.25, shadow: bool = False) -> DataFrame:
    """Candidates(word, prev, next, prev_prev) with ``bonus`` from how frequent the word and its neighbours are (RNK-1).

    Each share is the log frequency over the largest one, within 0 and 1; the largest is an aggregate of one row in the plan.
    """
    top = uni.agg(F.coalesce(F.max("log_freq"), F.lit(1.0)).alias("_top"))
    low = lambda c: F.lower(F.btrim(F.col(c)))
    part = lambda c, w: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0)) / F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top")))) * F.lit(most * w)
    rows = candidates.withColumns({"_w": low("word"), "_p": low("prev"), "_n": low("next"), "_pp": low("prev_prev")})
    rows = rows.crossJoin(F.broadcast(top))  # one row
    rows = rows.join(uni.select(F.col("w1").alias("_w"), F.col("log_freq").alias("_u")), "_w", "left")
    rows = rows.join(bi.select(F.col("w1").alias("_p"), F.col("w2").alias("_w"), F.col("log_freq").alias("_b")), ["_p", "_w"], "left")
    rows = rows.join(bi.select(F.col("w1").alias("_w"), F.col("w2").alias("_n"), F.col("log_freq").alias("_f")), ["_w", "_n"], "left")
    parts = [part("_u", 0.4), part("_b", 0.35), part("_f", 0.25)]
    if tri is not None:
        rows = rows.join(tri.select(F.col("w1").alias("_pp"), F.col("w2").alias("_p"), F.col("w3").alias("_w"), F.col("log_freq").alias("_t")), ["_pp", "_p", "_w"], "left")
        parts.append(part("_t", 0.2))
    bonus: Column = F.lit(0.0) if shadow else F.round(F.least(F.lit(most), reduce(lambda a, b: a + b, parts)), 4)
    return rows.withColumn("bonus", bonus).drop("_w", "_p", "_n", "_pp", "_u", "_b", "_f", "_t", "_top")


def export(uni: DataFrame, bi: DataFrame, tri: DataFrame, folder: str, overwrite: bool = False) -> None:
    """The index as gzipped JSON lines beside Parquet, and a digest of each table (SNK-1); kept unless told to overwrite."""
    mode = "overwrite" if overwrite else "ignore"
    digests = []
    for name, df in (("unigrams", uni), ("bigrams", bi), ("trigrams", tri)):
        df.write.mode(mode).parquet(f"{folder}/{name}")
        df.write.mode(mode).option("compression", "gzip").json(f"{folder}/{name}_json")
        row_digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        digests.append(df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(row_digest).cast("string").alias("digest")))
    reduce(DataFrame.unionByName, digests).write.mode(mode).json(f"{folder}/meta")


def load(spark, folder: str) -> tuple[str, DataFrame | None, DataFrame | None, DataFrame | None]:
    """(status, unigrams, bigrams, trigrams); trigrams are optional (SRC-6)."""
    from pyspark.errors import AnalysisException

    found: list[DataFrame | None] = []
    for name in ("unigrams", "bigrams", "trigrams"):
        try:
            found.append(spark.read.parquet(f"{folder}/{name}"))
        except AnalysisException:
            found.append(None)
    return ("MISSING_INDEXES" if None in found[:2] else "READY", *found)
