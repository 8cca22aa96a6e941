"""Dictionary sources and lookups (SRC-1 to SRC-5, SRC-7, SRC-11, SNK-3, JOIN-1, JOIN-2, JOIN-5, JOIN-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import anchor, clean_meaning, exact_key, graphemes, key, payload, radical, surface

#: Fixed values of the verb tags.
ADMITTED = r"^(?:AS|T|Q|S)-"
VERB_PAYLOAD = r"^(?:T|Q|S|AS|IS)-"


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, line) of dictionary files; files that aren't there are skipped (SRC-1, SRC-2)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(conf).exists(p))

    found = [p for p in paths if there(p)]
    if not found:
        return spark.createDataFrame([], "source string, line string")
    lines = spark.read.text(found).select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", "^﻿", "").alias("line"))
    return lines


def files(spark: SparkSession, folder: str, pattern: str = "*.{dic,txt,vrt,vert,tsv,csv,json,xml,conll}") -> DataFrame:
    """Corpus files below a folder, hidden ones left out, in order (SRC-7)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length").where(~F.col("path").rlike(r"/\.[^/]*$")).orderBy("path")


def entries(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with ``surface`` and ``payload``; comments, counts and lines without a slash are left out (SRC-2, STR-13)."""
    rows = lines.where(F.col(line).isNotNull() & ~F.btrim(line).rlike(r"^(?:#|[0-9]*$)") & F.col(line).contains("/"))
    return rows.withColumn("surface", surface(F.col(line))).withColumn("payload", payload(F.col(line))).where("surface <> ''")


def without_verbs(found: DataFrame) -> DataFrame:
    return found.where(~F.coalesce(F.col("payload").rlike(VERB_PAYLOAD), F.lit(False)))


def verb_records(found: DataFrame) -> DataFrame:
    """Entries whose payload is a verb tag, as typed records (SRC-1)."""
    parts = F.split("payload", "-")
    stem = F.get(parts, F.lit(0)) == "AS"
    rows = found.where(F.col("payload").rlike(ADMITTED) & (F.size(parts) >= F.when(stem, 4).otherwise(3)))
    at = lambda i: F.get(parts, F.lit(i))
    first = F.when(stem, 4).otherwise(5)
    return rows.select(
        key(F.col("surface")).alias("word"),
        F.col("payload").alias("raw_tag"),
        at(0).alias("tag_prefix"),
        at(1).alias("root"),
        F.when(stem, F.lit("S")).otherwise(at(2)).alias("form_class"),
        F.coalesce(F.when(stem, at(2)).otherwise(at(3)), F.lit("")).alias("tense"),
        F.coalesce(F.when(stem, at(3)).otherwise(at(4)), F.lit("")).alias("person"),
        F.slice(parts, first + 1, F.size(parts)).alias("extra"),
        F.when(stem, at(0)).otherwise(F.lit("")).alias("stem_kind"),
        *[c for c in ("source", "line_no") if c in rows.columns],
    )


def by_tag(found: DataFrame, part: str) -> DataFrame:
    """(word): exact and normalised keys of entries whose first tag holds ``part`` (SRC-4, SRC-11)."""
    rows = found.where(F.upper(F.split_part("payload", F.lit("-"), F.lit(1))).contains(part))
    return rows.select(F.explode(F.array(key(F.col("surface")), exact_key(F.col("surface")))).alias("word")).where("word <> ''").distinct()


def rule_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row for each rule of a JSON catalogue (SRC-5)."""
    return spark.read.option("multiLine", "true").json(path).select("schema_version", F.explode("rules").alias("rule")).select("schema_version", "rule.*")


def short_tag(tag_prefix: Column, stem_kind: Column, root: Column, form_class: Column) -> Column:
    return F.concat_ws("-", tag_prefix, F.when(stem_kind != "", stem_kind), root, form_class)


def with_features(records: DataFrame) -> DataFrame:
    """Verb records with the columns that joins and rules go by (FLT-7, STR-5, STR-6)."""
    stem = F.coalesce(F.col("stem_kind"), F.lit("")) != ""
    second, third = F.when(~stem, radical(F.col("root"), 2)), F.when(~stem, radical(F.col("root"), 3))
    medial = (F.col("form_class") == "F1") & second.isin("l", "m", "n", "r", "għ")
    weak = lambda c: F.coalesce(c.isin("w", "j"), F.lit(False))
    root_class = (
        F.when(stem, F.concat(F.lit("STEM_"), "stem_kind")).when(F.coalesce(medial, F.lit(False)), "F1_MEDIAL_LIQUID_OR_GUTTURAL").when(weak(third), "FINAL_WEAK").when(weak(second), "HOLLOW").when(F.col("form_class") == "F1", "F1_NORMAL").otherwise("OTHER")
    )
    return records.withColumns(
        {
            "form_number": F.regexp_extract("form_class", r"^F(\d+)", 1).try_cast("int"),
            "short_tag": short_tag(F.col("tag_prefix"), F.coalesce("stem_kind", F.lit("")), F.col("root"), F.col("form_class")),
            "anchor": anchor(key(F.col("word"))),
            "root_class": root_class,
            "final_weak": weak(third),
            "object_blocked": F.col("form_class").rlike("^(?:F7|F9$|F10)"),
        }
    )


def distinct_records(records: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each word and tag (MOR-11)."""
    w = Window.partitionBy("word", "raw_tag").orderBy(*order)
    return records.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def person_variants(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, person, variant) for wanted(word, person): a form of the same paradigm, of the same tense if there is one (JOIN-5)."""
    finite = records.where("tense <> 'IMP'")
    own = wanted.join(finite.select("word", "short_tag", F.col("tense").alias("own_tense")), "word").distinct()
    related = finite.select("short_tag", "person", F.col("word").alias("variant"), "tense", "line_number")
    pairs = own.join(related, ["short_tag", "person"]).where("variant <> word")
    best = F.min(F.struct((F.col("tense") != F.col("own_tense")).cast("int").alias("other_tense"), "line_number", "variant"))
    return pairs.groupBy("word", "person").agg(best.alias("b")).select("word", "person", F.col("b.variant").alias("variant"))


def meanings(found: DataFrame, meaning: Column, order: Column) -> DataFrame:
    """(key, exact, meaning, ord) of dictionary entries with a meaning."""
    rows = found.select(key(F.col("surface")).alias("key"), exact_key(F.col("surface")).alias("exact"), clean_meaning(meaning).alias("meaning"), order.alias("ord"))
    return rows.where("key <> '' and meaning <> ''")


def look_up(words: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """Words with their meanings joined by " / "; those under the exact spelling go before those under the key (JOIN-1)."""
    rows = words.select(F.col(word).alias("word")).distinct().withColumn("_exact", exact_key(F.col("word"))).withColumn("_key", key(F.col("word")))
    once = lambda by, name: index.groupBy(F.col(by).alias(f"_{by}"), "meaning").agg(F.min("ord").alias("ord")).groupBy(f"_{by}").agg(F.array_sort(F.collect_list(F.struct("ord", "meaning"))).alias(name))
    joined = rows.join(once("exact", "a"), "_exact", "left").join(once("key", "b"), "_key", "left")
    hits = F.coalesce("a", "b", F.expr("cast(array() as array<struct<ord:bigint,meaning:string>>)"))
    return joined.select("word", F.array_join(F.transform(hits, lambda m: m["meaning"]), " / ").alias("meaning"))


def tag_features(found: DataFrame) -> DataFrame:
    """(word, prefixes, gender, number, noun, adjective) of dictionary entries (JOIN-10, FLT-3, FLT-8)."""
    rows = found.select(key(F.col("surface")).alias("word"), F.upper(F.split_part("payload", F.lit("-"), F.lit(1))).alias("prefix"))
    by = rows.groupBy("word").agg(F.array_sort(F.collect_set("prefix")).alias("prefixes"))
    has = lambda p: F.exists("prefixes", lambda x: x.rlike(p))
    return by.withColumns(
        {
            "noun_gender": F.when(has("^SINGNOUNF"), "F").when(has("^SINGNOUNM"), "M"),
            "noun_number": F.when(has("^(?:PLUNOUN|PAUCNOUN)"), "PLU").when(has("^SINGNOUN"), "SING"),
            "adjective_gender": F.when(has("^(?:SING|PLU)ADJF"), "F").when(has("^(?:SING|PLU)ADJM"), "M"),
            "adjective_number": F.when(has("^SINGADJ"), "SING").when(has("^PLUADJ"), "PLU"),
            "is_noun": has("NOUN"),
            "is_adjective": has("ADJ") & ~F.col("word").isin("wisq"),
            "is_numeral": has("NUM"),
        }
    )


def dictionary_lines(found: DataFrame, least: int = 0) -> DataFrame:
    """Distinct sorted lines ``surface/payload``; fewer than ``least`` are an error (SNK-3)."""
    out = found.select(F.concat_ws("/", "surface", "payload").alias("line")).distinct()
    if least and out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} lines")
    return out.orderBy("line")


def skeleton_letters(word: Column) -> Column:
    return F.size(graphemes(word))
