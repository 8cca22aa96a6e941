"""Queries of the training-data problems tagged llm, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.session import table


def _p1_values(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.llm.encoding import fields

    return fields({(t, f): table(spark, folder, t) for t, f in (("create_log", "input"), ("verb_forms", "word"), ("lexical_coverage_report", "word"))})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values with a character from a wrong decoding or a lost letter."""
    from textloom.llm import encoding

    values = _p1_values(spark, folder)
    return encoding.garbled(values, encoding.learned(values)).select("table_name", "field_name", "row_id")


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled values with their text restored."""
    from textloom.llm import encoding

    return encoding.restored(_p1_values(spark, folder))


def _p2_values(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.llm.encoding import fields

    logs = table(spark, folder, "create_log")
    return fields({("create_log", "input"): logs, ("create_log", "final_output"): logs, ("update_choice", "final_output"): table(spark, folder, "update_choice")})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that hold an item of personal data, by kind."""
    from textloom.llm.personal import items

    return items(_p2_values(spark, folder), table(spark, folder, "name_list")).select("table_name", "field_name", "row_id", "kind").distinct()


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Those values with each item replaced by a placeholder of its type."""
    from textloom.llm import personal

    values = _p2_values(spark, folder)
    return personal.redacted(values, personal.items(values, table(spark, folder, "name_list")))


def p2_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """How many items of each kind were seeds, and how many were discovered by patterns."""
    from textloom.llm import personal

    return personal.evidence(personal.items(_p2_values(spark, folder), table(spark, folder, "name_list")))


def _p3_judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from textloom.llm import truncation

    logs = table(spark, folder, "create_log")
    values = truncation.values(logs, table(spark, folder, "update_choice"))
    return values, truncation.judged(values, truncation.corpus(logs))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that were cut within a word or sentence."""
    return _p3_judged(spark, folder)[1].where("is_cut").select("table_name", "field_name", "row_id")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The share of cut values for each client and field."""
    from textloom.llm.truncation import rates

    return rates(*_p3_judged(spark, folder))


def _p5_judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import functions as F

    from textloom.llm.language import fit, languages_of

    logs, docs, spans = (table(spark, folder, n) for n in ("create_log", "documents", "unified_match"))
    speech = fit(logs, "row_id", "input", "input_lang", ("mt", "en", "it"))
    patents = fit(docs, "doc_id", "text", "lang", ("en", "de", "fr"), sample_rows=150)
    logs = logs.select(F.lit("create_log").alias("table_name"), "row_id", F.col("input_lang").alias("label"), F.col("input").alias("text"))
    docs = docs.select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), "text")
    accepted = F.col("is_accepted_english_quote")
    quotes = spans.where("is_quote").select(F.lit("unified_match").alias("table_name"), "row_id", F.when(accepted, "en").when(~accepted, "not en").alias("label"), F.col("inner_text").alias("text"))
    return languages_of(logs, speech), languages_of(docs, patents), languages_of(quotes, speech)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the texts whose label is missing or wrong, and of mixed texts."""
    from pyspark.sql import functions as F

    from textloom.llm.language import mislabelled

    logs, docs, quotes = _p5_judged(spark, folder)
    wrong = F.col("label").isNull() | ((F.col("label") == "en") != (F.col("lang") == "en"))
    quotes = quotes.where(F.col("lang").isNotNull() & wrong).select("table_name", "row_id", "lang")
    return mislabelled(logs).unionByName(mislabelled(docs)).unionByName(quotes)


def p5_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every text, and the segments of mixed ones."""
    logs, docs, quotes = _p5_judged(spark, folder)
    return logs.unionByName(docs).unionByName(quotes)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that aren't in the consistent form, without those that a wrong decoding garbled."""
    from textloom.llm import canonical, encoding

    known = {(t, f): table(spark, folder, t) for t, f in (("create_log", "input"), ("verb_forms", "word"), ("unified_match", "group0"))}
    moved = canonical.changed(encoding.fields(known)).drop("form")
    mapping = encoding.learned(_p1_values(spark, folder))
    return encoding.not_garbled(moved, mapping, {"unified_match"}).select("table_name", "field_name", "row_id")


def p6_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the fields, and every quote, with its text in the consistent form."""
    from textloom.llm import canonical, encoding

    fields = (("create_log", "input"), ("verb_forms", "word"), ("unified_match", "group0"), ("unified_match", "inner_text"))
    values = encoding.fields({(t, f): table(spark, folder, t) for t, f in fields})
    return canonical.canonical(values, "text").withColumnRenamed("text", "form")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    from textloom.llm.tokens import token_ids

    return token_ids(table(spark, folder, "documents"))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Container and position of every document, or piece of one, for each capacity."""
    from textloom.llm.packing import pack
    from textloom.llm.tokens import token_counts

    return pack(token_counts(table(spark, folder, "documents")), table(spark, folder, "pack_sizes"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity: documents placed, containers that hold more than it, places taken twice, documents with other sizes than their tokens."""
    from pyspark.sql import functions as F

    from textloom.llm.packing import pack
    from textloom.llm.tokens import token_counts
    from textloom.session import cut

    sizes, limits = cut(token_counts(table(spark, folder, "documents"))), table(spark, folder, "pack_sizes")
    placed = cut(pack(sizes, limits))
    fill = placed.groupBy("capacity_name", "container").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("items"), F.count_distinct("position").alias("places")).join(limits, "capacity_name")
    by_container = fill.groupBy("capacity_name").agg(F.count_if(F.col("fill") > F.col("capacity_tokens")).alias("overfull"), F.sum(F.col("items") - F.col("places")).alias("doubled"))
    by_document = placed.groupBy("capacity_name", "doc_id").agg(F.sum("n_tokens").alias("placed")).join(sizes, "doc_id").groupBy("capacity_name").agg(F.count("*").alias("documents"), F.count_if(F.col("placed") != F.col("n_tokens")).alias("wrong"))
    return by_document.join(by_container, "capacity_name").select("capacity_name", "documents", "overfull", "doubled", "wrong")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with a common run of 200 characters."""
    from textloom.llm.spans import shared_pairs

    return shared_pairs(table(spark, folder, "documents"))


def p9_cover(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document stands verbatim in others."""
    from textloom.llm.spans import shared_cover

    return shared_cover(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_redacted, p2_evidence, p3_found, p3_rates, p5_found, p5_languages, p6_found, p6_forms, p7_ids, p8_pack, p8_checks, p9_found, p9_cover)}

ORACLE: dict[str, str] = {"p8_checks": "select capacity_name, (select count(*) from documents) as documents, 0::bigint as overfull, 0::bigint as doubled, 0::bigint as wrong from pack_sizes"}
