"""Rows that fail to parse (problem 4): valid rows are loaded typed, the others set aside with their reason.

Every column is read as nullable text. Cast and constraint rules fill an array of errors in the order ``quoting``,
``columns``, ``value``; rows with an empty array are loaded, and the first error is the reason of the others. Nothing
is shuffled, and only the strict JSON check leaves the JVM, in Arrow batches.

Defined results: a null line counts as a blank one (for JSON: as text that isn't JSON); repeated rows are judged each
by itself; an empty table gives two empty tables; other columns of the input are kept as they are, and where one has
the name of a parsed column, the parsed one takes its place.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats.
TAGS = ("NOUN", "VERB", "ADJ", "PRON", "PRP", "CONJ", "ADV", "DEF", "PART", "X_ENG")
_TENSE_PERSON = r"-(?:PERF|MPERF|IMP)-(?:1S|2S|3SM|3SF|1P|2P|3P)(?:-N)?"
RAW_TAG = rf"^(?:[TQS]-\p{{L}}+-F(?:[1-9]|10)|AS-\p{{L}}+){_TENSE_PERSON}\z"
LINE_NUMBER = r"^[1-9][0-9]{0,8}\z"
_FIELD = r'(?:"(?:[^"]|"")*+"|[^",]*+)'
QUOTED_LINE = rf"(?s)^{_FIELD}(?:,{_FIELD})*+\z"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
WEB = r"(?i)https?:|www\."

Rules = list[tuple[str, Column]]


def with_errors(df: DataFrame, rules: Rules) -> DataFrame:
    """``df`` with ``errors``: the names of the rules that a row breaks, in the order given."""
    return _once(df, "errors", F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules]), lambda e: e.isNotNull()))


def loaded(parsed: DataFrame, typed: dict[str, Column]) -> DataFrame:
    """Rows without an error, with the columns ``typed``."""
    return parsed.where(F.size("errors") == 0).withColumns(typed).drop("errors")


def rejected(parsed: DataFrame) -> DataFrame:
    """Rows with an error and ``reason``, the first that applies."""
    return parsed.where(F.size("errors") > 0).withColumn("reason", F.element_at("errors", 1))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed where it stands: filters on it aren't pushed below, which would compute it again."""
    return df.withColumn(name, F.explode(F.array(value)))


def _blank(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES)) == ""


def _stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def verb_raw(df: DataFrame, line: str = "line") -> DataFrame:
    """Comma-separated verb records: line_number, word, raw_tag and gloss as text, with errors."""
    text = F.coalesce(F.col(line), F.lit(""))
    fields = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(rf"(?s),({_FIELD})"), F.lit(1)),
        lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.greatest(F.char_length(f) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(f),
    )
    out = _once(df, "_fields", fields).withColumns({n: F.get("_fields", F.lit(i)) for i, n in enumerate(("line_number", "word", "raw_tag", "gloss"))})
    value = ~F.col("line_number").rlike(LINE_NUMBER) | _blank(F.col("word")) | ~F.col("raw_tag").rlike(RAW_TAG)
    return with_errors(out, [("quoting", ~text.rlike(QUOTED_LINE)), ("columns", F.size("_fields") != 4), ("value", value)]).drop("_fields")


def load_verb_raw(df: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Typed verb records and the rows set aside."""
    parsed = verb_raw(df, line)
    parts = F.split(F.regexp_replace("raw_tag", "-N$", ""), "-")
    typed = {
        "line_number": F.col("line_number").cast("int"),
        "tag_prefix": F.get(parts, F.lit(0)),
        "root": F.get(parts, F.lit(1)),
        "form_class": F.when(F.get(parts, F.lit(0)) == "AS", F.lit("S")).otherwise(F.get(parts, F.lit(2))),
        "tense": F.get(parts, F.size(parts) - 2),
        "person": F.get(parts, F.size(parts) - 1),
        "negative": F.col("raw_tag").endswith("-N"),
    }
    return loaded(parsed, typed), rejected(parsed)


def corpus_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Vertical corpus lines without their marks: surface, tag, lemma and root, with errors."""
    rows = df.where(F.col(line).isNotNull() & ~_blank(F.col(line)) & ~F.col(line).rlike(r"^[#<]"))
    out = _once(rows, "_fields", F.split(line, r"\|", -1)).withColumns({n: _stripped(F.get("_fields", F.lit(i))) for i, n in enumerate(("surface", "tag", "lemma", "root"))})
    length, surface = F.char_length("surface"), F.col("surface")
    value = (length < 1) | (length > 80) | ~surface.rlike(r"\p{L}") | surface.rlike(rf"\p{{Nd}}|<|{WEB}") | ~F.col("tag").isin(*TAGS) | (F.col("lemma") == "")
    return with_errors(out, [("columns", F.size("_fields") != 4), ("value", value)]).drop("_fields")


def load_corpus_lines(df: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Corpus tokens (an empty root as null) and the rows set aside."""
    parsed = corpus_lines(df, line)
    return loaded(parsed, {"root": F.when(F.col("root") != "", F.col("root"))}), rejected(parsed)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _judge(text: str | None) -> tuple[str | None, str | None]:
    """(reason, malformed_rows as text) of one record."""
    if text is None:
        return "quoting", None
    try:
        record = json.loads(text, parse_constant=_no_constant, parse_int=lambda digits: ("int", digits))
    except (ValueError, RecursionError):
        return "quoting", None
    stats = record.get("stats") if isinstance(record, dict) else None
    if not isinstance(stats, dict) or "malformed_rows" not in stats:
        return "columns", None
    rows = stats["malformed_rows"]
    if not isinstance(rows, tuple) or (rows[1].startswith("-") and rows[1].strip("-0")):
        return "value", None
    return None, rows[1].lstrip("-")


def _json_udf() -> Callable[[Column], Column]:
    @F.pandas_udf("reason string, malformed_rows string")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_judge(t) for t in texts], columns=["reason", "malformed_rows"], dtype=object)

    return judge


def corpus_meta(df: DataFrame, text: str = "meta_json") -> DataFrame:
    """JSON records of index builds: malformed_rows as text, with errors."""
    out = df.withColumn("_judged", _json_udf()(F.col(text))).withColumn("malformed_rows", F.col("_judged.malformed_rows"))
    return with_errors(out, [(reason, F.coalesce(F.col("_judged.reason") == reason, F.lit(False))) for reason in ("quoting", "columns", "value")]).drop("_judged")


def load_corpus_meta(df: DataFrame, text: str = "meta_json") -> tuple[DataFrame, DataFrame]:
    """Records of index builds with typed counts, and the rows set aside; counts beyond 64 bits are null."""
    parsed = corpus_meta(df, text)
    stats = "stats struct<total_tokens bigint, total_sentences bigint, vocab_size bigint, bigram_count bigint, trigram_count bigint, valid_rows bigint>"
    typed = {"meta": F.from_json(text, f"corpus_name string, corpus_revision string, preprocessing_version string, build_date string, min_freq bigint, {stats}"), "malformed_rows": F.expr("try_cast(malformed_rows as bigint)")}
    return loaded(parsed, typed), rejected(parsed)


def found(verb: DataFrame, lines: DataFrame, meta: DataFrame) -> DataFrame:
    """(table_name, row_id, reason) of every row set aside."""
    parts = [(name, rejected(parsed)) for name, parsed in (("verb_raw", verb_raw(verb)), ("corpus_lines", corpus_lines(lines)), ("corpus_meta", corpus_meta(meta)))]
    every = [rows.select(F.lit(name).alias("table_name"), "row_id", "reason") for name, rows in parts]
    return every[0].unionByName(every[1]).unionByName(every[2])
