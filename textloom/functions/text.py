"""Scalar text functions as column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the orthography.
VOWELS = "aeiouàèìòù"
GRAVE = {"a": "à", "e": "è", "i": "ì", "o": "ò", "u": "ù"}
APOSTROPHES = "’ʼ‘"
_MARKS = {"̇": ("cgzCGZ", "ċġżĊĠŻ"), "̀": ("aeiouAEIOU", "àèìòùÀÈÌÒÙ"), "́": ("eE", "éÉ")}
_COMPOSED = {letter + mark: whole for mark, (letters, wholes) in _MARKS.items() for letter, whole in zip(letters, wholes)}


def composed(text: Column) -> Column:
    """The letters of the alphabet in composed form, where a combining mark follows."""
    out = text
    for pair, letter in _COMPOSED.items():
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return F.when(text.rlike(r"[\x{300}\x{301}\x{307}]"), out).otherwise(text)


def exact_key(text: Column) -> Column:
    """Composed, trimmed, with plain apostrophes; letters keep their case (STR-1)."""
    return F.btrim(F.translate(composed(text), APOSTROPHES, "'" * len(APOSTROPHES)))


def key(text: Column) -> Column:
    """``exact_key`` in small letters: the key of all lexicon joins (STR-1)."""
    return F.lower(exact_key(text))


def clean_meaning(text: Column) -> Column:
    """Blanks collapsed, outer blanks and ``:;,`` removed (STR-2)."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" \t\r\n:;,"))


def clean_cell(text: Column) -> Column:
    """Text of a table cell: entities resolved, soft hyphens gone, hyphens and blanks plain (STR-2)."""
    out = text
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    out = F.translate(out, " ‐‑­", " --")
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def graphemes(word: Column) -> Column:
    """Letters of a word, with għ as one (STR-3)."""
    return F.regexp_extract_all(word, F.lit("għ|(?s:.)"), F.lit(0))


def is_vowel(grapheme: Column) -> Column:
    return grapheme.rlike(f"^[{VOWELS}]$")


def is_consonant(grapheme: Column) -> Column:
    """A letter that is no vowel (STR-4)."""
    return grapheme.rlike(rf"^(?:għ|[\p{{L}}&&[^{VOWELS}]])$")


def anchor(word: Column) -> Column:
    """Consonant skeleton with adjacent repeats collapsed: the blocking key of similarity joins (STR-5)."""
    consonants = F.filter(graphemes(word), is_consonant)
    return F.array_join(F.filter(consonants, lambda c, i: (i == 0) | (c != F.get(consonants, i - 1))), "")


def radicals(root: Column) -> Column:
    return F.filter(graphemes(key(root)), lambda g: g.rlike(r"^(?:għ|\p{L})$"))


def radical(root: Column, n: int) -> Column:
    """The n-th radical of a root, or null (STR-6)."""
    return F.get(radicals(root), F.lit(n - 1))


def collapse_triples(word: Column) -> Column:
    """Runs of exactly three equal consonants become two, from left to right (STR-8)."""
    return F.regexp_replace(word, r"([bċdfġghħjklmnpqrstvwxżzc])\1\1", "$1$1")


def ascii_key(text: Column) -> Column:
    """Small letters without their diacritics (STR-9)."""
    return F.translate(F.replace(F.lower(text), F.lit("għ"), F.lit("gh")), "ġħċż", "ghcz")


def without_article(name: Column) -> Column:
    """A name without the article before it (STR-10)."""
    return F.regexp_replace(name, r"(?i)^(?:l|il|i[cċdgnrstxzż])-", "")


def log_time(ts: Column) -> Column:
    """``DD/Month/YYYY HH:MM:SS`` (STR-11)."""
    return F.date_format(ts, "dd/MMMM/yyyy HH:mm:ss")


def parse_log_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("dd/MMMM/yyyy HH:mm:ss"))


def notes(tokens: Column) -> Column:
    """Suggestion lines of tokens(original, choices, unrecognized) and the words that weren't recognised (STR-12)."""
    offered = F.filter(tokens, lambda t: F.size(t["choices"]) > 0)
    lines = F.transform(offered, lambda t: F.concat(t["original"], F.lit(" - suggestions: "), F.array_join(F.array_distinct(t["choices"]), ", "), F.lit(".")))
    missing = F.array_distinct(F.transform(F.filter(tokens, lambda t: t["unrecognized"]), lambda t: t["original"]))
    tail = F.when(F.size(missing) > 0, F.array(F.concat(F.lit("Unrecognized words: "), F.array_join(missing, ", "), F.lit(".")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array_distinct(lines), tail), "\n")


def surface(line: Column) -> Column:
    """What stands before the first slash of a dictionary line, or null where it has none (STR-13)."""
    return F.when(line.contains("/"), F.btrim(F.split_part(line, F.lit("/"), F.lit(1))))


def payload(line: Column) -> Column:
    """What stands after the first slash (STR-13)."""
    return F.when(line.contains("/"), F.btrim(F.get(F.split(line, "/", 2), F.lit(1))))


def replace_nth(text: Column, source: Column, target: Column, occurrence: Column) -> Column:
    """The n-th occurrence of a word (from 1, by its key) replaced; a capital at its start is kept (STR-20)."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}'’-]+"), F.lit(0))
    gaps = F.split(text, r"[\p{L}\p{M}'’-]+", -1)
    at = F.filter(F.transform(words, lambda w, i: F.when(key(w) == key(source), i)), lambda i: i.isNotNull())
    place = F.get(at, occurrence - 1)
    cased = lambda w: F.when(F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)), F.concat(F.upper(F.substring(target, 1, 1)), F.expr("''"), F.substring(target, F.lit(2), F.length(target)))).otherwise(target)
    pieces = F.transform(words, lambda w, i: F.concat(F.get(gaps, i), F.when(i == place, cased(w)).otherwise(w)))
    return F.when(place.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), F.get(gaps, F.size(words))))


def log_line(**fields: Column) -> Column:
    """``name=value`` pairs without the null ones (STR-21)."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in fields.items()])


def superlative(meaning: Column) -> Column:
    """English comparatives of a comma list as superlatives; empty where none is one (STR-22)."""
    irregular = {"better": "best", "worse": "worst", "more": "most", "less": "least", "further": "furthest", "farther": "farthest"}
    parts = F.filter(F.transform(F.split(meaning, ","), lambda p: F.btrim(p)), lambda p: p != "")

    def one(p: Column) -> Column:
        out = F.when(p.rlike(r"^more "), F.regexp_replace(p, r"^more ", "most "))
        for k, v in irregular.items():
            out = out.when(p == k, F.lit(v))
        return out.when(p.rlike(r"^\p{L}{2,}er$"), F.regexp_replace(p, r"er$", "est"))

    return F.array_join(F.filter(F.transform(parts, one), lambda p: p.isNotNull()), ", ")


def sanitized(text: Column) -> Column:
    """An apostrophe before what a spreadsheet would take for a formula (SNK-8)."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), text)).otherwise(text)
