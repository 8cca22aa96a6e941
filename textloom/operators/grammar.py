"""Positional grammar rules over tokens (WIN-1 to WIN-12) by window functions.

tokens(doc_id, pos, word) meet lexicon features once, by an equi-join on the word; all rules then read neighbours in one
window over a text. Texts are the partitions, so that a text is the largest group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import key

#: Words of the rules.
ARTICLES = ("il", "l", "id", "din", "dan", "ic", "iċ", "in", "ir", "is", "it", "ix", "iz", "iż")
BOUNDARIES = ("ax", "għax", "ghax", "għaliex", "ghaliex", "li", "jekk", "meta", "imma", "pero", "però", "u", "jew", "biex", "mela")
INTENSIFIERS = ("hafna", "naqra", "iktar", "inqas", "anqas")
CONFUSABLE = ("hu", "u", "ħu")
PREDICATIVE_ROOTS = ("kbr", "sjr", "qwm", "kwn", "rqd", "mwt")
PRONOUNS = {"jien": "1S", "int": "2S", "inti": "2S", "hu": "3SM", "hi": "3SF", "aħna": "1P", "ahna": "1P", "intom": "2P", "huma": "3P"}
NUMERALS = ("wieħed", "waħda", "żewġ", "tnejn", "tlieta", "erbgħa", "ħamsa", "ħams", "sitta", "sitt", "sebgħa", "seba", "tmienja", "tmien", "disgħa", "disgħ", "għaxra", "għoxrin")
FEATURES = {"is_noun": "boolean", "is_adjective": "boolean", "is_numeral": "boolean", "is_verb": "boolean", "noun_gender": "string", "noun_number": "string", "adjective_gender": "string", "adjective_number": "string", "persons": "array<string>", "perf": "boolean", "mperf": "boolean", "person": "string", "is_place": "boolean", "comparative": "boolean", "predicative": "boolean", "lasting": "boolean"}


def tokenize(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, pos, word) of whole texts."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_column), F.lit("")), F.lit(r"[\p{L}\p{M}'’]+"), F.lit(0))
    return df.select(F.col(id_column).alias("doc_id"), F.posexplode(words).alias("pos", "word"))


def featured(tokens: DataFrame, features: DataFrame) -> DataFrame:
    """Tokens with ``norm`` and all features; words that the lexicon lacks have none."""
    for name, kind in FEATURES.items():
        if name not in features.columns:
            features = features.withColumn(name, F.lit(None).cast(kind))
    known = features.select(F.col("word").alias("norm"), *FEATURES)
    rows = tokens.withColumn("norm", key(F.col("word"))).join(known, "norm", "left")
    flags = {n: F.coalesce(n, F.lit(False)) for n, k in FEATURES.items() if k == "boolean"}
    rows = rows.withColumns(flags)
    return rows.withColumn("is_adjective", F.col("is_adjective") | F.col("norm").isin(*INTENSIFIERS))


#: A rule: when it applies to a token with its neighbours, and the finding.
Rule = tuple[Column, Column]


def _span(rule: str, low: Column | int, high: Column | int, surface: Column, suggestions: Column | None, note: str, suggestion: Column | None = None, need: tuple[str, Column, Column, Column] | None = None) -> Column:
    """A finding from ``pos + low`` to before ``pos + high``; ``need`` (kind, word, wanted, text before) asks for a variant as its suggestion."""
    suggestions = F.expr("cast(array() as array<string>)") if suggestions is None else suggestions
    kind, word, wanted, before = need or (None, None, None, None)
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(
        F.lit(rule).alias("rule_id"),
        (F.col("pos") + low).cast("int").alias("start"),
        (F.col("pos") + high).cast("int").alias("end"),
        surface.alias("surface"),
        (F.get(suggestions, F.lit(0)) if suggestion is None else suggestion).alias("suggestion"),
        suggestions.alias("suggestions"),
        F.lit(note).alias("note"),
        F.lit(kind).cast("string").alias("need"),
        text(word).alias("need_word"),
        text(wanted).alias("wanted"),
        text(before).alias("before"),
    )


FOUND = ("doc_id", "rule_id", "start", "end", "surface", "suggestion", "suggestions", "note")
#: Findings that count without a variant, too.
_ANYHOW = ("adjective_gender", "adjective_number")


def _find(rows: DataFrame, rules: list[Rule], variants: dict[str, DataFrame | None] | None = None) -> DataFrame:
    """Findings of all ``rules`` in one pass over the tokens; variants(word, wanted, variant) by kind are joined once."""
    made = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), span) for when, span in rules]))
    found = rows.select("doc_id", F.explode(made).alias("f")).select("doc_id", "f.*")
    known = [df.select(F.lit(kind).alias("need"), F.col("word").alias("need_word"), "wanted", "variant") for kind, df in (variants or {}).items() if df is not None]
    if not known:
        return found.where(F.col("need").isNull() | F.col("need").isin(*_ANYHOW)).select(*FOUND)
    found = found.join(reduce(DataFrame.unionByName, known), ["need", "need_word", "wanted"], "left")
    found = found.where(F.col("need").isNull() | F.col("variant").isNotNull() | F.col("need").isin(*_ANYHOW))
    whole = F.concat("before", "variant")
    given = F.col("variant").isNotNull()
    return found.withColumns({"suggestion": F.when(given, whole).otherwise(F.col("suggestion")), "suggestions": F.when(given, F.array(whole)).otherwise(F.col("suggestions"))}).select(*FOUND)


def with_neighbours(rows: DataFrame) -> DataFrame:
    """Each token with the next one, the one before, and what the longer frames hold."""
    text = Window.partitionBy("doc_id").orderBy("pos")
    nexts = {f"n_{c}": F.lead(c).over(text) for c in ("word", "norm", *FEATURES)}
    last = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, 4)
    back = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-5, -1)
    candidate = F.when(F.col("norm").isin(*BOUNDARIES), F.struct("pos", F.lit(None).cast("string").alias("person"), "word")).when(~F.col("norm").isin(*ARTICLES) & F.col("person").isNotNull() & ~F.col("is_verb"), F.struct("pos", "person", "word"))
    rows = rows.withColumns(nexts).withColumns({"p_norm": F.lag("norm").over(text), "p_word": F.lag("word").over(text), "x_ahead": F.max(F.col("norm").endswith("x")).over(last), "length": F.count("*").over(Window.partitionBy("doc_id"))})
    return rows.withColumn("candidate", candidate).withColumn("subject", F.last("candidate", ignorenulls=True).over(back)).withColumn("between", F.collect_list("word").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-5, -1)))


def _two(a: str = "word", b: str = "n_word") -> Column:
    return F.concat_ws(" ", a, b)


def _by_person(variants: DataFrame | None) -> dict[str, DataFrame | None]:
    return {"person": None if variants is None else variants.select("word", F.col("person").alias("wanted"), "variant")}


def _subject_verb() -> Rule:
    target = F.col("subject.person")
    when = F.col("is_verb") & ~F.col("is_noun") & (F.size("persons") > 0) & target.isNotNull() & ~F.array_contains("persons", target)
    distance = (F.col("pos") - F.col("subject.pos")).cast("int")
    words = F.slice("between", F.greatest(F.size("between") - distance + 1, F.lit(1)), F.greatest(distance, F.lit(0)))
    before = F.concat(F.array_join(words, " "), F.lit(" "))
    return when, _span("SUBJECT_VERB_PERSON_NUMBER", -distance, 1, F.concat(before, "word"), None, "the subject before it has another person", need=("person", F.col("norm"), target, before))


def subject_verb(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """A finite verb whose nearest subject within five words has another person (WIN-1)."""
    return _find(rows, [_subject_verb()], _by_person(variants))


def _verb_chain() -> Rule:
    target = F.get("persons", F.lit(0))
    when = F.col("perf") & F.col("n_mperf") & (F.size("persons") == 1) & ~F.array_contains("n_persons", target)
    return when, _span("VERB_VERB_PERSON_NUMBER", 0, 2, _two(), None, "adjacent finite verbs share their subject", need=("person", F.col("n_norm"), target, F.concat("word", F.lit(" "))))


def verb_chain(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """A perfect verb before an imperfect one of another person (WIN-2)."""
    return _find(rows, [_verb_chain()], _by_person(variants))


def _definite_phrase() -> Rule:
    when = F.col("p_norm").isin(*ARTICLES) & F.col("is_noun") & F.col("n_is_adjective") & ~F.col("n_norm").rlike("^(?:l-|il-|l')")
    article = F.concat("p_word", F.lit("-"))
    return when, _span("DEF_NP_ARTICLE_PROPAGATION", -1, 2, F.concat_ws(" ", "p_word", "word", "n_word"), F.array(F.concat(article, "word", F.lit(" "), article, "n_word")), "the adjective takes the article too")


def definite_phrase(rows: DataFrame) -> DataFrame:
    """Article, noun and an adjective without the article (WIN-3, FLT-9)."""
    return _find(rows, [_definite_phrase()])


def _mismatch(rule: str, noun: str, adjective: str) -> Rule:
    when = F.col("is_noun") & F.col("n_is_adjective") & F.col(noun).isNotNull() & F.col(f"n_{adjective}").isNotNull() & (F.col(noun) != F.col(f"n_{adjective}"))
    return when, _span(rule, 0, 2, _two(), None, "noun and adjective disagree", need=(adjective, F.col("n_norm"), F.col(noun), F.concat("word", F.lit(" "))))


def _agreement() -> list[Rule]:
    return [_mismatch("AMOD_GENDER_AGREEMENT", "noun_gender", "adjective_gender"), _mismatch("AMOD_NUMBER_AGREEMENT", "noun_number", "adjective_number")]


def agreement(rows: DataFrame, by_gender: DataFrame | None = None, by_number: DataFrame | None = None) -> DataFrame:
    """Noun and adjective of different gender or number (WIN-4); variants(word, wanted, variant) give the right form."""
    return _find(rows, _agreement(), {"adjective_gender": by_gender, "adjective_number": by_number})


def adjective_variants(features: DataFrame, anchors: DataFrame, meanings: DataFrame | None = None, wanted: str = "adjective_gender") -> DataFrame:
    """(word, wanted, variant): the best adjective of the same consonants with the wanted feature (JOIN-4)."""
    rows = features.where("is_adjective").select("word", "adjective_gender", "adjective_number").join(anchors, "word")
    if meanings is None:
        rows = rows.withColumn("meanings", F.array().cast("array<string>"))
    else:
        rows = rows.join(meanings, "word", "left")
    other = rows.select("anchor", F.col("word").alias("variant"), F.col(wanted).alias("wanted"), F.col("meanings").alias("m2"))
    pairs = rows.select("anchor", "word", F.col("meanings").alias("m1")).join(other, "anchor").where("word <> variant and wanted is not null")
    shares = F.when(F.coalesce(F.arrays_overlap("m1", "m2"), F.lit(False)), 0).otherwise(1)
    return pairs.groupBy("word", "wanted").agg(F.min(F.struct(shares.alias("s"), "variant")).alias("b")).select("word", "wanted", F.col("b.variant").alias("variant"))


def _order() -> Rule:
    when = F.col("is_adjective") & F.col("n_is_noun")
    swapped = F.concat_ws(" ", "n_word", "word")
    return when, _span("AMOD_ORDER_NOUN_BEFORE_ADJ", 0, 2, _two(), F.array(swapped, _two()), "the adjective follows its noun")


def order(rows: DataFrame) -> DataFrame:
    """An adjective before its noun (WIN-4)."""
    return _find(rows, [_order()])


def _min_minn() -> Rule:
    name = F.coalesce(F.col("n_is_place"), F.lit(False)) | F.coalesce(F.col("n_word").rlike(r"^\p{Lu}"), F.lit(False))
    ranked = F.when(name, F.array(F.lit("minn"), F.lit("min"))).otherwise(F.array(F.lit("min"), F.lit("minn")))
    return F.col("norm") == "min", _span("MIN_MINN_CONTEXT", 0, 1, F.col("word"), ranked, "a name or place after it speaks for minn")


def min_minn(rows: DataFrame) -> DataFrame:
    """min and minn ranked by the next word (WIN-5)."""
    return _find(rows, [_min_minn()])


def _confusables() -> Rule:
    when = F.col("norm").isin(*CONFUSABLE)
    all_of = F.array(*[F.lit(w) for w in CONFUSABLE])
    return when, _span("HU_U_HU_CONFUSABLE", 0, 1, F.col("word"), F.concat(F.array("norm"), F.filter(all_of, lambda w: w != F.col("norm"))), "these are easily confused")


def confusables(rows: DataFrame) -> DataFrame:
    """hu, u and ħu with the typed one first (WIN-6)."""
    return _find(rows, [_confusables()])


def _negation() -> Rule:
    when = ((F.col("norm") == "ma") & F.col("x_ahead"))
    high = F.least(F.col("length"), F.col("pos") + 5) - F.col("pos")
    return when, _span("NEGATION_MA_X", 0, high, F.col("word"), F.array(F.lit("ma"), F.lit("x")), "both parts of the negation are there", suggestion=F.lit("ma ... x"))


def negation(rows: DataFrame) -> DataFrame:
    """ma with a word in -x among the next four (WIN-7)."""
    return _find(rows, [_negation()])


def _numerals() -> Rule:
    when = F.col("is_numeral") & F.col("n_is_noun")
    singular = F.col("norm").endswith("t") | F.col("norm").isin("ħamest", "għoxrin")
    return when, _span("NUMERAL_NOUN_NUMBER", 0, 2, _two(), F.array(F.when(singular, "singular").otherwise("plural_or_paucal")), "the numeral asks for this number")


def numerals(rows: DataFrame) -> DataFrame:
    """A numeral and its noun with the number that it asks for (WIN-8)."""
    return _find(rows, [_numerals()])


def allows_adjective(root: Column, form_class: Column) -> Column:
    """What a verb record says of an adjective after it: "all" are allowed, "lasting" allows two, null decides nothing (WIN-9)."""
    first = (form_class == "F1") & (root.isin(*PREDICATIVE_ROOTS) | ((F.char_length(root) == 3) & (root != "rjq")))
    return F.when(root == "dwm", "lasting").when(first | ((root == "wld") & form_class.startswith("F6")), "all")


def _verb_adjective() -> Rule:
    when = F.col("is_verb") & ~F.col("is_noun") & F.col("n_is_adjective") & ~F.col("predicative") & ~(F.col("lasting") & F.col("n_norm").isin("itwal", "iqsar")) & ~F.col("n_norm").isin(*INTENSIFIERS)
    return when, _span("VERB_ADJECTIVE_COMPATIBILITY", 0, 2, _two(), F.array(F.concat("word", F.lit(" u jsir "), "n_word")), "the verb takes no adjective")


def verb_adjective(rows: DataFrame) -> DataFrame:
    """A verb that takes no adjective before one (WIN-9)."""
    return _find(rows, [_verb_adjective()])


def _li_adjective() -> Rule:
    when = ((F.col("norm") == "li") & F.col("n_is_adjective") & ~F.col("n_comparative") & ~F.col("n_norm").isin(*INTENSIFIERS))
    return when, _span("LI_ADJECTIVE_COMPATIBILITY", 0, 2, _two(), F.array(F.concat(F.lit("l-"), "n_word")), "li introduces no ordinary adjective")


def li_adjective(rows: DataFrame) -> DataFrame:
    """li before an ordinary adjective (WIN-10)."""
    return _find(rows, [_li_adjective()])


def contractions(phrases: DataFrame) -> DataFrame:
    """Phrases typed apart that are corrected to one word, of phrases(doc_id, pos, word, corrected) (WIN-11)."""
    when = F.col("word").contains(" ") & F.col("corrected").rlike("[-']")
    return _find(phrases, [(when, _span("PREP_ARTICLE_CONTRACTION", 0, 1, F.col("word"), F.array("corrected"), "the phrase is written as one word"))])


def analyze(tokens: DataFrame, features: DataFrame, person_variants: DataFrame | None = None, by_gender: DataFrame | None = None, by_number: DataFrame | None = None) -> DataFrame:
    """Findings of all rules, texts in any order (WIN-12)."""
    rules = [_definite_phrase(), *_agreement(), _order(), _min_minn(), _confusables(), _negation(), _numerals(), _verb_adjective(), _li_adjective()]
    if person_variants is not None:
        rules += [_subject_verb(), _verb_chain()]
    return _find(with_neighbours(featured(tokens, features)), rules, _by_person(person_variants) | {"adjective_gender": by_gender, "adjective_number": by_number})


def first_of_overlapping(spans: DataFrame, key: str = "doc_id", start: str = "start", end: str = "end") -> DataFrame:
    """Of spans that overlap within a text the first counts; one that overlaps only a dropped one counts, too.

    The spans of a text are folded from the left with the end of the last one that counts.
    """
    order = [start, end, *[c for c in spans.columns if c not in (key, start, end)]]
    rows = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("every"))
    nothing = F.struct(F.lit(-1).cast("bigint").alias("last"), F.slice("every", 1, 0).alias("kept"))
    take = lambda s, x: F.struct(x[end].cast("bigint").alias("last"), F.concat(s["kept"], F.array(x)).alias("kept"))
    folded = F.aggregate("every", nothing, lambda s, x: F.when(x[start] >= s["last"], take(s, x)).otherwise(s), lambda s: s["kept"])
    return rows.select(key, F.explode(folded).alias("span")).select(key, "span.*").select(spans.columns)


def rewrite(tokens: DataFrame, findings: DataFrame, rules: tuple[str, ...] = ("VERB_VERB_PERSON_NUMBER",)) -> DataFrame:
    """Tokens with the suggestions of safe rules in the place of their spans; of spans that overlap the first counts (WIN-13)."""
    spans = findings.where(F.col("rule_id").isin(*rules) & F.col("suggestion").isNotNull()).select("doc_id", "start", "end", "suggestion")
    spans = first_of_overlapping(spans)
    new = spans.select("doc_id", F.posexplode(F.split("suggestion", " ")).alias("k", "new"), "start").select("doc_id", (F.col("start") + F.col("k")).alias("pos"), "new")
    return tokens.join(new, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("new", "word").alias("word"))
