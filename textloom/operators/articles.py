"""Articles and prepositions before nouns (WIN-14 to WIN-18, FLT-4) as column expressions over neighbouring tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import VOWELS, ascii_key, key
from textloom.operators.grammar import first_of_overlapping

#: Letters that the article takes on, and the prepositions with their form before such a letter and a vowel.
SUN = "ċdnrstxżz"
ARTICLE_FORMS = ("il", "l", "ic", "iċ", "id", "in", "ir", "is", "it", "ix", "iz", "iż")
PREPOSITIONS = {"tal": ("ta", "tal"), "mal": ("ma", "mal"), "bħall": ("bħa", "bħall"), "bil": ("bi", "bl"), "fil": ("fi", "fl"), "mill": ("mi", "mill"), "għall": ("għa", "għall"), "sal": ("sa", "sal"), "lill": ("li", "lill"), "ġol": ("ġo", "ġol"), "għat": ("għa", "għat"), "dal": ("da", "dal"), "dil": ("di", "dil")}
APART = {"ta": "tal", "ta'": "tal", "ma": "mal", "ma'": "mal", "bħal": "bħall", "bhal": "bħall", "bi": "bil", "fi": "fil", "lil": "lill", "għal": "għall", "ghal": "għall", "sa": "sal", "minn": "mill", "min": "mill"}
#: Families whose assimilated forms are words of their own (dan, dar, din), so that only the full form is taken for them.
WORDS_ALIKE = ("dal", "dil")
FUSED = ("x", "b", "f", "t", "m", "l")
_VOWEL = f"[{VOWELS}]"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def ends_in_vowel(previous: Column) -> Column:
    """Whether a word before the article ends in a vowel, an apostrophe or hyphen left aside (FLT-4)."""
    return F.coalesce(key(previous).rlike(f"{_VOWEL}'?-*$"), F.lit(False))


def needs_i(noun: Column) -> Column:
    """Whether the article asks for an i before the noun: m or s before a consonant (FLT-4)."""
    return F.coalesce(key(noun).rlike(rf"^[ms](?!{_VOWEL})."), F.lit(False))


def opens_softly(noun: Column) -> Column:
    """Whether a noun begins with a vowel, għ or h (FLT-4)."""
    return F.coalesce(key(noun).rlike(f"^(?:{_VOWEL}|għ|gh|h)"), F.lit(False))


def article(noun: Column, previous: Column | None = None, typed: Column | None = None) -> Column:
    """The article before a noun, with its hyphen (WIN-16)."""
    first = F.substring(key(noun), 1, 1)
    soft = F.lit(False) if previous is None else ends_in_vowel(previous)
    bare = F.when(soft | (F.lit(False) if typed is None else F.coalesce(key(typed) == "l", F.lit(False))) | opens_softly(noun), "l-").otherwise("il-")
    return F.when(first.isin(*SUN), F.concat(F.when(soft, "").otherwise("i"), first, F.lit("-"))).otherwise(bare)


def definite(noun: Column, previous: Column | None = None, typed: Column | None = None) -> Column:
    """Article and noun (WIN-16)."""
    return F.when(needs_i(noun), F.concat(F.lit("l-i"), noun)).otherwise(F.concat(article(noun, previous, typed), noun))


def canonical_preposition(prefix: Column) -> Column:
    """The dictionary form of a typed preposition with article, however its last letter was assimilated, or null (WIN-16)."""
    bare = F.regexp_replace(ascii_key(key(prefix)), "-+$", "")
    out = F.lit(None).cast("string")
    for name, (stem, soft) in reversed(PREPOSITIONS.items()):
        s, full = stem.replace("għ", "gh").replace("ħ", "h"), name.replace("għ", "gh").replace("ħ", "h")
        assimilated = bare.rlike(rf"^{s}([cdnrstxz])\1?$") & F.lit(name not in WORDS_ALIKE)
        out = F.when(bare.isin(full, soft) | assimilated | (bare == full.rstrip("l") + "l"), name).otherwise(out)
    return out


def preposition(canonical: Column, noun: Column) -> Column:
    """Preposition with article and noun (WIN-16)."""
    first = F.substring(key(noun), 1, 1)
    stem = F.try_element_at(_map({k: v[0] for k, v in PREPOSITIONS.items()}), canonical)
    soft = F.try_element_at(_map({k: v[1] for k, v in PREPOSITIONS.items()}), canonical)
    return F.when(opens_softly(noun), F.concat(soft, F.lit("-"), noun)).when(first.isin(*SUN), F.concat(stem, first, F.lit("-"), noun)).otherwise(F.concat(canonical, F.lit("-"), noun))


def choices(word: Column, meaning: Column) -> Column:
    """A word and its meaning as a list of choices (WIN-17)."""
    return F.array(F.struct(word.alias("word"), F.when(meaning != "", F.concat(F.lit("the "), meaning)).otherwise("the").alias("meaning")))


def phrases(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, pos, used, original, corrected): articles and prepositions typed apart from their noun (WIN-14).

    targets(word) are the nouns, numerals, places and adjectives that take an article. Matches are greedy from the left:
    of two that overlap the first counts.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    known = targets.select(key(F.col("word")).alias("norm"), F.lit(True).alias("target")).distinct()
    rows = tokens.withColumn("norm", F.regexp_replace(key(F.col("word")), "-+$", "")).join(known, "norm", "left")
    rows = rows.withColumns({f"{c}{k}": F.lead(c, k).over(w) for c in ("word", "norm", "target") for k in (1, 2)}).withColumn("before", F.lag("word").over(w))
    is_article = F.col("norm").isin(*ARTICLE_FORMS)
    prefix = F.coalesce(canonical_preposition(F.col("norm")), F.lit(None))
    apart = F.try_element_at(_map(APART), F.col("norm"))
    three = apart.isNotNull() & F.col("norm1").isin(*ARTICLE_FORMS) & F.col("target2")
    two = F.col("target1") & (is_article | prefix.isNotNull())
    corrected = F.when(three, preposition(apart, F.col("norm2"))).when(two & is_article, definite(F.col("norm1"), F.col("before"), F.col("norm"))).when(two, preposition(prefix, F.col("norm1")))
    hits = rows.withColumn("corrected", corrected).withColumn("used", F.when(three, 3).otherwise(2)).where("corrected is not null")
    hits = hits.withColumn("original", F.concat_ws(" ", "word", "word1", F.when(F.col("used") == 3, F.col("word2"))))
    spans = hits.select("doc_id", "pos", (F.col("pos") + F.col("used")).alias("to"), "used", "original", "corrected")
    return first_of_overlapping(spans, start="pos", end="to").drop("to")


def hyphenated(words: DataFrame, targets: DataFrame) -> DataFrame:
    """(word, corrected): article or preposition joined to a noun by a hyphen, or without one (WIN-15)."""
    known = targets.select(key(F.col("word")).alias("noun")).distinct()
    rows = words.select(key(F.col("word")).alias("word")).where("word <> ''").distinct()
    split = rows.where(F.col("word").contains("-")).select("word", F.split_part("word", F.lit("-"), F.lit(1)).alias("prefix"), F.get(F.split("word", "-", 2), F.lit(1)).alias("noun"))
    heads = sorted({*PREPOSITIONS, *(soft for _, soft in PREPOSITIONS.values()), *ARTICLE_FORMS, "miss", "mis", "mid"}, key=len, reverse=True)
    compact = rows.where(~F.col("word").rlike("[-']")).select("word", F.explode(F.array(*[F.when(F.col("word").startswith(h), F.struct(F.lit(h).alias("prefix"), F.expr(f"substring(word, {len(h) + 1})").alias("noun"))) for h in heads])).alias("x")).where("x is not null").select("word", "x.*")
    compact = compact.where((F.col("noun") != "") & (~F.col("prefix").isin(*ARTICLE_FORMS) | needs_i(F.col("noun"))))
    both = split.withColumn("way", F.lit(1)).unionByName(compact.withColumn("way", F.lit(2))).join(known, "noun", "left_semi")
    canonical = canonical_preposition(F.col("prefix"))
    corrected = F.when(F.col("prefix").isin(*ARTICLE_FORMS) | F.col("prefix").rlike(f"^i?[{SUN}]$"), definite(F.col("noun"), None, F.col("prefix"))).when(canonical.isNotNull(), preposition(canonical, F.col("noun")))
    fixed = both.withColumn("corrected", corrected).where("corrected is not null")
    return fixed.groupBy("word").agg(F.min(F.struct("way", (-F.length("prefix")).alias("l"), "corrected")).alias("b")).select("word", F.col("b.corrected").alias("corrected"))


def fused(words: DataFrame, verbs: DataFrame, nouns: DataFrame) -> DataFrame:
    """(word, corrected): a short preposition fused with the word after it (WIN-18).

    A verb keeps only x before it (x'); nouns take any of them with an apostrophe before vowels and għ, else xi, bi, fi.
    """
    rows = words.select(key(F.col("word")).alias("word")).where("word <> ''").distinct()
    heads = [*FUSED, "xi", "bi", "fi"]
    split = rows.select("word", F.explode(F.array(*[F.when(F.col("word").startswith(h), F.struct(F.lit(h).alias("prefix"), F.expr(f"substring(word, {len(h) + 1})").alias("rest"))) for h in heads])).alias("x")).where("x is not null").select("word", "x.*").where(F.length("rest") >= 3)
    known = rows.join(nouns.select(key(F.col("word")).alias("word")).distinct(), "word", "left_semi")
    split = split.join(known, "word", "left_anti")  # a word of its own isn't taken apart
    is_verb = verbs.select(key(F.col("word")).alias("rest")).distinct().withColumn("kind", F.lit(1))
    is_noun = nouns.select(key(F.col("word")).alias("rest")).distinct().withColumn("kind", F.lit(2))
    hits = split.join(is_verb.unionByName(is_noun), "rest")
    soft = opens_softly(F.col("rest"))
    short = F.concat(F.substring("prefix", 1, 1), F.lit("'"), "rest")
    long = F.concat(F.when(F.length("prefix") == 2, F.col("prefix")).otherwise(F.concat("prefix", F.lit("i"))), F.lit(" "), "rest")
    corrected = F.when((F.col("kind") == 1) & (F.col("prefix") == "x"), short).when((F.col("kind") == 2) & soft, short).when((F.col("kind") == 2) & F.col("prefix").isin("x", "b", "f", "xi", "bi", "fi"), long)
    return hits.withColumn("corrected", corrected).where("corrected is not null").groupBy("word").agg(F.min(F.struct("kind", (-F.length("prefix")).alias("l"), "corrected")).alias("b")).select("word", F.col("b.corrected").alias("corrected"))
