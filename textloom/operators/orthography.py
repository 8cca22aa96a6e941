"""Spelling variants of words as table functions (GEN-1 to GEN-18).

An edit says at which letters it applies and what takes their place. All edits share one expression that walks the
letters of a word and splices the replacement in, so that a generator is a row of the table below. Variants keep the
order of their places; ``gated`` keeps those that a lexicon holds, by an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import VOWELS, graphemes, key

At = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Edit:
    """At letter i of the letters g: where it applies, from where and how many letters it takes, what it puts there.

    The SQL fields say the same for a list ``g`` and a place ``i`` from 1.
    """

    at: At
    put: At
    sql_at: str
    sql_put: str
    back: int = 0
    take: int = 1


def _g(g: Column, i: Column) -> Column:
    return F.when(i >= 0, F.get(g, i))


def _vowel(g: Column, i: Column) -> Column:
    return F.coalesce(_g(g, i).isin(*VOWELS), F.lit(False))


def _is(g: Column, i: Column, *letters: str) -> Column:
    return F.coalesce(_g(g, i).isin(*letters), F.lit(False))


def _sql_in(expression: str, letters: str | tuple[str, ...]) -> str:
    return f"coalesce({expression} in ({', '.join(repr(x) for x in letters)}), false)"


_SV = {-1: _sql_in("g[i-1]", VOWELS), 0: _sql_in("g[i]", VOWELS), 1: _sql_in("g[i+1]", VOWELS)}
_I = "(i > 1 and {})"  # g[0] is null in SQL, but g[-1] is the last letter
_PREVIOUS_VOWEL = _I.format(_SV[-1])
_single = r"^[\p{L}&&[^aeiouàèìòù]]$"
_SINGLE_SQL = rf"(length(g[i]) = 1 and regexp_full_match(g[i], '\p{{L}}') and not {_SV[0]})"


def _swap(*pairs: tuple[str, str]) -> Edit:
    """One letter of a pair for the other."""
    both = dict(pairs) | {b: a for a, b in pairs}
    cases = " ".join(f"when {k!r} then {v!r}" for k, v in both.items())
    return Edit(lambda g, i: _is(g, i, *both), lambda g, i: F.array(F.element_at(F.create_map(*[F.lit(x) for kv in both.items() for x in kv]), F.get(g, i))), _sql_in("g[i]", tuple(both)), f"[case g[i] {cases} end]")


def _insert(token: str) -> list[Edit]:
    """A letter before or after each vowel, not beside itself, and no guttural at the end of a word."""
    at_end = token not in ("h", "ħ", "għ")
    last_sql = "false" if token in ("h", "ħ", "għ") else "true"
    return [
        Edit(lambda g, i: _vowel(g, i) & ~_is(g, i - 1, token), lambda g, i: F.array(F.lit(token)), f"{_SV[0]} and not (i > 1 and {_sql_in('g[i-1]', (token,))})", f"['{token}']", 0, 0),
        Edit(lambda g, i: _vowel(g, i - 1) & ~_is(g, i, token) & (i > 0) & ((i < F.size(g)) | F.lit(at_end)), lambda g, i: F.array(F.lit(token)), f"{_PREVIOUS_VOWEL} and not {_sql_in('g[i]', (token,))} and (i <= len(g) or {last_sql})", f"['{token}']", 0, 0),
    ]


def _remove(token: str) -> list[Edit]:
    return [Edit(lambda g, i: _is(g, i, token), lambda g, i: F.array().cast("array<string>"), _sql_in("g[i]", (token,)), "[]::varchar[]")]


def _replace(letters: str, new: str) -> list[Edit]:
    return [Edit(lambda g, i: _is(g, i, letters), lambda g, i: F.array(F.lit(new)), _sql_in("g[i]", (letters,)), f"['{new}']")]


def _consonant(g: Column, i: Column) -> Column:
    return F.coalesce((i >= 0) & ~F.get(g, F.greatest(i, F.lit(0))).isin(*VOWELS), F.lit(False))


_gk = _swap(("g", "k"))
_in_gh = "((g[i] = 'g' and coalesce(g[i+1] = 'h', false)) or (g[i] = 'h' and i > 1 and coalesce(g[i-1] = 'g', false)))"
_SZ = "(i > 1 and i < len(g) and {} and {}) or coalesce(g[i+1] in ('n','m'), false)".format(_SV[-1], _SV[1])


def _sz(g: Column, i: Column) -> Column:
    return (_vowel(g, i - 1) & _vowel(g, i + 1)) | _is(g, i + 1, "n", "m")


def _shortcut(letter: str, new: str) -> Edit:
    return Edit(lambda g, i: _is(g, i, letter) & ~((_is(g, i, "g") & _is(g, i + 1, "h")) | (_is(g, i, "h") & _is(g, i - 1, "g"))), lambda g, i: F.array(F.lit(new)), f"{_sql_in('g[i]', (letter,))} and not {_in_gh}", f"['{new}']")


def _sibilant(letter: str, new: str) -> Edit:
    return Edit(lambda g, i: _is(g, i, letter) & _sz(g, i), lambda g, i: F.array(F.lit(new)), f"{_sql_in('g[i]', (letter,))} and ({_SZ})", f"['{new}']")


#: Generators as lists of edits; the edits' order is the order at one place.
EDITS: dict[str, list[Edit]] = {
    "shortcut": [_shortcut("h", "ħ"), _shortcut("c", "ċ"), _shortcut("z", "ż"), _shortcut("g", "ġ"), _sibilant("s", "ż"), _sibilant("s", "z"), _sibilant("ż", "z"), _sibilant("ż", "s")],
    "gh_left": [Edit(lambda g, i: _is(g, i, "għ") & _vowel(g, i - 1), lambda g, i: F.array(F.get(g, i), F.get(g, i - 1)), f"g[i] = 'għ' and {_PREVIOUS_VOWEL}", "[g[i], g[i-1]]", 1, 2)],
    "gh_right": [Edit(lambda g, i: _is(g, i, "għ") & _vowel(g, i + 1), lambda g, i: F.array(F.get(g, i + 1), F.get(g, i)), f"g[i] = 'għ' and {_SV[1]}", "[g[i+1], g[i]]", 0, 2)],
    "g_to_gh": _replace("g", "għ"),
    "insert_gh": _insert("għ"),
    "insert_h": _insert("h"),
    "insert_q": _insert("q"),
    "remove_gh": _remove("għ"),
    "remove_h": _remove("h"),
    "remove_q": _remove("q"),
    "undouble": [Edit(lambda g, i: F.get(g, i).rlike(_single) & F.coalesce(F.get(g, i) == F.get(g, i + 1), F.lit(False)), lambda g, i: F.array(F.get(g, i)), f"{_SINGLE_SQL} and coalesce(g[i] = g[i+1], false)", "[g[i]]", 0, 2)],
    "double": [
        Edit(
            lambda g, i: F.get(g, i).rlike(_single) & F.coalesce(F.get(g, i) != F.get(g, i + 1), F.lit(True)) & F.coalesce(_g(g, i - 1) != F.get(g, i), F.lit(True)),
            lambda g, i: F.array(F.get(g, i), F.get(g, i)),
            f"{_SINGLE_SQL} and coalesce(g[i] <> g[i+1], true) and (i = 1 or g[i-1] <> g[i])",
            "[g[i], g[i]]",
        )
    ],
    "d_to_dh": [Edit(lambda g, i: _is(g, i, "d") & (i < F.size(g) - 1) & ~_is(g, i + 1, "h"), lambda g, i: F.array(F.lit("d"), F.lit("h")), "g[i] = 'd' and i < len(g) and g[i+1] <> 'h'", "['d', 'h']")],
    "d_t": [_swap(("d", "t"))],
    "b_p": [_swap(("b", "p"))],
    "g_k": [
        Edit(
            lambda g, i: _gk.at(g, i) & (_consonant(g, i - 1) | _consonant(g, i + 1) | (i == F.size(g) - 1)),
            _gk.put,
            f"{_gk.sql_at} and ((i > 1 and not {_SV[-1]}) or i = len(g) or not {_SV[1]})",
            _gk.sql_put,
        )
    ],
    "i_ie": [
        Edit(lambda g, i: _is(g, i, "i") & _is(g, i + 1, "e"), lambda g, i: F.array(F.lit("i")), "g[i] = 'i' and coalesce(g[i+1] = 'e', false)", "['i']", 0, 2),
        Edit(lambda g, i: _is(g, i, "i") & ~_is(g, i + 1, "e"), lambda g, i: F.array(F.lit("i"), F.lit("e")), "g[i] = 'i' and not coalesce(g[i+1] = 'e', false)", "['i', 'e']"),
    ],
}

#: Endings that stand for each other: pattern, replacements in order (GEN-15 to GEN-17).
ENDINGS: dict[str, list[tuple[str, str]]] = {
    "aw_ghu": [(r"(.)aw$", "$1għu")],
    "ja_ha": [(r"ja$", "ha"), (r"ha$", "ja")],
    "gh_h_hbar": [(r"gh$", "h"), (r"gh$", "ħ"), (r"gh$", "għ"), (r"għ$", "h"), (r"għ$", "ħ"), (r"([^g])h$", "$1għ"), (r"([^g])h$", "$1ħ"), (r"([^g])ħ$", "$1għ"), (r"([^g])ħ$", "$1h")],
}


def variants(word: Column, name: str) -> Column:
    """Variants of a word (in its key form) by one generator: ordered, without repeats and without the word itself."""
    if name in ENDINGS:
        found = F.array(*[F.when(word.rlike(pattern), F.regexp_replace(word, pattern, new)) for pattern, new in ENDINGS[name]])
    else:
        g = graphemes(word)

        def at(i: Column) -> Column:
            made = []
            for e in EDITS[name]:
                spliced = F.concat(F.slice(g, F.lit(1), F.greatest(i - e.back, F.lit(0))), e.put(g, i), F.slice(g, i - e.back + e.take + 1, F.size(g) + 1))
                made.append(F.when(e.at(g, i), F.array_join(spliced, "")))
            return F.array(*made)

        found = F.flatten(F.transform(F.sequence(F.lit(0), F.size(g)), at))
    return F.array_distinct(F.filter(found, lambda v: v.isNotNull() & (v != word)))


def variant_rows(words: DataFrame, name: str, word: str = "word") -> DataFrame:
    """(word, ord, variant) for distinct words."""
    rows = words.where(F.col(word).isNotNull()).select(key(F.col(word)).alias("word")).where("word <> ''").distinct()
    return rows.select("word", F.posexplode(variants(F.col("word"), name)).alias("ord", "variant"))


def variant_sql(name: str, source: str, word: str = "word") -> str:
    """The same in SQL, without the order; for generators of edits."""
    parts = []
    for e in EDITS[name]:
        low = f"g[1:i-1-{e.back}]" if e.back else "g[1:i-1]"
        head = f"(case when i - {1 + e.back} <= 0 then []::varchar[] else {low} end)"
        parts.append(f"select word, array_to_string({head} || {e.sql_put} || g[i+{e.take - e.back}:], '') as variant from p where {e.sql_at}")
    return f"""with w as (select distinct lower(trim({word})) as word from {source} where {word} is not null and trim({word}) <> ''),
    l as (select word, regexp_extract_all(word, 'għ|(?s:.)') as g from w),
    p as (select word, g, unnest(range(1, len(g) + 2))::int as i from l)
    select distinct word, variant from ({' union all '.join(parts)}) where variant <> word"""


def combinations(word: Column, most: int = 3, limit: int = 128) -> Column:
    """Shortcut letters changed at one place, then at two, up to ``most`` places at once, at most ``limit`` (GEN-1)."""
    one = variants(word, "shortcut")
    out, level = one, one
    for _ in range(1, most):
        level = F.slice(F.array_distinct(F.flatten(F.transform(level, lambda v: variants(v, "shortcut")))), 1, 4 * limit)
        level = F.filter(level, lambda v: v != word)
        out = F.array_distinct(F.concat(out, level))
    return F.slice(out, 1, limit)


def strict_variants(word: Column) -> Column:
    """The word, with gh as għ, and għ moved left over a vowel once or twice (GEN-4)."""
    base = F.array_distinct(F.array(word, F.replace(word, F.lit("gh"), F.lit("għ"))))
    for _ in range(2):
        moved = F.flatten(F.transform(base, lambda v: variants(v, "gh_left")))
        base = F.array_distinct(F.concat(base, moved))
    return base


def priority_variants(word: Column) -> Column:
    """The groups of għ repairs in their order (GEN-6)."""
    apostrophe = F.when(word.rlike(f"[{VOWELS}]$"), F.array(F.concat(word, F.lit("'")))).otherwise(F.array().cast("array<string>"))
    inserted = variants(word, "insert_gh")
    with_h = F.flatten(F.transform(inserted, lambda v: variants(v, "insert_h")))
    return F.array_distinct(F.concat(strict_variants(word), apostrophe, variants(word, "g_to_gh"), inserted, with_h))


def gated(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Variants that lexicon(word) holds; the join is an equi-join whose smaller side Spark may broadcast by its size."""
    known = lexicon.select(key(F.col("word")).alias("variant")).distinct()
    return rows.join(known, "variant", "left_semi").select("word", "ord", "variant")


def first_match(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, variant): the first variant that the lexicon holds (JOIN-3)."""
    return gated(rows, lexicon).groupBy("word").agg(F.min_by("variant", "ord").alias("variant"))


def changes(word: Column, variant: Column) -> Column:
    """Letters that differ, for words of equally many letters, else 999 (GEN-2)."""
    a, b = graphemes(word), graphemes(variant)
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), differing).otherwise(999)


def unique_best(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, variant) where one variant with the fewest changed letters stands alone (GEN-2)."""
    scored = gated(rows, lexicon).withColumn("n", changes(F.col("word"), F.col("variant")))
    least = Window.partitionBy("word")
    best = scored.withColumn("least", F.min("n").over(least)).where("n = least").groupBy("word").agg(F.count("*").alias("k"), F.min("variant").alias("variant"))
    return best.where("k = 1").select("word", "variant")


def ranked_priority(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(word, variant): of all għ repairs in the lexicon the one with the longest common start, then the nearest (GEN-6)."""
    rows = words.select(key(F.col(word)).alias("word")).where("word <> ''").distinct()
    spread = rows.select("word", F.posexplode(priority_variants(F.col("word"))).alias("ord", "base"))
    spread = spread.select("word", "ord", F.explode(F.array_distinct(F.concat(F.array("base"), strict_variants(F.col("base"))))).alias("variant"))
    hits = gated(spread, lexicon)
    a, b = graphemes(F.col("word")), graphemes(F.col("variant"))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.array_position(F.transform(same, lambda x: x.cast("int")), 0) - 1, F.lit(0))
    shared = F.when(shared < 0, F.size(same)).otherwise(shared)
    order = Window.partitionBy("word").orderBy(F.desc("shared"), "distance", "variant")
    scored = hits.withColumn("shared", shared).withColumn("distance", F.levenshtein("word", "variant"))
    return scored.withColumn("at", F.row_number().over(order)).where("at = 1").select("word", "variant")


#: Endings rewritten together with their stem: pattern of the ending, new endings in order (GEN-19).
_COMPOSITE = (("a(?:hh|hħ|ħh|ħħ)a$", ("agħha",)), ("ahhom$", ("agħhom",)), ("hom$", ("ahom", "agħhom")), ("om$", ("ahom", "agħhom", "hom")), ("a'$", ("à",)), ("e'$", ("è",)), ("i'$", ("ì",)), ("o'$", ("ò",)), ("u'$", ("ù",)), ("uwiex$", ("uhiex", "uha")), ("uwia$", ("uhiex", "uha")))
#: Typed letters that may stand for others throughout a stem.
_TYPED = (("gh", "għ"), ("h", "ħ"), ("z", "ż"), ("g", "ġ"), ("c", "ċ"))


def stem_spellings(stem: Column) -> Column:
    """A stem as typed, and with one kind of letter replaced throughout; the last ones replace two kinds."""
    one = [F.replace(stem, F.lit(a), F.lit(b)) for a, b in _TYPED]
    two = [F.replace(F.replace(stem, F.lit(a), F.lit(b)), F.lit("h"), F.lit("ħ")) for a, b in (("gh", "għ"), ("z", "ż"), ("g", "ġ"))]
    return F.array_distinct(F.array(stem, *one, *two))


def composite_variants(word: Column) -> Column:
    """Repairs that take several steps at once (GEN-19): endings with their stem, a preposition's apostrophe, a silent h.

    What no word can hold (a doubled j or w before a consonant) is left out.
    """
    empty = F.array().cast("array<string>")
    groups = []
    for ending, new in _COMPOSITE:
        stems = stem_spellings(F.regexp_replace(word, ending, ""))
        groups.append(F.when(word.rlike(f".{ending}"), F.flatten(F.transform(stems, _endings(new)))).otherwise(empty))
    tail = F.substring(word, F.lit(2), F.length(word))
    spelled = stem_spellings(tail)
    single = F.transform(spelled, lambda v: F.regexp_replace(v, r"([bdfgjklmnprstvwzżġċħ])\1+", "$1"))
    with_apostrophe = F.transform(F.concat(spelled, single), lambda v: F.concat(F.substring(word, 1, 1), F.lit("'"), v))
    groups.append(F.when(word.rlike("^[bftxmd].."), with_apostrophe).otherwise(empty))
    groups.append(F.when(word.rlike("^[hħ].."), spelled).otherwise(empty))
    groups.append(stem_spellings(word))
    return F.array_distinct(F.filter(F.concat(*groups), lambda v: (v != word) & (v != "") & ~v.rlike("(?:jj|ww)[bdfġgħhklmnprstvwzżċq]")))


def _endings(new: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda v: F.array(*[F.concat(v, F.lit(e)) for e in new])


def tail_variants(word: Column) -> Column:
    """A noun after an article in its other spellings (GEN-20): one consonant doubled, or ij before a consonant as i."""
    shortened = F.array(F.when(word.rlike("ij[bċdfġghħklmnpqrstvwxżz]"), F.regexp_replace(word, "ij(?=[bċdfġghħklmnpqrstvwxżz])", "i")))
    return F.array_distinct(F.filter(F.concat(strict_variants(word), variants(word, "double"), shortened), lambda v: v.isNotNull()))


def remainder_variants(word: Column) -> Column:
    """What is left of a word after a fused preposition, in the order in which it is looked up (GEN-21)."""
    as_gh = F.when(word.rlike("^h."), strict_variants(F.concat(F.lit("għ"), F.substring(word, F.lit(2), F.length(word))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(strict_variants(word), as_gh, priority_variants(word), combinations(word), variants(word, "gh_h_hbar"), variants(word, "i_ie")))


def debug(word: Column) -> Column:
    """All variants of a word by generator (GEN-23)."""
    return F.struct(*[variants(word, name).alias(name) for name in [*EDITS, *ENDINGS]])
