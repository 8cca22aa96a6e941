"""Queries over words: scalar functions, generators, similarity joins, suffixes and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import verbs as V
from textloom.functions.mojibake import repair
from textloom.operators import articles, orthography, places, similarity, suffixes
from textloom.plans.registry import Registry
from textloom.session import table
from textloom.sources import lexicon as L

R = Registry()

_key = "lower(trim(replace(replace(replace(nfc_normalize(word), '’', chr(39)), 'ʼ', chr(39)), '‘', chr(39))))"
_forms = f"(select distinct {_key} as word from verb_forms where word is not null and trim(word) <> '')"
_missing = f"(select distinct {_key} as word from lexical_coverage_report where word is not null and trim(word) <> '')"


def forms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "verb_forms").where("word is not null").select(T.key(F.col("word")).alias("word")).where("word <> ''").distinct()


def missing(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lexical_coverage_report").where("word is not null").select(T.key(F.col("word")).alias("word")).where("word <> ''").distinct()


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Verb records of the table with the features of their tags, each (word, tag) once."""
    rows = table(spark, folder, "verb_forms").where("word is not null and raw_tag is not null")
    rows = rows.withColumns({"root": F.coalesce("root", F.lit("")), "stem_kind": F.coalesce("stem_kind", F.lit(""))})
    return L.with_features(L.distinct_records(rows, ["line_number", "row_id"]))


def _scalar(name: str, expression, sql: str) -> None:
    R.add(name, lambda s, d: forms(s, d).select("word", expression(F.col("word")).alias("out")), f"select word, {sql} as out from {_forms}")


_V = "('a','e','i','o','u','à','è','ì','ò','ù')"
_graphemes = "regexp_extract_all(word, 'għ|(?s:.)')"
_consonants = f"list_filter({_graphemes}, lambda x: (x = 'għ' or regexp_full_match(x, '\\p{{L}}')) and x not in {_V})"
R.add("str1_key", lambda s, d: table(s, d, "verb_forms").where("word is not null").select("row_id", T.key(F.col("word")).alias("out")), f"select row_id, {_key} as out from verb_forms where word is not null")
_scalar("str3_graphemes", lambda w: F.array_join(T.graphemes(w), "|"), f"array_to_string({_graphemes}, '|')")
_scalar("str4_vowels", lambda w: F.size(F.filter(T.graphemes(w), T.is_vowel)), f"len(list_filter({_graphemes}, lambda x: x in {_V}))::int")
_scalar("str5_anchor", T.anchor, f"array_to_string(list_filter({_consonants}, lambda x, i: i = 1 or x <> ({_consonants})[i-1]), '')")
_triples = "word"
for _c in "bċdfġghħjklmnpqrstvwxżzc":
    _triples = f"regexp_replace({_triples}, '{_c}{_c}{_c}', '{_c}{_c}', 'g')"
_scalar("str8_triples", T.collapse_triples, _triples)
_scalar("str9_ascii_key", T.ascii_key, "translate(replace(lower(word), 'għ', 'gh'), 'ġħċż', 'ghcz')")
R.add("flt1_may_have_suffix", lambda s, d: forms(s, d).select("word", suffixes.may_have_suffix(F.col("word")).alias("out")))
_scalar("flt4_needs_i", articles.needs_i, "regexp_matches(word, '^[ms][^aeiouàèìòù]')")
_scalar("ps9_quality", places.quality, "(10 * (length(word) - length(translate(word, 'ħġċżĦĠĊŻ', ''))) - 2 * len(regexp_extract_all(lower(word), 'gh')))::int")
R.add(
    "str10_without_article",
    lambda s, d: table(s, d, "unified_match").where("group0 is not null").select("group0").distinct().select("group0", T.without_article(F.col("group0")).alias("out")),
    "select distinct group0, regexp_replace(group0, '(?i)^(?:l|il|i[cċdgnrstxzż])-', '') as out from unified_match where group0 is not null",
)
R.add(
    "str11_log_time",
    lambda s, d: table(s, d, "create_log").where("received_at is not null").select("row_id", T.log_time(F.col("received_at")).alias("out")),
    "select row_id, strftime(received_at, '%d/%B/%Y %H:%M:%S') as out from create_log where received_at is not null",
)
R.add(
    "str6_radicals",
    lambda s, d: table(s, d, "verb_forms").where("root is not null").select("root").distinct().select("root", T.radical(F.col("root"), 2).alias("second"), T.radical(F.col("root"), 3).alias("third")),
    "select distinct root, (list_filter(regexp_extract_all(lower(trim(root)), 'għ|(?s:.)'), lambda x: x = 'għ' or regexp_full_match(x, '\\p{L}')))[2] as second, (list_filter(regexp_extract_all(lower(trim(root)), 'għ|(?s:.)'), lambda x: x = 'għ' or regexp_full_match(x, '\\p{L}')))[3] as third from verb_forms where root is not null",
)
R.add("str7_repaired", lambda s, d: table(s, d, "create_log").where("input is not null").select("row_id", repair(F.col("input")).alias("out")))
R.add(
    "str21_log_line",
    lambda s, d: table(s, d, "update_choice").select("row_id", T.log_line(token=F.col("token"), chosen=F.col("chosen")).alias("out")),
    "select row_id, concat_ws(' ', 'token=' || token, 'chosen=' || chosen) as out from update_choice",
)
R.add(
    "snk8_sanitized",
    lambda s, d: table(s, d, "create_log").where("input is not null").select("row_id", T.sanitized(F.col("input")).alias("out")),
    "select row_id, case when input[1] in ('=','+','-','@') then '''' || input else input end as out from create_log where input is not null",
)

for _name in orthography.EDITS:
    R.add(f"gen_{_name}", lambda s, d, n=_name: orthography.variant_rows(forms(s, d), n).select("word", "variant"), orthography.variant_sql(_name, _forms))
_ENDING_SQL = {
    "aw_ghu": "select word, regexp_replace(word, 'aw$', 'għu') as variant from w where regexp_matches(word, '.aw$')",
    "ja_ha": "select word, regexp_replace(word, 'ja$', 'ha') as variant from w where ends_with(word, 'ja') union all select word, regexp_replace(word, 'ha$', 'ja') from w where ends_with(word, 'ha')",
    "gh_h_hbar": "select word, substr(word, 1, length(word) - 2) || e as variant from w, unnest(['h','ħ','għ']) as t(e) where ends_with(word, 'gh') union all select word, substr(word, 1, length(word) - 2) || e from w, unnest(['h','ħ']) as t(e) where ends_with(word, 'għ') union all select word, substr(word, 1, length(word) - 1) || e from w, unnest(['għ','ħ']) as t(e) where regexp_matches(word, '[^g]h$') union all select word, substr(word, 1, length(word) - 1) || e from w, unnest(['għ','h']) as t(e) where regexp_matches(word, '[^g]ħ$')",
}
for _name in orthography.ENDINGS:
    R.add(f"gen_{_name}", lambda s, d, n=_name: orthography.variant_rows(forms(s, d), n).select("word", "variant"), f"with w as {_forms} select distinct word, variant from ({_ENDING_SQL[_name]}) where variant <> word")
R.add("gen1_combinations", lambda s, d: missing(s, d).select("word", F.posexplode(orthography.combinations(F.col("word"))).alias("ord", "variant")))
R.add("gen4_strict", lambda s, d: forms(s, d).select("word", F.posexplode(orthography.strict_variants(F.col("word"))).alias("ord", "variant")))
R.add("gen2_unique_best", lambda s, d: orthography.unique_best(missing(s, d).select("word", F.posexplode(orthography.combinations(F.col("word"))).alias("ord", "variant")), forms(s, d)))
for _name, _function in (("gen19_composite", orthography.composite_variants), ("gen20_tails", orthography.tail_variants), ("gen21_remainders", orthography.remainder_variants)):
    R.add(_name, lambda s, d, f=_function: orthography.gated(missing(s, d).select("word", F.posexplode(f(F.col("word"))).alias("ord", "variant")), forms(s, d)))
R.add("gen6_priority", lambda s, d: orthography.ranked_priority(missing(s, d), forms(s, d)))
R.add(
    "join3_first_match",
    lambda s, d: orthography.first_match(orthography.variant_rows(missing(s, d), "b_p"), forms(s, d)),
    f"""with v as ({orthography.variant_sql('b_p', _missing)}), h as (select v.* from v join {_forms} f on v.variant = f.word),
    k as (select word, variant, list_position(list_transform(range(1, length(word) + 1), lambda i: word[i] <> variant[i]), true) as pos from h)
    select word, arg_min(variant, pos) as variant from k group by word""",
)
R.add(
    "join2_records",
    lambda s, d: missing(s, d).join(table(s, d, "verb_forms").where("word is not null").withColumn("word", T.key(F.col("word"))).groupBy("word").agg(F.count("*").alias("n_records")), "word"),
    f"select m.word, count(*) as n_records from {_missing} m join (select {_key} as word from verb_forms) v on v.word = m.word group by 1",
)
_fit = "length(word) <= 32 and regexp_matches(word, '\\p{L}') and not regexp_matches(word, '[-'' ]')"
_less = "list_contains(list_transform(range(1, length({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1)), {1})"
R.add(
    "join7_near_words",
    lambda s, d: similarity.near(missing(s, d), forms(s, d), 1),
    f"""with m as (select word as a from {_missing} where {_fit}), f as (select word as b from {_forms} where {_fit})
    select a as query, b as word, case when a = b then 0 else 1 end::int as distance from m join f on abs(length(a) - length(b)) <= 1 and case when length(a) = length(b)
      then len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) <= 1 when length(a) > length(b) then {_less.format('a', 'b')} else {_less.format('b', 'a')} end""",
)
# The whole job of JOIN-7; no SQL, as DuckDB's levenshtein counts bytes and an own one would compare all pairs.
R.add("join7_near_words_two_edits", lambda s, d: similarity.near(missing(s, d), forms(s, d), 2))
R.add("join8_near_anchors", lambda s, d: similarity.near_anchors(missing(s, d), forms(s, d)))
R.add("mor1_parses", lambda s, d: suffixes.parses(missing(s, d)).select("word", "stem", "ending", "label", "priority"))
R.add(
    "mor11_distinct_records",
    lambda s, d: L.distinct_records(table(s, d, "verb_forms").where("word is not null and raw_tag is not null"), ["line_number", "row_id"]).select("row_id", "word", "raw_tag"),
    "select row_id, word, raw_tag from verb_forms where word is not null and raw_tag is not null qualify row_number() over (partition by word, raw_tag order by line_number, row_id) = 1",
)
R.add("mor3_surfaces", lambda s, d: suffixes.generate(records(s, d)).groupBy("label").agg(F.count("*").alias("surfaces"), F.count_distinct("word").alias("words")))
R.add("mor8_exact", lambda s, d: suffixes.exact(suffixes.parses(missing(s, d)), records(s, d)))
R.add("mor9_suggestions", lambda s, d: suffixes.suggestions(suffixes.parses(missing(s, d)), records(s, d)))
R.add(
    "flt7_root_class",
    lambda s, d: records(s, d).select("word", "raw_tag", "root_class", "short_tag"),
    """with r as (select word, raw_tag, coalesce(root, '') as root, coalesce(stem_kind, '') as stem_kind, form_class, tag_prefix from verb_forms where word is not null and raw_tag is not null
      qualify row_number() over (partition by word, raw_tag order by line_number, row_id) = 1),
    g as (select *, list_filter(regexp_extract_all(lower(trim(root)), 'għ|(?s:.)'), lambda x: x = 'għ' or regexp_full_match(x, '\\p{L}')) as l from r)
    select word, raw_tag, case when stem_kind <> '' then 'STEM_' || stem_kind when form_class = 'F1' and coalesce(l[2] in ('l','m','n','r','għ'), false) then 'F1_MEDIAL_LIQUID_OR_GUTTURAL'
      when coalesce(l[3] in ('w','j'), false) then 'FINAL_WEAK' when coalesce(l[2] in ('w','j'), false) then 'HOLLOW' when form_class = 'F1' then 'F1_NORMAL' else 'OTHER' end as root_class,
    concat_ws('-', tag_prefix, case when stem_kind <> '' then stem_kind end, root, form_class) as short_tag from g""",
)


def _person_variants(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    return L.person_variants(rows, rows.where("person = '1S' and tense <> 'IMP'").select("word").distinct().withColumn("person", F.lit("3SM")))


R.add(
    "join5_person_variants",
    _person_variants,
    """with r as (select word, raw_tag, tense, person, line_number, concat_ws('-', tag_prefix, case when coalesce(stem_kind, '') <> '' then stem_kind end, coalesce(root, ''), form_class) as short_tag
      from verb_forms where word is not null and raw_tag is not null qualify row_number() over (partition by word, raw_tag order by line_number, row_id) = 1),
    f as (select * from r where tense <> 'IMP'),
    own as (select distinct w.word, f.short_tag, f.tense from (select distinct word from f where person = '1S') w join f using (word)),
    p as (select own.word, f.person, f.word as variant, (f.tense <> own.tense)::int as other, f.line_number from own join f on own.short_tag = f.short_tag and f.person = '3SM' and f.word <> own.word)
    select word, person, variant from p qualify row_number() over (partition by word, person order by other, line_number, variant) = 1""",
)
PERSONS = ("1S", "2S", "3SM", "3SF", "1P", "2P", "3P")


def paradigm(rows: DataFrame) -> DataFrame:
    """(word, person, variant) of every finite word of verb records with each other person as the target (JOIN-5)."""
    targets = F.explode(F.array(*[F.lit(p) for p in PERSONS])).alias("target")
    wanted = rows.where("tense <> 'IMP'").select("word", "person", targets).where("person <> target")
    return L.person_variants(rows, wanted.select("word", F.col("target").alias("person")).distinct())


R.add(
    "join5_all_persons",
    lambda s, d: paradigm(records(s, d)),
    f"""with r as (select word, raw_tag, tense, person, line_number, concat_ws('-', tag_prefix, case when coalesce(stem_kind, '') <> '' then stem_kind end, coalesce(root, ''), form_class) as short_tag
      from verb_forms where word is not null and raw_tag is not null qualify row_number() over (partition by word, raw_tag order by line_number, row_id) = 1),
    f as (select * from r where tense <> 'IMP'),
    w as (select distinct f.word, t.target from f, unnest({list(PERSONS)}) as t(target) where f.person <> t.target),
    own as (select distinct w.word, w.target, f.short_tag, f.tense from w join f on w.word = f.word),
    p as (select own.word, own.target as person, f.word as variant, (f.tense <> own.tense)::int as other, f.line_number from own join f on own.short_tag = f.short_tag and f.person = own.target and f.word <> own.word)
    select word, person, variant from p qualify row_number() over (partition by word, person order by other, line_number, variant) = 1""",
)
R.add(
    "src11_names",
    lambda s, d: L.by_tag(table(s, d, "name_list"), "NAME"),
    "select distinct word from (select lower(trim(surface)) as word from name_list where contains(upper(payload), 'NAME') union all select trim(surface) from name_list where contains(upper(payload), 'NAME'))",
)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "verb_forms").where("word is not null and raw_tag is not null").select("row_id", F.concat_ws("/", "word", "raw_tag").alias("line"))


R.add(
    "src1_verb_records",
    lambda s, d: L.verb_records(L.entries(_lines(s, d))).groupBy("tag_prefix", "form_class", "tense", "person").agg(F.count("*").alias("n")),
    """with e as (select split(trim(raw_tag), '-') as p from verb_forms where word is not null and raw_tag is not null and trim(word) <> '' and not starts_with(trim(word), '#') and regexp_matches(trim(raw_tag), '^(AS|T|Q|S)-') and position('/' in word) = 0)
    select p[1] as tag_prefix, case when p[1] = 'AS' then 'S' else p[3] end as form_class, coalesce(case when p[1] = 'AS' then p[3] else p[4] end, '') as tense, coalesce(case when p[1] = 'AS' then p[4] else p[5] end, '') as person, count(*) as n
    from e where len(p) >= case when p[1] = 'AS' then 4 else 3 end group by all""",
)
R.add(
    "snk3_dictionary_lines",
    lambda s, d: L.dictionary_lines(table(s, d, "name_list").select("surface", "payload"), 200),
    "select distinct concat_ws('/', surface, payload) as line from name_list order by line",
)


def _glosses(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.operators.rows import load_verb_raw

    loaded, _ = load_verb_raw(table(spark, folder, "verb_raw"))
    payload = F.concat(F.regexp_replace("raw_tag", "-N$", ""), F.lit("-"), "gloss", F.when(F.col("negative"), "-N").otherwise(""))
    return loaded.where("gloss <> ''").select("row_id", payload.alias("payload")).select("row_id", "payload", V.meaning(F.col("payload")).alias("meaning"))


R.add("str16_glosses", _glosses)


def _meanings(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.operators.rows import load_verb_raw

    loaded, _ = load_verb_raw(table(spark, folder, "verb_raw"))
    index = L.meanings(loaded.withColumn("surface", F.col("word")), F.col("gloss"), F.col("row_id"))
    return L.look_up(missing(spark, folder).unionByName(forms(spark, folder)).distinct(), index)


R.add("join1_meanings", _meanings)
R.add("win15_hyphenated", lambda s, d: articles.hyphenated(missing(s, d), _nouns(s, d)))
R.add("win18_fused", lambda s, d: articles.fused(missing(s, d), forms(s, d), _nouns(s, d)))
R.add(
    "ps10_best_spelling",
    lambda s, d: places.best_spelling(missing(s, d).select(F.col("word").alias("name"), F.col("word").alias("ord"))).select("name"),
    f"""with w as (select word as name, regexp_replace(translate(replace(lower(translate(word, 'àáâäèéêëìíîïòóôöùúûü', 'aaaaeeeeiiiioooouuuu')), 'għ', 'gh'), 'ġħċż', 'ghcz'), '[^\\p{{L}}\\p{{N}}]', '', 'g') as k,
      10 * (length(word) - length(translate(word, 'ħġċżĦĠĊŻ', ''))) - 2 * len(regexp_extract_all(lower(word), 'gh')) as q from {_missing})
    select name from w qualify row_number() over (partition by k order by q desc, name) = 1""",
)


def _nouns(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.operators.rows import load_corpus_lines

    loaded, _ = load_corpus_lines(table(spark, folder, "corpus_lines"))
    return loaded.where("tag = 'NOUN'").select(F.col("lemma").alias("word")).distinct()


def _suggest(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.operators.check import suggest

    return suggest(missing(spark, folder), forms(spark, folder))


R.add("api2_suggest", _suggest)
QUERIES, ORACLE = R.queries, R.oracle
