"""Queries over sources, places, sinks and word features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import verbs as V
from textloom.operators import articles, grammar, ngrams, orthography, places, similarity, suffixes
from textloom.operators.rows import load_corpus_lines, load_verb_raw
from textloom.plans import corpus as C
from textloom.plans import words as W
from textloom.plans.registry import Registry
from textloom.session import ensure_checkpoint_dir, table
from textloom.sources import lexicon as L
from textloom.streaming import choices

R = Registry()
_nfc = "lower(trim(replace(replace(replace(nfc_normalize({0}), '’', chr(39)), 'ʼ', chr(39)), '‘', chr(39))))"
_exact = "trim(replace(replace(replace(nfc_normalize({0}), '’', chr(39)), 'ʼ', chr(39)), '‘', chr(39)))"

# Dictionaries

R.add(
    "src2_entries",
    lambda s, d: L.entries(W._lines(s, d)).select("row_id", "surface", "payload"),
    r"""with l as (select row_id, word || '/' || raw_tag as line from verb_forms where word is not null and raw_tag is not null)
    select row_id, trim(split_part(line, '/', 1)) as surface, trim(substr(line, position('/' in line) + 1)) as payload from l
    where not regexp_matches(trim(line), '^#') and not regexp_full_match(trim(line), '[0-9]*') and trim(split_part(line, '/', 1)) <> ''""",
)


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus as a dictionary: each lemma with its tag as the payload."""
    loaded, _ = load_corpus_lines(table(spark, folder, "corpus_lines"))
    return loaded.select(F.col("lemma").alias("surface"), F.concat("tag", F.lit("-"), F.coalesce("root", F.lit(""))).alias("payload"))


_tagged_sql = f"{C._corpus}, tagged as (select f[3] as surface, f[2] as tag, f[4] as root from y where reason is null)"
R.add("src4_nouns", lambda s, d: L.by_tag(_tagged(s, d), "NOUN"), f"with {_tagged_sql} select distinct word from (select {_nfc.format('surface')} as word from tagged where tag = 'NOUN' union all select {_exact.format('surface')} from tagged where tag = 'NOUN') where word <> ''")
R.add(
    "join10_features",
    lambda s, d: L.tag_features(_tagged(s, d)).select("word", F.array_join("prefixes", ",").alias("tags"), "is_noun", "is_adjective", "is_numeral"),
    f"""with {_tagged_sql}, b as (select {_nfc.format('surface')} as word, list_sort(list(distinct tag)) as tags from tagged group by 1)
    select word, array_to_string(tags, ',') as tags, list_contains(tags, 'NOUN') as is_noun, list_contains(tags, 'ADJ') and word <> 'wisq' as is_adjective, false as is_numeral from b""",
)
_verbs_loaded = f"{C._verb_raw}, v as (select row_id, f[2] as word, f[3] as raw_tag, f[4] as gloss, split(regexp_replace(f[3], '-N$', ''), '-') as p from j where reason is null)"
_cleaned = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), e' \t\r\n:;,')"
R.oracle["join1_meanings"] = f"""with {_verbs_loaded}, i as (select {_nfc.format('word')} as k, {_exact.format('word')} as e, {_cleaned.format('gloss')} as m, row_id from v),
    x as (select e, m, min(row_id) as o from i where k <> '' and m <> '' group by 1, 2), y2 as (select k, m, min(row_id) as o from i where k <> '' and m <> '' group by 1, 2),
    a as (select e, string_agg(m, ' / ' order by o, m) as m from x group by 1), b as (select k, string_agg(m, ' / ' order by o, m) as m from y2 group by 1),
    w as (select word from {W._forms} union select word from {W._missing})
    select w.word, coalesce(a.m, b.m, '') as meaning from w left join a on a.e = w.word left join b on b.k = w.word"""


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    loaded, _ = load_verb_raw(table(spark, folder, "verb_raw"))
    payload = F.concat(F.lit("x/"), F.regexp_replace("raw_tag", "-N$", ""), F.lit("-"), "gloss", F.when(F.col("negative"), "-N").otherwise(""))
    return loaded.where("gloss <> ''").select("row_id", V.parsed(payload).alias("p")).where("p is not null").select("row_id", "p.tense", "p.person", "p.gloss", "p.negative")


R.add(
    "str15_parsed",
    _parsed,
    f"with {_verbs_loaded} select row_id, p[len(p) - 1] as tense, p[len(p)] as person, {_cleaned.format('gloss')} as gloss, ends_with(raw_tag, '-N') as negative from v where {_cleaned.format('gloss')} <> ''",
)


def _english(spark: SparkSession, folder: str) -> DataFrame:
    """The first English words of the glosses."""
    loaded, _ = load_verb_raw(table(spark, folder, "verb_raw"))
    return loaded.select(F.regexp_extract(F.regexp_replace("gloss", "^to ", ""), "^([a-z]+)", 1).alias("verb")).where("verb <> ''").distinct()


R.add(
    "str18_third_person",
    lambda s, d: _english(s, d).select("verb", V.third_person(F.col("verb")).alias("out")),
    f"""with {_verbs_loaded}, e as (select distinct regexp_extract(regexp_replace(gloss, '^to ', ''), '^([a-z]+)', 1) as verb from v)
    select verb, case verb when 'be' then 'is' when 'have' then 'has' when 'do' then 'does' when 'go' then 'goes' else case when regexp_matches(verb, '[^aeiou]y$') then verb[:-2] || 'ies'
      when regexp_matches(verb, '(s|sh|ch|x|z|o)$') then verb || 'es' else verb || 's' end end as out from e where verb <> ''""",
)


def _commands(spark: SparkSession, folder: str) -> DataFrame:
    kinds = suffixes.endings(spark).select("kind", F.col("person").alias("suffix_person")).distinct()
    rows = W.records(spark, folder).select("tense", "person").distinct().crossJoin(F.broadcast(kinds))  # tenses and persons by kinds of suffixes, both fixed
    return rows.select("tense", "person", "kind", "suffix_person", V.impossible(F.col("tense"), F.col("person"), F.col("kind"), F.col("suffix_person")).alias("impossible"))


#: Label, priority and typed endings for the SQL, written down apart from the operator's own table.
TYPED = """DO_1S 10 ni|DO_2S 20 ek ok k|DO_3SM 30 u h|DO_3SF 40 ha wa ja a|DO_1P 50 na|DO_2P 60 kom|DO_3P 70 hom om wom jom|IDO_1S 110 ili li|IDO_2S 120 ilek ilok lek lok|IDO_3SM 130 ilu lu|IDO_3SF 140 ilha ila lha|
IDO_1P 150 ilna lna|IDO_2P 160 ilkom lkom|IDO_3P 170 ilhom lhom ilom lom ilħom lħom|COMBINED_3SM_1S 210 huli uli|COMBINED_3SM_2S 220 hulek ulek|COMBINED_3SM_3SM 230 hulu ulu hulhu ulhu|COMBINED_3SM_3SF 240 hulha ulha|
COMBINED_3SM_1P 250 hulna ulna|COMBINED_3SM_2P 260 hulkom ulkom|COMBINED_3SM_3P 270 hulhom ulhom hulom ulom|COMBINED_3P_3P 280 homlhom omlhom womlhom homlom omlom womlom|COMBINED_3P_1S 281 homli omli womli|
COMBINED_3P_2S 282 homlok omlok womlok homlek omlek womlek|COMBINED_3P_3SM 283 homlu omlu womlu|COMBINED_3P_3SF 284 homlha omlha womlha homlhie omlhie womlhie homlie omlie womlie|COMBINED_3P_1P 285 homlna omlna womlna|
COMBINED_3P_2P 286 homlkom omlkom womlkom|COMBINED_1P_3P 290 nielhom nilhom nielom nilom|COMBINED_1P_DO3P 291 niehom nijhom nijom niejom|COMBINED_1P_3P_3P 292 nihomlhom nijhomlhom nijomlhom nihomlom nijhomlom nijomlom|
COMBINED_1P_3SM_3P 293 niehulhom nijulhom nijulom|COMBINED_1P_3SF_3P 294 nihielhom niehielhom nijhielhom nijielhom|COMBINED_3SF_1S 310 hieli ieli|COMBINED_3SF_2S 320 hielek ielek|COMBINED_3SF_3SM 330 hielu ielu|
COMBINED_3SF_3SF 340 hielha ielha|COMBINED_3SF_1P 350 hielna ielna ilna|COMBINED_3SF_2P 360 hielkom ielkom|COMBINED_3SF_3P 370 hielhom ielhom hielom ielom ilhom ilom"""
_typed = "(select split_part(x, ' ', 1) as label, split_part(x, ' ', 2)::int as priority, unnest(split(x, ' ')[3:]) as ending from (select trim(unnest(split('" + TYPED.replace("\n", "") + "', '|'))) as x))"
R.add(
    "str19_commands",
    _commands,
    f"""with k as (select distinct case when label like 'DO%' then 'DO' when label like 'IDO%' then 'IDO' else 'DO_IDO' end as kind, case when label = 'COMBINED_1P_DO3P' then '1P+3P' else replace(regexp_replace(label, '^[A-Z]+_', ''), '_', '+') end as suffix_person from {_typed}),
    r as (select distinct tense, person from verb_forms where word is not null and raw_tag is not null)
    select tense, person, kind, suffix_person, coalesce(tense = 'IMP' and person in ('2S', '2P') and list_has_any(split(suffix_person, '+'), ['2S', '2P']), false) as impossible from r cross join k""",
)
_first = "regexp_replace(word, 'x$', '')"
R.oracle["flt1_may_have_suffix"] = f"select word, length({_first}) >= 4 and not ends_with({_first}, 'gh') and exists (select 1 from {_typed} t where ends_with({_first}, t.ending)) as out from {W._forms}"
_graph = "regexp_extract_all({0}, 'għ|(?s:.)')"
R.oracle["mor1_parses"] = f"""with t as {_typed}, m as (select word, ending, label, priority, substr(word, 1, length(word) - length(ending)) as stem from {W._missing} w join t on ends_with(w.word, t.ending) and length(w.word) > length(t.ending)),
    g as (select *, {_graph.format('stem')} as g from m),
    k as (select word, stem, ending, label, priority from g where not (label = 'DO_3SF' and ending = 'a' and (len(g) < 4 or g[-1] = 'j' or not (g[-1] = 'għ' or (regexp_full_match(g[-1], '\\p{{L}}') and g[-1] not in {W._V})))))
    select word, stem, ending, label, priority from k qualify row_number() over (partition by word order by length(ending) desc, priority, ending) <= 8"""

_changes = ("eC_to_iC", "eC_drop_e", "VC_to_iC", "VC_drop_vowel", "doubled_add_i", "consonant_add_i", "VCa_to_Cie", "a_to_ie", "a_to_i", "i_a_to_i", "a_to_ghu", "ieCeC_to_eCiC", "wie_to_wi", "na_to_n", "vccvc_to_vcvcc", "apostrophe_to_gh", "apostrophe_to_gha", "a_apostrophe_to_gh")


def _stem_changes(spark: SparkSession, folder: str) -> DataFrame:
    word = F.col("word")
    made = F.array(*[F.struct(F.lit(name).alias("change"), suffixes.CHANGES[name](word).alias("stem")) for name in _changes], F.struct(F.lit("contract_ie").alias("change"), suffixes.contract_ie(word).alias("stem")))
    return W.forms(spark, folder).select("word", F.explode(made).alias("m")).select("word", "m.*").where("stem is not null")


_vowel = lambda x: f"{x} in {W._V}"
_cons = lambda x: f"coalesce({x} = 'għ' or (regexp_full_match({x}, '\\p{{L}}') and {x} not in {W._V}), false)"
_text = lambda low, tail: f"array_to_string(g[1:len(g) - {low}] || [{tail}], '')"
_change_sql = {
    "eC_to_iC": (f"g[-2] = 'e' and {_cons('g[-1]')}", _text(2, "'i', g[-1]")),
    "eC_drop_e": (f"g[-2] = 'e' and {_cons('g[-1]')}", _text(2, "g[-1]")),
    "VC_to_iC": (f"{_vowel('g[-2]')} and {_cons('g[-1]')}", _text(2, "'i', g[-1]")),
    "VC_drop_vowel": (f"{_vowel('g[-2]')} and {_cons('g[-1]')}", _text(2, "g[-1]")),
    "doubled_add_i": (f"g[-2] = g[-1] and {_cons('g[-1]')}", "word || 'i'"),
    "consonant_add_i": (_cons("g[-1]"), "word || 'i'"),
    "VCa_to_Cie": (f"g[-1] = 'a' and {_vowel('g[-3]')} and {_cons('g[-2]')}", _text(3, "g[-2], 'ie'")),
    "a_to_ie": ("g[-1] = 'a'", _text(1, "'ie'")),
    "a_to_i": ("g[-1] = 'a'", _text(1, "'i'")),
    "i_a_to_i": ("g[-1] = 'a' and g[1] = 'i' and len(g) > 2", "array_to_string(g[2:len(g) - 1] || ['i'], '')"),
    "a_to_ghu": ("g[-1] = 'a'", _text(1, "'għu'")),
    "ieCeC_to_eCiC": (f"len(g) >= 5 and g[-5] = 'i' and g[-4] = 'e' and {_cons('g[-3]')} and g[-2] = 'e' and {_cons('g[-1]')}", _text(5, "'e', g[-3], 'i', g[-1]")),
    "wie_to_wi": ("len(g) >= 4 and word like 'wie_%'", "'wi' || substr(word, 4)"),
    "na_to_n": ("ends_with(word, 'na')", "substr(word, 1, length(word) - 1)"),
    "vccvc_to_vcvcc": (f"len(g) >= 5 and {_vowel('g[-5]')} and {_cons('g[-4]')} and {_cons('g[-3]')} and {_vowel('g[-2]')} and {_cons('g[-1]')}", _text(5, "g[-5], g[-4], g[-5], g[-3], g[-1]")),
    "apostrophe_to_gh": ("g[-1] = ''''", _text(1, "'għ'")),
    "apostrophe_to_gha": ("g[-1] = ''''", _text(1, "'għa'")),
    "a_apostrophe_to_gh": ("g[-1] = '''' and g[-2] = 'a'", _text(2, "'għ'")),
    "contract_ie": ("true", "case when substr(word, 2, 2) = 'ie' then word[1] || 'e' || replace(substr(word, 4), 'ie', 'i') else replace(word, 'ie', 'i') end"),
}
R.add("mor4_changes", _stem_changes, f"with w as (select word, {_graph.format('word')} as g from {W._forms}) " + " union all ".join(f"select word, '{name}' as change, {stem} as stem from w where {when}" for name, (when, stem) in _change_sql.items()))

# Words

R.add("flt4_ends_in_vowel", lambda s, d: W.forms(s, d).select("word", articles.ends_in_vowel(F.col("word")).alias("out")), f"select word, regexp_matches(word, '[aeiouàèìòù]''?-*$') as out from {W._forms}")
R.add("flt4_opens_softly", lambda s, d: W.forms(s, d).select("word", articles.opens_softly(F.col("word")).alias("out")), f"select word, regexp_matches(word, '^([aeiouàèìòù]|għ|gh|h)') as out from {W._forms}")
R.add(
    "win16_definite",
    lambda s, d: W.forms(s, d).select("word", articles.definite(F.col("word")).alias("out")),
    f"""select word, case when regexp_matches(word, '^[ms][^aeiouàèìòù]') then 'l-i' || word when word[1] in ('ċ','d','n','r','s','t','x','ż','z') then 'i' || word[1] || '-' || word
      when regexp_matches(word, '^([aeiouàèìòù]|għ|gh|h)') then 'l-' || word else 'il-' || word end as out from {W._forms}""",
)
R.add(
    "str2_cleaned",
    lambda s, d: table(s, d, "corpus_lines").where("line is not null").select("row_id", T.clean_meaning(F.col("line")).alias("out")),
    f"select row_id, {_cleaned.format('line')} as out from corpus_lines where line is not null",
)


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "update_choice").where("token is not null")
    one = F.array(F.struct(F.col("token").alias("original"), F.coalesce("suggestions", F.expr("cast(array() as array<string>)")).alias("choices"), F.col("chosen").isNull().alias("unrecognized")))
    return rows.select("row_id", T.notes(one).alias("out"))


R.add(
    "str12_notes",
    _notes,
    """with k as (select row_id, token, chosen, coalesce(suggestions, []) as s from update_choice where token is not null),
    u as (select row_id, token, chosen, len(s) as n, array_to_string(list_filter(list_filter(s, lambda x, i: list_position(s, x) = i), lambda x: x is not null), ', ') as c from k)
    select row_id, concat_ws(chr(10), case when n > 0 then token || ' - suggestions: ' || c || '.' end, case when chosen is null then 'Unrecognized words: ' || token || '.' end) as out from u""",
)
_anchors = "(select distinct array_to_string(list_filter({c}, lambda x, i: i = 1 or x <> ({c})[i-1]), '') as a from {t})"
_anchor_of = lambda t: _anchors.format(c=W._consonants, t=t)
R.oracle["join8_near_anchors"] = f"""with q as (select a from {_anchor_of(W._missing)} where a <> ''), k as (select a as b from {_anchor_of(W._forms)} where a <> ''), r as (select a from q where a not in (select b from k))
    select a as query, b as anchor from q join k on a = b union all
    select a, b from r join k on a[1] = b[1] and abs(length(a) - length(b)) <= 1 and case when length(a) = length(b)
      then len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) <= 1 when length(a) > length(b) then {W._less.format('a', 'b')} else {W._less.format('b', 'a')} end"""
_moved = orthography.variant_sql("gh_left", "s0")
_moved_twice = orthography.variant_sql("gh_left", "s1")
R.add(
    "gen4_strict_words",
    lambda s, d: W.forms(s, d).select("word", F.explode(orthography.strict_variants(F.col("word"))).alias("variant")),
    f"""with o as (select word as own, unnest([word, replace(word, 'gh', 'għ')]) as word from {W._forms}), s0 as (select distinct word from o), a as ({_moved}), b0 as (select own, word as v from o union select o.own, a.variant from o join a on a.word = o.word),
    s1 as (select distinct v as word from b0), a1 as ({_moved_twice}) select own as word, v as variant from b0 union select b0.own, a1.variant from b0 join a1 on a1.word = b0.v""",
)

# Places: the names of the list and of the corpus


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "name_list").where("surface is not null").select(F.col("surface").alias("name"), F.col("surface").alias("ord"))


_clean_name = r"trim(regexp_replace(replace(replace(replace(nfc_normalize({0}), '’', chr(39)), 'ʼ', chr(39)), '‘', chr(39)), '\s+', ' ', 'g'))"
_place_rule = r"length(name) between 2 and 100 and regexp_full_match(name, '\p{L}[\p{L}\p{M}\p{N} .,''()/-]*')"


def _surfaces(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "unified_match").where("group0 is not null").select(F.col("group0").alias("name"), F.col("row_id").alias("ord"))


R.add(
    "ps1_clean_places",
    lambda s, d: places.clean_places(_surfaces(s, d)).select("name"),
    f"with p as (select {_clean_name.format('group0')} as name, row_id from unified_match where group0 is not null and not regexp_matches(group0, '[̇̀́]')) select name from p where {_place_rule} qualify row_number() over (partition by lower(name) order by row_id) = 1",
)
R.add(
    "ps3_latin_places",
    lambda s, d: places.clean_places(_names(s, d), latin=True).select("name"),
    f"with p as (select {_clean_name.format('surface')} as name, surface from name_list where surface is not null) select name from p where {_place_rule} and not regexp_matches(name, '[^\\x{{0}}-\\x{{24F}}]') qualify row_number() over (partition by lower(name) order by surface) = 1",
)


def _gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as places: those in credit are of class P, others of class A with the first letter of their address as a code."""
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    rows = table(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, "P").otherwise("A").alias("feature_class"), F.when(F.col("s_acctbal") < -500, "ADM1").otherwise("ADM2").alias("feature_code"), F.col("n_name").alias("country"))


def _cities(spark: SparkSession, folder: str) -> DataFrame:
    abroad, own = places.cities(_gazetteer(spark, folder), "FRANCE")
    return abroad.select("name", F.lit("abroad").alias("side")).unionByName(own.select("name", F.lit("home").alias("side")))


R.add(
    "ps4_cities",
    _cities,
    """select s_name as name, case when n_name <> 'FRANCE' then 'abroad' else 'home' end as side from supplier join nation on s_nationkey = n_nationkey
    where case when n_name <> 'FRANCE' then s_acctbal > 0 else s_acctbal > 0 or s_acctbal < -500 end""",
)
R.add(
    "ps6_preferred",
    lambda s, d: table(s, d, "update_choice").where("suggestions is not null").select("row_id", places.preferred_alias(F.filter("suggestions", lambda x: x.isNotNull()), ("il-", "iċ-", "l-", "g")).alias("alias")).where("alias is not null"),
    """with k as (select row_id, list_filter(suggestions, lambda x: x is not null) as s from update_choice where suggestions is not null),
    f as (select row_id, coalesce(list_sort(list_transform(list_filter(s, lambda x: starts_with(x, 'il-')), lambda x: (length(x), x)))[1], list_sort(list_transform(list_filter(s, lambda x: starts_with(x, 'iċ-')), lambda x: (length(x), x)))[1],
      list_sort(list_transform(list_filter(s, lambda x: starts_with(x, 'l-')), lambda x: (length(x), x)))[1], list_sort(list_transform(list_filter(s, lambda x: starts_with(x, 'g')), lambda x: (length(x), x)))[1]) as a from k)
    select row_id, a[2] as alias from f where a is not null""",
)
R.add(
    "ps11_without",
    lambda s, d: places.without(_names(s, d).select("name"), W.forms(s, d).select(F.col("word").alias("name")), _surfaces(s, d).select("name")),
    "select surface as name from name_list where surface is not null and lower(surface) not in (select lower(word) from " + W._forms + ") and lower(surface) not in (select lower(group0) from unified_match where group0 is not null)",
)


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "name_list").where("surface is not null")
    return places.sections(("NAME", names.where("payload = 'NAME'").select(F.col("surface").alias("name"))), ("SNAME", names.where("payload = 'SNAME'").select(F.col("surface").alias("name"))))


R.add("ps12_sections", _sections, "select distinct case payload when 'NAME' then 0 else 1 end as section, surface || '/' || payload as line from name_list where payload in ('NAME', 'SNAME') and surface is not null")
R.add(
    "ps13_json_values",
    lambda s, d: places.json_values(table(s, d, "corpus_meta"), "meta_json", "corpus_name"),
    r"""select unnest(regexp_extract_all(meta_json, '"corpus_name"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)) as value from corpus_meta where meta_json is not null""",
)

# Sinks


def _exported(spark: SparkSession, folder: str) -> DataFrame:
    """Unigrams written as an index in the shared folder and loaded again."""
    ensure_checkpoint_dir(spark)
    target = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"
    toks = C._counted_from(spark, folder)
    ngrams.export(ngrams.unigrams(toks), ngrams.bigrams(toks), ngrams.trigrams(toks), target)
    status, uni, _, _ = ngrams.load(spark, target)
    return uni.select("w1", "cnt", "log_freq", F.lit(status).alias("status"))


R.add("snk1_exported", _exported, f"with {C._tokens} select w1, cnt, round(ln(cnt), 4) as log_freq, 'READY' as status from u")


def _upserted(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of each request, replaced by the last one of those that came again."""
    logs = table(spark, folder, "create_log").where("log_id is not null")
    last = logs.groupBy("log_id").agg(F.max_by("row_id", F.struct("received_at", "row_id")).alias("row_id"), F.count("*").alias("n")).where("n > 1").select("log_id", "row_id")
    return choices.upserted(choices.first_requests(logs).select("log_id", "row_id"), last)


R.add(
    "snk11_upserted",
    _upserted,
    """with f as (select log_id, row_id from create_log where log_id is not null qualify row_number() over (partition by log_id order by received_at, row_id) = 1),
    l as (select log_id, arg_max(row_id, (received_at, row_id)) as row_id from create_log where log_id is not null group by 1 having count(*) > 1)
    select * from f where log_id not in (select log_id from l) union all select * from l""",
)


def _feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as feedback: the client as the name before an address, notes as the subject, the input as the message."""
    rows = table(spark, folder, "create_log").select("row_id", F.concat("client", F.when(F.col("input_lang") == "mt", "@a.invalid").otherwise(" @b")).alias("email"), F.col("notes").alias("subject"), F.col("input").alias("message"), F.lit(None).cast("string").alias("screenshot_data_url"))
    return choices.checked_feedback(rows).select("row_id", "error")


R.add(
    "api5_feedback",
    _feedback,
    """select row_id, case when client is null or input_lang is distinct from 'mt' then 'email' when notes is null or length(trim(notes)) not between 1 and 200 then 'subject' when input is null or length(trim(input)) not between 1 and 10000 then 'message' end as error from create_log""",
)

# Positional rules

_lexicon = f"{C._corpus}, {C._positions.replace('d as', 'dd as', 1).replace('from d)', 'from dd)', 1)}, nouns as (select distinct lower(f[1]) as w from y where reason is null and f[2] = 'NOUN'), adjectives as (select distinct lower(f[1]) as w from y where reason is null and f[2] = 'ADJ' union select unnest(['hafna','naqra','iktar','inqas','anqas']))"
_lexicon += ", z2 as (select *, lag(word) over (partition by doc_id order by pos) as p_word, lag(norm) over (partition by doc_id order by pos) as p_norm from x)"
R.add(
    "win3_definite",
    lambda s, d: grammar.definite_phrase(C._neighbours(s, d)).select(*C._short),
    f"""with {_lexicon} select doc_id, pos - 1 as start, pos + 2 as "end", p_word || ' ' || word || ' ' || n_word as surface, p_word || '-' || word || ' ' || p_word || '-' || n_word as suggestion from z2
    where p_norm in ('il','l','id','din','dan','ic','iċ','in','ir','is','it','ix','iz','iż') and norm in (select w from nouns) and n_norm in (select w from adjectives)""",
)
R.add(
    "win4_order",
    lambda s, d: grammar.order(C._neighbours(s, d)).select(*C._short),
    f"""with {_lexicon} select doc_id, pos as start, pos + 2 as "end", word || ' ' || n_word as surface, n_word || ' ' || word as suggestion from z2 where norm in (select w from adjectives) and n_norm in (select w from nouns)""",
)
R.add(
    "win8_numerals",
    lambda s, d: grammar.numerals(C._neighbours(s, d)).select(*C._short),
    f"""with {_lexicon} select doc_id, pos as start, pos + 2 as "end", word || ' ' || n_word as surface, case when ends_with(norm, 't') or norm = 'għoxrin' then 'singular' else 'plural_or_paucal' end as suggestion from z2
    where norm in ('wieħed','waħda','żewġ','tnejn','tlieta','erbgħa','ħamsa','ħams','sitta','sitt','sebgħa','seba','tmienja','tmien','disgħa','disgħ','għaxra','għoxrin') and n_norm in (select w from nouns)""",
)
_records = f"""r as (select {_nfc.format('word')} as word, raw_tag, tense, person, line_number, concat_ws('-', tag_prefix, case when coalesce(stem_kind, '') <> '' then stem_kind end, coalesce(root, ''), form_class) as short_tag
      from verb_forms where word is not null and raw_tag is not null qualify row_number() over (partition by word, raw_tag order by line_number, row_id) = 1)"""
_paradigm = f"""{_records}, fin as (select * from r where tense <> 'IMP' and word <> ''), wt as (select distinct fin.word, t.target from fin, unnest({list(W.PERSONS)}) as t(target) where fin.person <> t.target),
    own as (select distinct wt.word, wt.target, fin.short_tag, fin.tense from wt join fin on wt.word = fin.word),
    pv as (select own.word, own.target as person, fin.word as variant, (fin.tense <> own.tense)::int as other, fin.line_number from own join fin on own.short_tag = fin.short_tag and fin.person = own.target and fin.word <> own.word),
    variants as (select word, person, variant from pv qualify row_number() over (partition by word, person order by other, line_number, variant) = 1),
    fw as (select word, list(distinct person) filter (person <> '') as persons, bool_or(tense = 'PERF' and person <> '') as perf, bool_or(tense = 'MPERF' and person <> '') as mperf from fin group by 1)"""
R.add(
    "win2_verb_chain",
    lambda s, d: grammar.verb_chain(C._neighbours(s, d), W.paradigm(C._records(s, d))).select(*C._short),
    f"""with {_paradigm}, {C._positions} select doc_id, pos as start, pos + 2 as "end", x.word || ' ' || n_word as surface, x.word || ' ' || v.variant as suggestion
    from x join fw a on a.word = x.norm join fw b on b.word = x.n_norm join variants v on v.word = x.n_norm and v.person = a.persons[1]
    where a.perf and b.mperf and len(a.persons) = 1 and not list_contains(b.persons, a.persons[1])""",
)
R.oracle["api6_health"] = f"""with {_records}, {C._tokens} select (select count(*) from {W._forms}) as words, (select count(*) from r) as verb_forms, (select count(distinct short_tag) from r) as paradigms, (select count(*) from u) as unigrams"""
R.oracle["p4_builds"] = f"""with {C._meta} select o.row_id, c.file, c.built_at, json_extract_string(meta_json, '$.corpus_revision') as corpus_revision, try_cast(json_extract_string(meta_json, '$.stats.total_tokens') as bigint) as total_tokens,
    try_cast(json_extract_string(meta_json, '$.stats.malformed_rows') as bigint) as malformed_rows from o join corpus_meta c using (row_id) where reason is null"""
_one, _two, _three = (orthography.variant_sql("shortcut", t) for t in ("m0", "m1", "m2"))
R.add(
    "gen1_words",
    lambda s, d: W.missing(s, d).select("word", F.explode(orthography.combinations(F.col("word"))).alias("variant")),
    f"""with m0 as (select word from {W._missing}), one as ({_one}), m1 as (select distinct variant as word from one), two as ({_two}), l2 as (select distinct one.word as own, two.variant as v from one join two on two.word = one.variant where two.variant <> one.word),
    m2 as (select distinct v as word from l2), three as ({_three}), l3 as (select distinct own, three.variant as v from l2 join three on three.word = l2.v where three.variant <> own)
    select word, variant from one union select own, v from l2 union select own, v from l3""",
)

# Evidence

_pooled = f"""{C._tokens}, o as (select * from update_choice qualify row_number() over (partition by log_id, event_id order by received_at, row_id) = 1),
    e as (select chosen, unnest(suggestions) as word, unnest(range(len(suggestions))) as ord from o where token is not null and suggestions is not null),
    ev as (select {_nfc.format('word')} as w, case when word = chosen then 'choice' else 'suggestion' end as source, case when word = chosen then 1.0::double when ord = 0 then 0.82::double else 0.38::double end as weight, ord from e),
    pl as (select w, list(distinct source) as sources, max(weight) as confidence, min(ord) as first from ev where w <> '' group by 1),
    sc as (select pl.w as word, sources, confidence, first, coalesce(round(round(ln(u.cnt), 4) / 100, 4), 0.0) as bonus from pl left join u on u.w1 = pl.w)"""
_total = "case when bonus > 0 then least(1.0::double, round(confidence + bonus, 4)) else confidence end"
R.oracle["agg3_corpus_evidence"] = f"with {_pooled} select word, array_to_string(list_sort(case when bonus > 0 then list_append(sources, 'corpus') else sources end), ',') as sources, {_total} as confidence, bonus as corpus_score from sc"
R.oracle["agg4_diagnostics"] = f"""with {_pooled} select word, list_sort(case when bonus > 0 then list_append(sources, 'corpus') else sources end) as sources, ['word'] as types, case when bonus > 0 then ['corpus frequency bonus'] else [] end as reasons,
    round({_total}, 3) as confidence, round(bonus, 4) as corpus_score from sc order by first, word limit 12"""
R.oracle["agg5_unrecognized"] = rf"""with {C._tokens}, dd as (select unnest(regexp_extract_all(coalesce(input, ''), '[\p{{L}}\p{{M}}''’]+')) as word from create_log), ww as (select {_nfc.format('word')} as word from dd)
    select word, count(*) as frequency from ww where word <> '' and word not in (select w1 from u) group by 1 order by 2 desc, 1 limit 50"""


def _counters(spark: SparkSession, folder: str) -> DataFrame:
    """Choices as counters: whether the first suggestion was taken, with the number of suggestions as the time."""
    from textloom.operators import evidence

    rows = table(spark, folder, "update_choice").where("suggestions is not null")
    hit = F.coalesce(F.get("suggestions", F.lit(0)) == F.col("chosen"), F.lit(False))
    events = rows.select(F.substring("token", 1, 1).alias("stage"), F.when(hit, "first_hit").otherwise("first_miss").alias("name"), F.lit(1).cast("bigint").alias("amount"), F.size("suggestions").cast("double").alias("elapsed_ms"))
    return evidence.counters(events, 3.0)


R.add(
    "agg6_counters",
    _counters,
    """with k as (select token[1] as stage, coalesce(suggestions[1] = chosen, false) as hit, len(suggestions) as n from update_choice where suggestions is not null)
    select stage, sum(hit::int)::bigint as hits, sum((not hit)::int)::bigint as misses, sum((n >= 3)::int)::bigint as slow, max(n)::double as slowest_ms from k group by 1""",
)
QUERIES, ORACLE = R.queries, R.oracle
