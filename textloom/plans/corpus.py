"""Queries over corpus files: rows, n-grams, scores and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import anchor, key
from textloom.operators import evidence, grammar, ngrams, rows
from textloom.plans.registry import Registry
from textloom.plans.words import forms, paradigm, records
from textloom.session import cut, table
from textloom.sources import lexicon as L

R = Registry()

_once = "(select file, line_no, min(line) as line from corpus_lines group by 1, 2)"
_vertical = rf"""l as (select file, line_no, trim(coalesce(line, ''), e' \t\r\n') as t from {_once}),
    k as (select *, t = '' or starts_with(t, '#') or starts_with(t, '<') as boundary, t = '' or starts_with(t, '</s') as sentence_end, trim(split_part(t, '|', 1), e' \t\r\n') as surface from l),
    m as (select *, not boundary and (surface = '' or regexp_matches(surface, '(?i)https?://\S+|www\.\S+') or regexp_matches(surface, '<[^>]+>') or regexp_full_match(surface, '[^\p{{L}}\p{{M}}\p{{N}}_\s]+') or regexp_matches(surface, '\p{{Nd}}')) as malformed from k),
    v as (select *, case when not boundary and not malformed and length(surface) <= 80 then surface end as token from m)"""
_tokens = f"""{_vertical}, b as (select file, line_no, token, lower(token) as norm from v where boundary or token is not null),
    w as (select *, lag(norm, 1) over f as l1, lag(norm, 2) over f as l2 from b window f as (partition by file order by line_no)),
    t as (select file, line_no, token, norm, l1 as p1, case when l1 is not null then l2 end as p2 from w where token is not null),
    u as (select norm as w1, count(*) as cnt from t group by 1 having count(*) >= 2)"""


def _tokens_of(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.tokens(table(spark, folder, "corpus_lines"))


def _counted_from(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens' words alone, computed once where several counts are made from them."""
    return cut(_tokens_of(spark, folder).select("token", "norm", "p1", "p2"))


R.add("agg1_tokens", _tokens_of, f"with {_tokens} select file, line_no, token, norm, p1, p2 from t")
R.add("agg1_unigrams", lambda s, d: ngrams.unigrams(_tokens_of(s, d)), f"with {_tokens} select w1, cnt, round(ln(cnt), 4) as log_freq from u")
R.add(
    "agg1_bigrams",
    lambda s, d: ngrams.bigrams(_counted_from(s, d)),
    f"with {_tokens} select p1 as w1, norm as w2, count(*) as cnt, round(ln(count(*)), 4) as log_freq from t where p1 in (select w1 from u) and norm in (select w1 from u) group by 1, 2 having count(*) >= 2",
)
R.add(
    "agg1_trigrams",
    lambda s, d: ngrams.trigrams(_counted_from(s, d)),
    f"with {_tokens} select p2 as w1, p1 as w2, norm as w3, count(*) as cnt, round(ln(count(*)), 4) as log_freq from t where p2 in (select w1 from u) and p1 in (select w1 from u) and norm in (select w1 from u) group by 1, 2, 3 having count(*) >= 2",
)
R.add(
    "agg1_capitals",
    lambda s, d: ngrams.capitals(_tokens_of(s, d)),
    f"""with {_tokens}, c as (select norm as w1, token, count(*) as n from t group by 1, 2), a as (select w1, sum(n) as total, arg_max(token, (n, token)) as preferred from c group by 1)
    select w1, preferred from a where total >= 2 and preferred <> w1""",
)
R.add("agg1_stats", lambda s, d: ngrams.stats(table(s, d, "corpus_lines")), f"with {_vertical} select file, sum(sentence_end::int)::bigint as sentences, sum(malformed::int)::bigint as malformed_rows, count(token) as valid_rows from v group by 1")


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every token after its two neighbours as a candidate; the word that follows is the one most often seen there."""
    toks = _counted_from(spark, folder)
    uni, bi, tri = cut(ngrams.unigrams(toks)), cut(ngrams.bigrams(toks)), ngrams.trigrams(toks)
    following = bi.groupBy(F.col("w1").alias("word")).agg(F.max_by("w2", F.struct("cnt", "w2")).alias("next"))
    candidates = toks.select(F.col("norm").alias("word"), F.col("p1").alias("prev"), F.col("p2").alias("prev_prev")).distinct().join(following, "word", "left")
    return ngrams.score(candidates, uni, bi, tri).select("word", "prev", "prev_prev", "next", "bonus")


R.add(
    "rnk1_scores",
    _scores,
    f"""with {_tokens}, bi as (select p1, norm, count(*) as n, round(ln(count(*)), 4) as f from t where p1 in (select w1 from u) and norm in (select w1 from u) group by 1, 2 having count(*) >= 2),
    tri as (select p2, p1, norm, round(ln(count(*)), 4) as f from t where p2 in (select w1 from u) and p1 in (select w1 from u) and norm in (select w1 from u) group by 1, 2, 3 having count(*) >= 2),
    nx as (select p1 as word, arg_max(norm, (n, norm)) as next from bi group by 1),
    x as (select max(round(ln(cnt), 4)) as top from u), c as (select distinct norm, p1, p2 from t),
    s as (select c.norm as word, c.p1 as prev, c.p2 as prev_prev, nx.next, greatest(0.0, least(1.0, coalesce(round(ln(u.cnt), 4), 0.0) / top)) as a, greatest(0.0, least(1.0, coalesce(bi.f, 0.0) / top)) as b,
      greatest(0.0, least(1.0, coalesce(b2.f, 0.0) / top)) as b2, greatest(0.0, least(1.0, coalesce(tri.f, 0.0) / top)) as t3
      from c cross join x left join nx on nx.word = c.norm left join u on u.w1 = c.norm left join bi on bi.p1 = c.p1 and bi.norm = c.norm left join bi b2 on b2.p1 = c.norm and b2.norm = nx.next left join tri on tri.p2 = c.p2 and tri.p1 = c.p1 and tri.norm = c.norm)
    select word, prev, prev_prev, next, round(least(0.25::double, a * 0.1::double + b * (0.25::double * 0.35::double) + b2 * (0.25::double * 0.25::double) + t3 * (0.25::double * 0.2::double)), 4) as bonus from s""",
)
R.add("p4_found", lambda s, d: rows.found(table(s, d, "verb_raw"), table(s, d, "corpus_lines"), table(s, d, "corpus_meta")))
_field = '(?:"(?:[^"]|"")*"|[^",]*)'
_raw_tag = r"(?:[TQS]-\p{L}+-F(?:[1-9]|10)|AS-\p{L}+)-(?:PERF|MPERF|IMP)-(?:1S|2S|3SM|3SF|1P|2P|3P)(?:-N)?"
_verb_raw = f"""p as (select row_id, source_file, coalesce(line, '') as line, regexp_extract_all(',' || coalesce(line, ''), '(?s),({_field})', 1) as f from verb_raw),
    c as (select row_id, source_file, line, len(f) as n, list_transform(f, lambda x: case when starts_with(x, '"') then replace(substr(x, 2, greatest(length(x) - 2, 0)), '""', '"') else x end) as f from p),
    j as (select *, case when not regexp_full_match(line, '(?s){_field}(?:,{_field})*') then 'quoting' when n <> 4 then 'columns'
      when not regexp_full_match(f[1], '[1-9][0-9]{{0,8}}') or trim(f[2]) = '' or not regexp_full_match(f[3], '{_raw_tag}') then 'value' end as reason from c)"""
_corpus = r"""q as (select row_id, split(line, '|') as f from corpus_lines where line is not null and trim(line, e' \t\r\n') <> '' and not regexp_matches(line, '^[#<]')),
    z as (select row_id, list_transform(f, lambda x: trim(x, e' \t\r\n')) as f from q),
    y as (select row_id, f, case when len(f) <> 4 then 'columns' when length(f[1]) not between 1 and 80 or not regexp_matches(f[1], '\p{L}') or regexp_matches(f[1], '\p{Nd}|<') or regexp_matches(f[1], '(?i)https?:|www\.')
      or f[2] not in ('NOUN','VERB','ADJ','PRON','PRP','CONJ','ADV','DEF','PART','X_ENG') or f[3] = '' then 'value' end as reason from z)"""
_meta = r"""n as (select row_id, meta_json as t, coalesce(json_valid(meta_json), false) and not regexp_matches(meta_json, 'NaN|Infinity|,\s*[}\]]') as ok from corpus_meta),
    o as (select row_id, case when not ok then 'quoting' when coalesce(json_type(t, '$.stats'), '') <> 'OBJECT' or not json_exists(t, '$.stats.malformed_rows') then 'columns'
      when json_type(t, '$.stats.malformed_rows') not in ('UBIGINT', 'BIGINT', 'HUGEINT') or starts_with(json_extract(t, '$.stats.malformed_rows')::varchar, '-') then 'value' end as reason from n)"""
R.oracle["p4_found"] = f"""with {_verb_raw}, {_corpus}, {_meta} select 'verb_raw' as table_name, row_id, reason from j where reason is not null
    union all select 'corpus_lines', row_id, reason from y where reason is not null union all select 'corpus_meta', row_id, reason from o where reason is not null"""
R.add(
    "p4_verbs",
    lambda s, d: rows.load_verb_raw(table(s, d, "verb_raw"))[0].select("row_id", "source_file", "line_number", "word", "raw_tag", "gloss", "tag_prefix", "root", "form_class", "tense", "person", "negative"),
    f"""with {_verb_raw}, k as (select row_id, source_file, f[1]::int as line_number, f[2] as word, f[3] as raw_tag, f[4] as gloss, split(regexp_replace(f[3], '-N$', ''), '-') as p from j where reason is null)
    select row_id, source_file, line_number, word, raw_tag, gloss, p[1] as tag_prefix, p[2] as root, case when p[1] = 'AS' then 'S' else p[3] end as form_class, p[len(p) - 1] as tense, p[len(p)] as person, ends_with(raw_tag, '-N') as negative from k""",
)
R.add(
    "p4_tokens",
    lambda s, d: rows.load_corpus_lines(table(s, d, "corpus_lines"))[0].select("row_id", "file", "line_no", "surface", "tag", "lemma", "root"),
    f"with {_corpus} select y.row_id, c.file, c.line_no, f[1] as surface, f[2] as tag, f[3] as lemma, case when f[4] <> '' then f[4] end as root from y join corpus_lines c using (row_id) where reason is null",
)
R.add("p4_builds", lambda s, d: rows.load_corpus_meta(table(s, d, "corpus_meta"))[0].select("row_id", "file", "built_at", "meta.corpus_revision", "meta.stats.total_tokens", "malformed_rows"))


def _lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.unigrams(_tokens_of(spark, folder)).select(F.col("w1").alias("word"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.tokenize(table(spark, folder, "create_log"), "row_id", "input")


_words = r"""d as (select row_id as doc_id, unnest(regexp_extract_all(coalesce(input, ''), '[\p{L}\p{M}''’]+')) as word from create_log),
    e as (select doc_id, lower(trim(replace(replace(replace(word, '’', ''''), 'ʼ', ''''), '‘', ''''))) as word from d where not regexp_matches(word, '[̇̀]'))"""
R.add(
    "agg5_coverage",
    lambda s, d: evidence.coverage(_texts(s, d).where(~F.col("word").rlike("[̀̇]")), _lexicon(s, d)),
    f"""with {_tokens}, {_words}, g as (select doc_id, word, count(*) as n from e where word <> '' group by 1, 2)
    select doc_id, sum(n)::bigint as total_tokens, sum(case when word in (select w1 from u) then n else 0 end)::bigint as recognized_tokens, count(*) filter (word not in (select w1 from u)) as unrecognized_words,
    round(100 * sum(case when word in (select w1 from u) then n else 0 end) / sum(n), 1) as coverage_pct from g group by 1""",
)
R.add("agg5_unrecognized", lambda s, d: evidence.unrecognized(_texts(s, d), _lexicon(s, d)))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The verb records under the key of their word, as the tokens of a text meet them."""
    return records(spark, folder).withColumn("word", key(F.col("word"))).where("word <> ''")


def _features(spark: SparkSession, folder: str) -> DataFrame:
    """Word classes of the corpus tags, genders and numbers of the dictionary tags, persons of the verb records, and the closed classes."""
    loaded, _ = rows.load_corpus_lines(table(spark, folder, "corpus_lines"))
    has = lambda t: F.max((F.col("tag") == t).cast("int")).cast("boolean")
    corpus = loaded.groupBy(F.lower("surface").alias("word")).agg(has("NOUN").alias("c_noun"), has("ADJ").alias("c_adjective"), has("VERB").alias("c_verb"))
    tags = L.tag_features(table(spark, folder, "name_list").where("trim(surface) <> ''").select("surface", "payload")).withColumnRenamed("prefixes", "tags")
    found = _records(spark, folder)
    finite = lambda c: F.when((F.col("tense") != "IMP") & (F.col("person") != ""), c)
    allows = grammar.allows_adjective(F.col("root"), F.col("form_class"))
    verbs = found.groupBy("word").agg(
        F.array_sort(F.collect_set(finite(F.col("person")))).alias("persons"),
        F.max(finite(F.col("tense") == "PERF")).alias("perf"),
        F.max(finite(F.col("tense") == "MPERF")).alias("mperf"),
        F.min_by(allows, F.when(allows.isNotNull(), F.struct("line_number", "row_id"))).alias("allows"),
        F.lit(True).alias("has_records"),
    )
    closed = spark.createDataFrame([(w, grammar.PRONOUNS.get(w), w in grammar.NUMERALS) for w in sorted({*grammar.PRONOUNS, *grammar.NUMERALS})], "word string, pronoun string, numeral boolean")
    every = corpus.join(tags, "word", "full_outer").join(verbs, "word", "full_outer").join(closed, "word", "full_outer")
    is_any = lambda *names: reduce(lambda a, b: a | b, (F.coalesce(n, F.lit(False)) for n in names))
    tagged = lambda *names: F.arrays_overlap("tags", F.array(*[F.lit(n) for n in names]))
    noun_person = F.when(tagged("SINGNOUNF"), "3SF").when(tagged("SINGNOUNM"), "3SM").when(tagged("PLUNOUN", "PAUCNOUN", "COLLNOUN"), "3P")
    return every.select(
        "word",
        is_any("c_noun", "is_noun").alias("is_noun"),
        is_any("c_adjective", "is_adjective").alias("is_adjective"),
        is_any("is_numeral", "numeral").alias("is_numeral"),
        is_any("c_verb", "has_records").alias("is_verb"),
        *("noun_gender", "noun_number", "adjective_gender", "adjective_number", "persons", "perf", "mperf"),
        F.coalesce("pronoun", noun_person).alias("person"),
        # A verb without records has no root to be judged by.
        (F.col("has_records").isNull() | F.coalesce(F.col("allows") == "all", F.lit(False))).alias("predicative"),
        F.coalesce(F.col("allows") == "lasting", F.lit(False)).alias("lasting"),
    )


def _analyzed(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of all rules with the variants that they suggest; every rule reads the features, so they are made once."""
    features = cut(_features(spark, folder))
    adjectives = features.where("is_adjective")
    anchors = adjectives.select("word", anchor(F.col("word")).alias("anchor")).where("anchor <> ''")
    by = lambda wanted: grammar.adjective_variants(adjectives, anchors, wanted=wanted)
    return grammar.analyze(_texts(spark, folder), features, cut(paradigm(_records(spark, folder))), by("adjective_gender"), by("adjective_number"))


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.with_neighbours(grammar.featured(_texts(spark, folder), _features(spark, folder)))


_short = ("doc_id", "start", "end", "surface", "suggestion")
R.add("win_findings", _analyzed)
_positions = r"""d as (select row_id as doc_id, regexp_extract_all(coalesce(input, ''), '[\p{L}\p{M}''’]+') as ws from create_log),
    e as (select doc_id, unnest(range(len(ws)))::int as pos, unnest(ws) as word, len(ws)::int as n from d),
    k as (select doc_id, pos, word, n, lower(replace(word, '’', '''')) as norm from e),
    x as (select *, lead(word) over o as n_word, lead(norm) over o as n_norm, max(ends_with(norm, 'x')) over (partition by doc_id order by pos rows between 1 following and 4 following) as ahead from k window o as (partition by doc_id order by pos))"""
R.add("win6_confusables", lambda s, d: grammar.confusables(_neighbours(s, d)).select(*_short), f"""with {_positions} select doc_id, pos as start, pos + 1 as "end", word as surface, norm as suggestion from x where norm in ('hu', 'u', 'ħu')""")
R.add("win7_negation", lambda s, d: grammar.negation(_neighbours(s, d)).select(*_short), f"""with {_positions} select doc_id, pos as start, least(n, pos + 5)::int as "end", word as surface, 'ma ... x' as suggestion from x where norm = 'ma' and ahead""")
R.add(
    "win5_min_minn",
    lambda s, d: grammar.min_minn(_neighbours(s, d)).select(*_short),
    f"""with {_positions} select doc_id, pos as start, pos + 1 as "end", word as surface, case when coalesce(regexp_matches(n_word, '^\\p{{Lu}}'), false) then 'minn' else 'min' end as suggestion from x where norm = 'min'""",
)
R.add(
    "win10_li_adjective",
    lambda s, d: grammar.li_adjective(_neighbours(s, d)).select(*_short),
    f"""with {_corpus}, {_positions.replace("d as", "dd as", 1).replace("from d)", "from dd)", 1)}, a as (select distinct lower(f[1]) as w from y where reason is null and f[2] = 'ADJ')
    select doc_id, pos as start, pos + 2 as "end", word || ' ' || n_word as surface, 'l-' || n_word as suggestion from x where norm = 'li' and n_norm in (select w from a) and n_norm not in ('hafna','naqra','iktar','inqas','anqas')""",
)


def _phrases(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.operators.articles import phrases
    from textloom.plans.words import _nouns

    return phrases(_texts(spark, folder), _nouns(spark, folder))


R.add("win14_phrases", _phrases)
R.add("win11_contractions", lambda s, d: grammar.contractions(_phrases(s, d).select("doc_id", "pos", F.col("original").alias("word"), "corrected")))


def _rewritten(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.rewrite(_texts(spark, folder), _analyzed(spark, folder))


R.add("win13_rewritten", _rewritten)


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.operators.check import check

    return check(table(spark, folder, "create_log"), _lexicon(spark, folder), "row_id", "input", ngrams.unigrams(_tokens_of(spark, folder))).select("row_id", "corrected_text", "changed", "unrecognized")


R.add("api1_check", _checked)


def _health(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.operators.check import health

    return health(forms(spark, folder), records(spark, folder), ngrams.unigrams(_tokens_of(spark, folder)))


R.add("api6_health", _health)
QUERIES, ORACLE = R.queries, R.oracle
