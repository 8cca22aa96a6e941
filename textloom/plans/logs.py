"""Queries over the logs: choices, evidence, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import evidence
from textloom.plans.registry import Registry
from textloom.session import table
from textloom.streaming import choices

R = Registry()

R.add("stm2_once", lambda s, d: choices.once(table(s, d, "update_choice")).select("row_id", "log_id", "event_id"), "select row_id, log_id, event_id from update_choice qualify row_number() over (partition by log_id, event_id order by received_at, row_id) = 1")
R.add("snk5_requests", lambda s, d: choices.first_requests(table(s, d, "create_log")).select("row_id", "log_id"), "select row_id, log_id from create_log where log_id is not null qualify row_number() over (partition by log_id order by received_at, row_id) = 1")
R.add(
    "stm4_folded",
    lambda s, d: choices.folded(table(s, d, "create_log"), table(s, d, "update_choice")),
    r"""with o as (select * from update_choice where log_id is not null qualify row_number() over (partition by log_id, event_id order by received_at, row_id) = 1),
    t as (select log_id, token, min((received_at, row_id)) as first, arg_max(coalesce(token, '') || ' -> ' || coalesce(chosen, ''), (received_at, row_id)) as line from o group by 1, 2),
    n as (select log_id, string_agg(line, chr(10) order by first) as chosen_notes from t group by 1),
    e as (select log_id, count(*) as n_events from o group by 1),
    l as (select log_id, final_output as last_output from o where final_output is not null qualify row_number() over (partition by log_id order by received_at desc, row_id desc) = 1),
    r as (select log_id, input, final_output from create_log where log_id is not null qualify row_number() over (partition by log_id order by received_at, row_id) = 1),
    c as (select e.log_id, n_events, chosen_notes, last_output from e join n using (log_id) left join l using (log_id))
    select coalesce(r.log_id, c.log_id) as log_id, input, coalesce(last_output, final_output) as final_output, coalesce(chosen_notes, '') as chosen_notes, coalesce(n_events, 0) as n_events, r.log_id is null as placeholder from r full join c on r.log_id = c.log_id""",
)
R.add(
    "stm1_sentences",
    lambda s, d: choices.sentences(table(s, d, "corpus_lines")),
    "select file, line_no, row_id, sum((trim(coalesce(line, '')) = '' or starts_with(trim(line), '<') or starts_with(trim(line), '#'))::int) over (partition by file order by line_no, row_id)::bigint as sentence from corpus_lines",
)
R.add(
    "snk2_capped",
    lambda s, d: choices.capped(table(s, d, "update_choice").select("row_id", "token", "chosen")),
    "select row_id, case when token[1] in ('=','+','-','@') then '''' || substr(token, 1, 500) else substr(token, 1, 500) end as token, case when chosen[1] in ('=','+','-','@') then '''' || substr(chosen, 1, 500) else substr(chosen, 1, 500) end as chosen from update_choice",
)
R.add(
    "flt11_requests",
    lambda s, d: choices.checked_requests(table(s, d, "create_log"), "input", 1500).select("row_id", "error"),
    "select row_id, case when input is null then 'missing' when trim(input) = '' then 'blank' when length(input) > 1500 then 'too_long' end as error from create_log",
)


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = choices.once(table(spark, folder, "update_choice")).where("token is not null and suggestions is not null")
    spread = rows.select("token", "chosen", F.posexplode("suggestions").alias("ord", "word"))
    level = F.when(F.col("word") == F.col("chosen"), "exact").when(F.col("ord") == 0, "high").otherwise("low")
    return spread.select("token", "word", F.when(F.col("word") == F.col("chosen"), "choice").otherwise("suggestion").alias("source"), F.lit("word").alias("candidate_type"), level.alias("level"), F.lit(None).cast("double").alias("confidence"), F.lit("").alias("reason"), F.col("ord").cast("bigint").alias("ord"))


R.add(
    "agg2_evidence",
    lambda s, d: evidence.pool(_evidence(s, d), ("token",)).select("token", "word", F.array_join("sources", ",").alias("sources"), "confidence", "first"),
    r"""with o as (select * from update_choice qualify row_number() over (partition by log_id, event_id order by received_at, row_id) = 1),
    e as (select token, chosen, unnest(suggestions) as word, unnest(range(len(suggestions))) as ord from o where token is not null and suggestions is not null),
    k as (select token, lower(trim(replace(replace(replace(word, '’', ''''), 'ʼ', ''''), '‘', ''''))) as w, case when word = chosen then 'choice' else 'suggestion' end as source, case when word = chosen then 1.0::double when ord = 0 then 0.82::double else 0.38::double end as weight, ord from e)
    select token, w as word, array_to_string(list_sort(list(distinct source)), ',') as sources, max(weight) as confidence, min(ord)::bigint as first from k where w <> '' group by 1, 2""",
)


def _with_corpus(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.operators import ngrams

    uni = ngrams.unigrams(ngrams.tokens(table(spark, folder, "corpus_lines")))
    bonus = uni.select(F.col("w1").alias("word"), F.round(F.col("log_freq") / 100, 4).alias("bonus"))
    pooled = evidence.pool(_evidence(spark, folder).drop("token"))
    return evidence.with_corpus(pooled, bonus)


R.add("agg3_corpus_evidence", lambda s, d: _with_corpus(s, d).select("word", F.array_join("sources", ",").alias("sources"), "confidence", "corpus_score"))
R.add("agg4_diagnostics", lambda s, d: evidence.diagnostics(_with_corpus(s, d)))
R.add(
    "agg7_accuracy",
    lambda s, d: evidence.accuracy(table(s, d, "update_choice").select(F.col("chosen").alias("expected"), F.col("token").alias("before"), F.get("suggestions", F.lit(0)).alias("after"))),
    r"""with k as (select coalesce(lower(trim(token)) = lower(trim(chosen)), false) as b, coalesce(lower(trim(suggestions[1])) = lower(trim(chosen)), false) as a from update_choice)
    select case when not b and a then 'improved' when b and not a then 'regressed' when a then 'right' else 'wrong' end as outcome, count(*) as cases from k group by 1""",
)
QUERIES, ORACLE = R.queries, R.oracle
