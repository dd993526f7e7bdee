"""Queries on question/answer records: loading, metrics, aggregates, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .base import query, sql

# DuckDB forms of the building blocks. Its \b knows ASCII only, so articles are dropped from the split words.
_PAIRS = """(select conv_id, turn, text as question, nr as next_role, nt as prediction from
  (select conv_id, turn, role, text, lead(role) over w as nr, lead(text) over w as nt from conversations window w as (partition by conv_id order by turn, role, text))
  where role = 'user' and nr = 'assistant')"""


def _words(column: str) -> str:
    bare = rf"regexp_replace(lower({column}), '[!-/:-@\[-`{{-~]', '', 'g')"
    return f"list_filter(regexp_split_to_array({bare}, '\\s+'), lambda x: x not in ('a', 'an', 'the', ''))"


_WORDED = f"(select conv_id, turn, question, prediction, {_words('question')} as g, {_words('prediction')} as p from {_PAIRS})"


def _extracted(column: str) -> str:
    """What follows the first answer mark, cleaned; the data has no completion objects."""
    marked = " ".join(f"when regexp_matches({column}, '(?is){m}') then regexp_extract({column}, '(?is){m}\\s*(.*)', 1)" for m in ("Answer:", "答案:", "A:", "回答:"))
    cut = rf"regexp_replace(case {marked} else {column} end, '(?s), additional_kwargs=.*$', '')"
    ended = rf"regexp_replace({cut}, '(?is)(\n\n|\n-|\n(Explanation|Reasoning|Context|Question):).*$', '')"
    return rf"regexp_replace(regexp_replace({ended}, '^\s+|\s+$', '', 'g'), '\.+$', '')"


_ANSWERED = f"(select conv_id, turn, question, prediction, {_words('question')} as g, {_words(_extracted('prediction'))} as p from {_PAIRS})"
_SAME = "list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x)))))"
_F1 = f"case when len(p) = 0 or len(g) = 0 then (len(p) = len(g))::int::double else 2.0 * {_SAME} / (len(p) + len(g)) end"


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, prediction): a user turn and the assistant turn right after it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(order), "prediction": F.lead("text").over(order)})
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "prediction")


@query(f"select conv_id, turn, question, prediction from {_PAIRS}")
def qa_pairs_from_turns(spark, sf_dir):
    return qa_pairs(spark, sf_dir)


@query(f"select conv_id, count(*)::bigint as n, round(avg({_F1}), 6) as f1, round(avg((array_to_string(p, ' ') = array_to_string(g, ' '))::int), 6) as em from {_ANSWERED} group by conv_id")
def answer_quality_report(spark, sf_dir):
    p, q = F.col("prediction"), F.col("question")
    return qa_pairs(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(T.token_f1(p, q)), 6).alias("f1"), F.round(F.avg(T.exact_match(p, q)), 6).alias("em"))


@query(f"select doc_id, array_to_string({_words('text')}, ' ') as norm from documents")
def answer_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query(f"select conv_id, turn, (array_to_string(p, ' ') = array_to_string(g, ' '))::int::double as em from {_ANSWERED}")
def answer_exact_match(spark, sf_dir):
    return qa_pairs(spark, sf_dir).select("conv_id", "turn", T.exact_match(F.col("prediction"), F.col("question")).alias("em"))


@query(f"select conv_id, turn, round({_F1}, 6) as f1 from {_ANSWERED}")
def answer_token_f1(spark, sf_dir):
    return qa_pairs(spark, sf_dir).select("conv_id", "turn", F.round(T.token_f1(F.col("prediction"), F.col("question")), 6).alias("f1"))


@query(f"select conv_id, turn, case when len(g) = 0 then 0.0 else (len(list_filter(g, lambda x: not list_contains(p, x))) = 0)::int::double end as covered, round(case when len(p) = 0 then 0.0 else len(list_intersect(list_distinct(p), g))::double / len(list_distinct(p)) end, 6) as faithful from {_WORDED}")
def answer_coverage_faithfulness(spark, sf_dir):
    p, q = F.col("prediction"), F.col("question")
    return qa_pairs(spark, sf_dir).select("conv_id", "turn", T.coverage(p, q).alias("covered"), F.round(T.faithfulness(p, q), 6).alias("faithful"))


@query()
def rouge_l(spark, sf_dir):
    return qa_pairs(spark, sf_dir).select("conv_id", "turn", F.round(T.rouge_l(F.col("prediction"), F.col("question")), 6).alias("rouge_l"))


@query(f"with b as (select item_id, list_distinct({_words('text')}) as w from benchmark) select a.item_id as a_id, b.item_id as b_id, round(len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))), 6) as jaccard from b a join b on a.item_id < b.item_id where len(list_intersect(a.w, b.w)) > 0")
def jaccard_text_similarity(spark, sf_dir):
    """Only pairs that share a word: found by their words, so no pair without overlap is made."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    each = items.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = each.select(F.col("item_id").alias("a_id"), F.col("n").alias("a_n"), "word"), each.select(F.col("item_id").alias("b_id"), F.col("n").alias("b_n"), "word")
    same = a.join(b, "word").where("a_id < b_id").groupBy("a_id", "b_id", "a_n", "b_n").agg(F.count(F.lit(1)).alias("both"))
    return same.select("a_id", "b_id", F.round(F.col("both") / (F.col("a_n") + F.col("b_n") - F.col("both")), 6).alias("jaccard"))


@query(f"with s as (select conv_id, turn, list_distinct(p) as p, list_distinct(g) as g from {_WORDED}) select conv_id, turn, case when len(p) = 0 or len(g) = 0 then (len(p) = len(g))::int::double else (len(list_intersect(p, g)) = len(p) and len(p) = len(g))::int::double end as em, round(case when len(p) = 0 or len(g) = 0 then (len(p) = len(g))::int::double else 2.0 * len(list_intersect(p, g)) / (len(p) + len(g)) end, 6) as f1 from s")
def supporting_fact_scores(spark, sf_dir):
    em, f1 = T.set_scores(T.tokens(F.col("prediction")), T.tokens(F.col("question")))
    return qa_pairs(spark, sf_dir).select("conv_id", "turn", em.alias("em"), F.round(f1, 6).alias("f1"))


_TYPE = "case when contains(lower(question), 'when') and (contains(lower(question), 'die') or contains(lower(question), 'death')) then 'temporal_death' when contains(lower(question), 'who') and (contains(lower(question), 'mother') or contains(lower(question), 'father')) then 'family_relation' when contains(lower(question), 'where') then 'location' when contains(lower(question), 'what') then 'factual' when contains(lower(question), 'are') and contains(lower(question), 'both') then 'comparison' else 'other' end"


@query(f"select {_TYPE} as qtype, count(*)::bigint as n, round(avg({_F1}), 6) as f1 from {_ANSWERED} group by 1")
def question_type_report(spark, sf_dir):
    rows = qa_pairs(spark, sf_dir).select(T.question_type(F.col("question")).alias("qtype"), T.token_f1(F.col("prediction"), F.col("question")).alias("f1"))
    return rows.groupBy("qtype").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("f1"))


@query("select event_id, concat('Predict_Score: ', (event_id % 150)::varchar) as raw, least(1.0, case when event_id % 150 > 1 then (event_id % 150) / 100.0::double else (event_id % 150)::double end) as score from events")
def score_parse(spark, sf_dir):
    raw = F.concat(F.lit("Predict_Score: "), (F.col("event_id") % 150).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), T.predicted_score(raw).alias("score"))


@query("select event_id, list_transform(list_filter([event_id % 7, event_id % 5], lambda x: x between 1 and 4), lambda x: (x - 1)::int) as places from events where len(list_filter([event_id % 7, event_id % 5], lambda x: x between 1 and 4)) > 0 union all select event_id, [0, 1, 2, 3] from events where len(list_filter([event_id % 7, event_id % 5], lambda x: x between 1 and 4)) = 0")
def ranking_parse(spark, sf_dir):
    raw = F.concat(F.lit("["), (F.col("event_id") % 7).cast("string"), F.lit("] > ["), (F.col("event_id") % 5).cast("string"), F.lit("]"))
    return table(spark, sf_dir, "events").select("event_id", T.ranking(raw, F.lit(4)).alias("places"))


@query("select doc_id, list_filter(list_transform(list_filter(list_transform(string_split(concat('1. ', replace(text, chr(10), concat(chr(10), '- '))), chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^(\\d+[.)]|[-*])\\s*\\S')), lambda x: regexp_replace(x, '^(\\d+[.)]|[-*])\\s*', '')), lambda x: length(x) > 5) as items from documents")
def numbered_list_parse(spark, sf_dir):
    listed = F.concat(F.lit("1. "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n- ")))
    return table(spark, sf_dir, "documents").select("doc_id", T.numbered_items(listed).alias("items"))


@query(f"select count(*)::bigint as n, round(coalesce(avg({_F1}), 0), 6) as f1, round(coalesce(sum({_F1} * (turn + 1)) / sum(turn + 1), 0), 6) as weighted_f1, round(avg(case when conv_id % 10 < 7 then {_F1} end), 6) as train_f1, round(avg(case when conv_id % 10 >= 7 then {_F1} end), 6) as test_f1 from {_ANSWERED}")
def metric_summary(spark, sf_dir):
    rows = qa_pairs(spark, sf_dir).select("conv_id", (F.col("turn") + 1).alias("w"), T.token_f1(F.col("prediction"), F.col("question")).alias("f1"))
    train = F.col("conv_id") % 10 < 7
    mean = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.agg(F.count(F.lit(1)).alias("n"), mean(F.avg("f1")).alias("f1"), mean(F.sum(F.col("f1") * F.col("w")) / F.sum("w")).alias("weighted_f1"), F.round(F.avg(F.when(train, F.col("f1"))), 6).alias("train_f1"), F.round(F.avg(F.when(~train, F.col("f1"))), 6).alias("test_f1"))


_TOKENS = "select event_type, case when event_type in ('click', 'view') then 'agent' else 'rag' end as call_type, cast(event_id % 1000 as bigint) as tokens from {events}"
sql("token_usage_by_call_type", f"select call_type, count(*) as calls, cast(sum(tokens) as bigint) as tokens, cast(floor(sum(tokens) * 0.7) as bigint) as train_tokens from ({_TOKENS}) group by call_type")
sql("llm_cost", f"select call_type, round(sum(case when call_type = 'agent' then cast(tokens as double) * 0.15 / 1000000 else cast(tokens as double) * 4 * 0.02 / 1000000 end), 9) as cost from ({_TOKENS}) group by call_type")
sql("run_time_stats", "select event_type, count(*) as n, min(value) as least, max(value) as most, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, sum(case when event_type <> 'error' then 1 else 0 end) as succeeded from {events} group by event_type", "select event_type, count(*) as n, min(value) as least, max(value) as most, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, sum(case when event_type <> 'error' then 1 else 0 end)::bigint as succeeded from events group by event_type")
sql("incremental_config_average", """
with half as (select user_id % 20 as config, event_id % 2 as part, avg(value) as mean, count(*) as n from {events} group by user_id % 20, event_id % 2)
select config, cast(sum(n) as bigint) as evaluations, round(sum(mean * n) / sum(n), 6) as mean from half group by config""")
sql("question_type_merge", """
with a as (select source as qtype, count(*) as n, avg(n_chars) as m from {documents} where doc_id % 2 = 0 group by source),
     b as (select source as qtype, count(*) as n, avg(n_chars) as m from {documents} where doc_id % 2 = 1 group by source)
select coalesce(a.qtype, b.qtype) as qtype, round((coalesce(a.m * a.n, 0) + coalesce(b.m * b.n, 0)) / (coalesce(a.n, 0) + coalesce(b.n, 0)), 6) as mean
from a full outer join b on a.qtype = b.qtype""")
sql("factorize_partition", """
with f as (select source, min(doc_id) as first_id from {documents} group by source),
     k as (select source, row_number() over (order by first_id) - 1 as book from f)
select d.doc_id, cast(k.book as bigint) as book, case when k.book < 1 then 'sample' when k.book < 8 then 'train' when k.book < 15 then 'test' else 'holdout' end as part
from {documents} d join k on d.source = k.source""")
sql("range_partition", """
with p as (select 'a' as part, 0 as lo, 100 as hi union all select 'b', 100, 400 union all select 'c', 400, 500)
select p.part, count(*) as n, min(d.doc_id) as least from {documents} d join p on d.doc_id >= p.lo and d.doc_id < p.hi group by p.part""")
sql("split_stats", """
with o as (select doc_id, source, row_number() over (partition by source order by (doc_id * 2654435761) % 1000003, doc_id) as r, count(*) over (partition by source) as n from {documents})
select source, cast(max(n) as bigint) as n, sum(case when r <= floor(n * 0.7) then 1 else 0 end) as train, sum(case when r <= floor(floor(n * 0.7) * 0.3) then 1 else 0 end) as selected,
       round(sum(case when r <= floor(n * 0.7) then 1 else 0 end) / cast(max(n) as double), 6) as train_share
from o group by source""", """
with o as (select doc_id, source, row_number() over (partition by source order by (doc_id * 2654435761) % 1000003, doc_id) as r, count(*) over (partition by source) as n from documents)
select source, cast(max(n) as bigint) as n, sum(case when r <= floor(n * 0.7) then 1 else 0 end)::bigint as train, sum(case when r <= floor(floor(n * 0.7) * 0.3) then 1 else 0 end)::bigint as selected,
       round(sum(case when r <= floor(n * 0.7) then 1 else 0 end) / cast(max(n) as double), 6) as train_share
from o group by source""")
sql("context_to_map", "select conv_id, count(*) as turns, max(case when role = 'system' then text end) as system from {conversations} group by conv_id")
sql("line_counts", "select source, count(*) as records, cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) as bigint) as lines from {documents} group by source")
sql("merge_selected_and_test", """
select doc_id, 'selected' as part from {documents} where doc_id % 5 = 0
union all select doc_id, 'test' as part from (select doc_id from {documents} order by doc_id desc limit 200) t""")
sql("kb_export", """
select c.c_custkey as config, coalesce(avg(o.o_totalprice), c.c_acctbal) as average, coalesce(max(o.o_totalprice), c.c_acctbal) as best, coalesce(min(o.o_totalprice), c.c_acctbal) as worst, count(o.o_orderkey) as evaluations
from {customer} c left join {orders} o on o.o_custkey = c.c_custkey group by c.c_custkey, c.c_acctbal""".replace("coalesce(avg(o.o_totalprice), c.c_acctbal)", "round(coalesce(avg(o.o_totalprice), c.c_acctbal), 6)"))
sql("html_title", r"select page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) as title from {pages}")
