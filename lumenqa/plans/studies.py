"""Queries on studies: the functions of operators.studies on a table of trials that is made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import studies as S
from ..operators import trials as T
from ..sources.tables import table
from .base import query

_STATE = "case when event_id % 11 = 0 then 'FAIL' when event_id % 17 = 0 then 'RUNNING' else 'COMPLETE' end"
_FAILED = "event_id % 13 = 0"
_VALUE1 = "case when event_id % 29 = 0 then cast('infinity' as double) when event_id % 31 = 0 then null else cast(user_id % 50 as double) / 10 end"
_MODE = "case when event_id % 19 = 0 then null when event_id % 3 = 0 then 'rag' else 'no_rag' end"
_RETRIEVER = "case event_id % 4 when 0 then 'sparse' when 1 then 'dense' else 'hybrid' end"
_MODEL = "concat('model-', event_id % 5)"
_LLM = "case event_id % 6 when 0 then 'a/llm-large' when 1 then 'b/llm-small' else null end"
_MESSAGE = "case when event_id % 5 = 0 then null else concat('took t=', event_id % 3, '.', event_id % 7, ' of ', event_type) end"
_CLASS = "case event_id % 4 when 0 then 'TimeoutError' when 1 then 'ValueError' else null end"
_FLOW = """concat('{"rag_mode": "', {mode}, '", "top_k": "', event_id % 23, '"}')"""
_ROW = f"""event_type as study_name, event_id as number, {_STATE} as state, {_FAILED} as failed, value / 500 as values_0, {_VALUE1} as values_1, ts as datetime_start,
  cast(event_id % 600 as double) as duration, {_RETRIEVER} as params_retriever, {_MODEL} as params_embedding_model, {_LLM} as params_no_rag_llm_name,
  cast(value as double) / 7 as params_temperature, event_id % 40 as num_success, 40 as num_total, event_id % 9 as num_errors, event_id % 23 = 0 as is_pruned, event_id % 37 = 0 as is_seeding,
  value / 1000 as llm_cost_total, {_CLASS} as exception_class, {_MESSAGE} as exception_message, case when event_id % 2 = 0 then 'p80_time' else 'latency' end as objective_2_name"""
#: The trials as DuckDB makes them.
DUCK = f"""(select {_ROW}, ts + to_seconds(event_id % 600) as datetime_complete, {_MODE} as mode, event_id % 23 as top_k from events)"""


def trials(spark, sf_dir):
    flow = F.expr(_FLOW.replace("{mode}", f"({_MODE})"))
    done = F.expr("cast(cast(ts as timestamp) + make_interval(0, 0, 0, 0, 0, 0, event_id % 600) as timestamp_ntz)")
    return table(spark, sf_dir, "events").select(*[F.expr(x) for x in _columns(_ROW)], done.alias("datetime_complete"), flow.alias("flow"))


def _columns(text: str) -> list[str]:
    """The entries of a select list, split at commas outside brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@query(f"with c as (select * from {DUCK} where state = 'COMPLETE' and not failed and values_0 is not null and values_1 is not null) select c.study_name, number, round(values_0, 6) as v0, round(params_temperature, 4) as temperature from c join (select study_name, max(num_success) as most from c group by study_name) m using (study_name) where num_success >= 0.5 * most")
def completed_trials(spark, sf_dir):
    done = S.completed_trials(trials(spark, sf_dir), 0.5)
    return done.select("study_name", "number", F.round("values_0", 6).alias("v0"), F.round("params_temperature", 4).alias("temperature"))


@query(f"select study_name, count(*) as n, count(a)::bigint as with_a, sum(number)::bigint as numbers from (select study_name || '-x' as study_name, number, values_1, 1 as a from {DUCK} where study_name = 'view' union all select 'b', number, values_1, null from {DUCK} where study_name = 'click') t where values_1 is null or values_1 < 'infinity'::double group by study_name")
def concatenated_studies(spark, sf_dir):
    every = trials(spark, sf_dir)
    one, other = every.where("study_name = 'view'").withColumn("a", F.lit(1)), every.where("study_name = 'click'")
    both = S.concat_studies({"view-x": one, "b": other})
    return both.groupBy("study_name").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("with_a"), F.sum("number").alias("numbers"))


@query(f"select study_name, number from {DUCK} where state = 'FAIL' or failed")
def failed_trials(spark, sf_dir):
    return S.failed_trials(trials(spark, sf_dir)).select("study_name", "number")


@query("select n_name as study from nation where (starts_with(n_name, 'NATION_1') or starts_with(n_name, 'NATION_2')) and not (n_name in ('NATION_12', 'NATION_22'))")
def study_names(spark, sf_dir):
    return S.names_like(table(spark, sf_dir, "nation").select(F.col("n_name").alias("study")), "study", ["NATION_1", "NATION_2.*"], [".*_[12]2$"])


def _micro(name: str):
    """A column in whole millionths, halves away from zero: the double times a million is what is rounded, as the hours have exact halves."""
    return (F.round(F.col(name) * 1_000_000, 0) / 1_000_000).alias(name)


@query(f"""with o as (select *, row_number() over w as place, sum(duration / 3600) over (w rows unbounded preceding) as hours, min(datetime_start) over (partition by study_name) as began from {DUCK} window w as (partition by study_name order by datetime_complete, number))
select study_name, place::int as number, mode as rag_mode, top_k::int as top_k, case when params_retriever <> 'sparse' then params_embedding_model end as embedding_model, round(values_1 * 10000, 4) as cost,
  round(hours, 6) as compute_hours, round(date_diff('microsecond', began, datetime_complete) / 3600000000.0, 6) as wallclock_hours, params_no_rag_llm_name as llm, exception_class from o where mode is not null""")
def study_load(spark, sf_dir):
    clean = S.load_study(trials(spark, sf_dir), {"rag_mode": "string", "top_k": "int"}, cost=True)
    return clean.select(
        "study_name", "number", F.col("params_rag_mode").alias("rag_mode"), F.col("params_top_k").alias("top_k"), F.col("params_embedding_model").alias("embedding_model"), F.round("values_1", 4).alias("cost"),
        _micro("compute_hours"), _micro("wallclock_hours"), F.col("params_response_synthesizer_llm").alias("llm"), "exception_class",
    )


@query(f"select study_name, number, case when values_1 > 0 then values_1 else 0.000001 end as values_1 from {DUCK} where num_success > 36 or is_pruned")
def usable_trials(spark, sf_dir):
    return S.usable_trials(trials(spark, sf_dir)).select("study_name", "number", "values_1")


@query(f"select study_name, case when study_name in ('view', 'click') then 'latency' end as objective from {DUCK} group by 1")
def objective_names(spark, sf_dir):
    rows = trials(spark, sf_dir).withColumn("objective_2_name", F.when(F.col("study_name").isin("view", "click"), F.col("objective_2_name")).when(F.col("number") % 2 == 0, "cost").otherwise("latency"))
    return S.objective_names(rows)


@query(f"select name, number, study_name from (select 'plain' as name, t.* from {DUCK} t where params_retriever = 'dense' and params_embedding_model = 'model-1' and params_no_rag_llm_name is null union all select 'large', t.* from {DUCK} t where params_retriever = 'sparse' and params_embedding_model = 'model-0' and params_no_rag_llm_name = 'a/llm-large') b qualify row_number() over (partition by name order by num_success desc, number) = 1")
def best_baselines(spark, sf_dir):
    wanted = spark.createDataFrame([("plain", "dense", "model-1", None), ("large", "sparse", "model-0", "a/llm-large"), ("none", "x", "y", "z")], "name string, params_retriever string, params_embedding_model string, params_no_rag_llm_name string")
    return S.baselines(trials(spark, sf_dir), wanted).select("name", "number", "study_name")


def _maps(spark, sf_dir):
    return trials(spark, sf_dir).select("number", F.create_map(F.lit("retriever"), F.col("params_retriever"), F.lit("model"), F.col("params_embedding_model"), F.lit("seed"), (F.col("number") % 3).cast("string")).alias("params"))


@query("select event_id as number, 2 as n, event_id % 4 = 0 as sparse from events")
def search_params(spark, sf_dir):
    kept = S.without_keys(F.col("params"), ["seed"])
    return _maps(spark, sf_dir).select("number", F.size(kept).alias("n"), (kept["retriever"] == "sparse").alias("sparse"))


@query("select * from (values (1, 'sparse', 'model-0', '0')) t(id, retriever, model, seed) where exists (select 1 from events where event_id % 4 = 0 and event_id % 5 = 0 and event_id % 3 = 0)")
def existing_trials(spark, sf_dir):
    """The second map has an odd key more, the third a value that no trial has."""
    wanted = spark.createDataFrame([(1, {"seed": "0", "model": "model-0", "retriever": "sparse"}), (2, {"seed": "0", "model": "model-0", "retriever": "sparse", "more": "1"}), (3, {"seed": "9", "model": "model-0", "retriever": "sparse"})], "id int, params map<string,string>")
    return S.existing(wanted, _maps(spark, sf_dir)).select("id", F.col("params")["retriever"].alias("retriever"), F.col("params")["model"].alias("model"), F.col("params")["seed"].alias("seed"))


@query("select event_id, event_id % 7 between 1 and 5 and event_id % 7 % 2 = 1 as fits from events")
def on_steps(spark, sf_dir):
    value = (F.col("event_id") % 7).cast("double") / 10 + 1e-12
    return table(spark, sf_dir, "events").select("event_id", S.within_range(value, 0.1, 0.5, 0.2).alias("fits"))


@query("select event_id, event_id % 12 < 6 as flag from events")
def text_to_bool(spark, sf_dir):
    words = F.array(*[F.lit(x) for x in ("True", "1", " t", "Y", "YES ", "on", "false", "0", "F", "n", "No", "off")])
    return table(spark, sf_dir, "events").select("event_id", S.text_to_bool(F.get(words, (F.col("event_id") % 12).cast("int"))).alias("flag"))


@query(f"select study_name, list_sort(list(distinct params_retriever)) as retrievers, list_sort(list(distinct round(case when number % 7 = 0 then null else (number % 5) / 3.0 end, 4))) as parts, min(number) as least, max(number) as most from {DUCK} group by study_name".replace("list_sort(list(distinct round(case when number % 7 = 0 then null else (number % 5) / 3.0 end, 4)))", "list_sort(list(distinct round((number % 5) / 3.0, 4)) filter (where number % 7 <> 0))"))
def unique_values(spark, sf_dir):
    rows = trials(spark, sf_dir).withColumn("part", F.when(F.col("number") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("number") % 5) / 3.0))
    return rows.groupBy("study_name").agg(S.unique_values(rows, "params_retriever").alias("retrievers"), S.unique_values(rows, "part").alias("parts"), F.min("number").alias("least"), F.max("number").alias("most"))


@query("select event_id, case when event_id % 2 = 0 then 'given' else 'old' end as splitter_method, '5' as retrieval_top_k, case when event_id % 3 = 0 then 'true' else 'false' end as hyde_enabled from events")
def normalised_params(spark, sf_dir):
    pairs = F.create_map(F.lit("splitter"), F.lit("old"), F.lit("hyde_enabled"), F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"))
    given = F.when(F.col("event_id") % 2 == 0, F.map_concat(pairs, F.create_map(F.lit("splitter_method"), F.lit("given")))).otherwise(pairs)
    out = S.normalised_params(given, {"splitter": "splitter_method"}, {"retrieval_top_k": "5", "splitter_method": "default"})
    return table(spark, sf_dir, "events").select("event_id", *[out[k].alias(k) for k in ("splitter_method", "retrieval_top_k", "hyde_enabled")])


@query(f"select coalesce(exception_class, 'None') as exception_class, coalesce(case when event_id % 5 = 0 then null else concat('took t=[number] of ', event_type) end, 'None') as exception_message, count(*) as count from (select *, {_CLASS} as exception_class from events) e group by 1, 2")
def exception_stats(spark, sf_dir):
    return S.exception_stats(trials(spark, sf_dir))


@query(f"select study_name, count(*) as trials, count(*) filter (where state = 'COMPLETE') as n_complete, count(*) filter (where state = 'FAIL') as n_fail, count(*) filter (where is_seeding) as seeds, round(sum(num_errors) / (40.0 * count(*)), 9) as error_rate, round(avg(case when is_pruned then values_0 end), 9) as pruned_mean, round(sum(llm_cost_total), 6) as cost, min(datetime_start) as started, round(count(*) / (date_diff('microsecond', min(datetime_start), max(datetime_complete)) / 3600000000.0), 6) as trials_per_hour from {DUCK} group by study_name")
def study_stats(spark, sf_dir):
    rows = S.study_stats(trials(spark, sf_dir), ["COMPLETE", "FAIL"])
    rounded = {"error_rate": 9, "pruned_mean": 9, "cost": 6, "trials_per_hour": 6}
    return rows.drop("hours").withColumns({c: F.round(c, n) for c, n in rounded.items()})


@query(f"select study_name, count(*) filter (where exception_class = 'TimeoutError') as \"TimeoutError\", count(*) filter (where exception_class = 'ValueError') as \"ValueError\" from {DUCK} group by study_name")
def exceptions_by_class(spark, sf_dir):
    return S.exceptions_by_class(trials(spark, sf_dir), ["TimeoutError", "ValueError"])


@query("""with e as (select min(p_size) as lo, max(p_size) as hi from part), c as (select unnest(range(0, 10)) as i), g as (select case when i = 0 then lo - (hi - lo) / 1000.0 else lo + (hi - lo) / 10.0 * i end as x, i from c, e),
w as (select distinct round_even(x, 0)::int as a from g), x as (select a, coalesce(lead(a) over (order by a), (select hi + 1 from e)) as b from w)
select concat('(', a, ', ', b, ']') as bin, count(*) as n, min(p_retailprice) as least, max(p_retailprice) as most, round(avg(p_retailprice), 6) as mean from part join x on p_size > a and p_size <= b group by 1
union all select 'N/A', count(*), min(p_retailprice), max(p_retailprice), round(avg(p_retailprice), 6) from part where p_size <= (select min(a) from x) having count(*) > 0""")
def param_bins(spark, sf_dir):
    """Bins with labels; whole edges may leave the least value out, as N/A."""
    rows = S.binned(table(spark, sf_dir, "part").withColumn("params_size", F.col("p_size")), "params_size")
    return rows.groupBy(F.col("params_size_binned").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"), F.round(F.avg("p_retailprice"), 6).alias("mean"))


@query("with q as (select p_brand, quantile_cont(p_retailprice, 1 / 3.0) as a, quantile_cont(p_retailprice, 2 / 3.0) as b from part group by p_brand) select p_brand, case when p_retailprice <= a then 'small' when p_retailprice <= b then 'medium' else 'large' end as cut, count(*) as n from part join q using (p_brand) group by all")
def quantile_classes(spark, sf_dir):
    return S.quantile_cut(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", ["small", "medium", "large"]).groupBy("p_brand", "cut").agg(F.count(F.lit(1)).alias("n"))


_PARTS = "(select p_brand as study, p_partkey as number, p_retailprice as v0, cast(p_size as double) as v1 from part)"
_FRONT = "(select * from t x where not exists (select 1 from t y where y.study = x.study and ((y.v0 >= x.v0 and y.v1 < x.v1) or (y.v0 > x.v0 and y.v1 = x.v1) or (y.v0 = x.v0 and y.v1 = x.v1 and y.number < x.number))))"


def _part_trials(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("study"), F.col("p_partkey").alias("number"), F.col("p_retailprice").alias("v0"), F.col("p_size").cast("double").alias("v1"))


@query(f"""with t as {_PARTS}, f as {_FRONT}, n as (select *, lead(v0) over w as a, lead(v1) over w as b from f window w as (partition by study order by v1))
select study, v0 as x, v1 as y from n union all select study, (v0 + a) / 2, v1 from n where a is not null union all select study, a, v1 from n where a is not null union all select study, a, (v1 + b) / 2 from n where a is not null""")
def front_polyline(spark, sf_dir):
    return T.front_polyline(_part_trials(spark, sf_dir))


@query(f"""with t as {_PARTS}, l as (select study, quantile_cont(v0, 0.1) as y0, max(v0) as y1, min(v1) as x0, quantile_cont(v1, 0.9) as x1 from t group by study),
p as (select a.study, a.number as upto, b.number, b.v0, b.v1 from t a join t b on a.study = b.study and b.number <= a.number),
f as (select *, max(v0) over (partition by study, upto order by v1, v0 desc, number rows between unbounded preceding and 1 preceding) as before from p),
g as (select * from f where before is null or v0 > before), h as (select * from g qualify row_number() over (partition by study, upto, v1 order by v0 desc, number) = 1),
c as (select h.study, upto, h.v1, greatest(x0, least(x1, h.v1)) as x, greatest(y0, least(y1, h.v0)) as y, y0, y1, x0, x1 from h join l on h.study = l.study),
s as (select *, coalesce(lead(x) over (partition by study, upto order by v1), x1) - x as w from c)
select study, upto as number, round(sum(w * (y - y0)) / any_value((x1 - x0) * (y1 - y0)), 9) as area from s group by study, upto""")
def cumulative_pareto_area(spark, sf_dir):
    return T.cumulative_area(_part_trials(spark, sf_dir)).withColumn("area", F.round("area", 9))


@query(f"""with t as (select study, number, v0, v1, number % 40 as setting from {_PARTS}), m as (select study, setting, median(v0) as v from t group by 1, 2),
j as (select a.study as study_a, b.study as study_b, a.v as x, b.v as y, a.setting from m a join m b on a.setting = b.setting and a.study <> b.study),
k as (select a.study_a, a.study_b, sign(a.x - b.x) as dx, sign(a.y - b.y) as dy from j a join j b on a.study_a = b.study_a and a.study_b = b.study_b and a.setting < b.setting),
r as (select study_a, study_b, count(*) as pairs, sum(dx * dy) / nullif(sqrt(sum(abs(dx)) * sum(abs(dy))), 0) as tau from k group by all)
select study_a, study_b, round(tau, 9) as tau from r where pairs >= 3 union all select study, study, 0.0 from (select distinct study from t)""")
def study_matrix(spark, sf_dir):
    """Similarity of all pairs of studies on the medians of the settings that both have; the diagonal is 0."""
    rows = _part_trials(spark, sf_dir).withColumn("setting", F.col("number") % 40)
    return T.study_matrix(rows, "setting", "v0").withColumn("tau", F.round("tau", 9))


# Parsing


@query("select doc_id, case doc_id % 5 when 0 then 'D-' || doc_id when 1 then 'x' || doc_id when 2 then 's' || doc_id when 3 then 'a/b' || doc_id || '.pdf' else '' end as id from documents")
def document_id_from_context(spark, sf_dir):
    head = F.expr("case doc_id % 5 when 0 then concat('DOC_ID: D-', doc_id, ' and more') when 1 then concat('some Id:x', doc_id) when 2 then concat('Source:  s', doc_id) when 3 then concat('a/b', doc_id, '.pdf') else 'nothing here' end")
    return table(spark, sf_dir, "documents").select("doc_id", P.document_id(F.concat(head, F.lit("\nbody line"))).alias("id"))


@query("select event_id, case event_id % 4 when 0 then ['what is it', 'second entry', 'third entry', 'fourth entry', 'fifth entry', 'sixth entry'] when 1 then ['Where did they go today', 'It ends here with a stop.'] when 2 then ['longer than five'] else [] end as items from events")
def sub_query_parse(spark, sf_dir):
    texts = ["1. what is it\n2) second entry\n(3) third entry\n4 - fourth entry\n5: fifth entry\n[Sub question] sixth entry\n7. abc", "Where did they go today\n\nno sign of one here\nIt ends here with a stop.", "  1.longer than five \n2. five5\n3) five", "plain words only"]
    raw = F.get(F.array(*[F.lit(x) for x in texts]), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", P.sub_queries(raw).alias("items"))


@query("select event_id, case event_id % 3 when 0 then 'Hybrid wins' when 1 then 'A title of its own' else 'RAG Configuration Analysis' end as title, (case event_id % 3 when 0 then 0.9 when 1 then 0.6 else 0.8 end)::double as confidence, case event_id % 3 when 0 then 'use hybrid; raise top-k; keep chunks' when 1 then 'You should try it.' else 'Continue monitoring performance and consider parameter fine-tuning based on query patterns.' end as advice from events")
def insight_parse(spark, sf_dir):
    texts = ["**Title**: Hybrid wins\nConfidence: High\nRecommendations:\n- use hybrid\n-  raise top-k\n- keep chunks\n- a fourth\nend", "A title of its own\nConfidence: Low or Medium\nYou should try it.", "nothing of note\nat all"]
    raw = F.get(F.array(*[F.lit(x) for x in texts]), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", P.insight_title(raw).alias("title"), P.insight_confidence(raw).alias("confidence"), P.recommendations(raw).alias("advice"))


@query("with l as (select page_id, url as label from pages), s as (select page_id, case when length(label) > 30 and contains(label, '/') then list_extract(string_split(label, '/'), -1) else label end as label from l) select page_id, case when length(label) > 30 then left(label, 13) || '...' || right(label, 13) else label end as label from s")
def label_truncate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.truncate_label(F.col("url")).alias("label"))


@query("""select p_partkey, left(md5('{"brand": "' || p_brand || '", "size": "' || p_size || '", "type": "' || p_type || '"}'), 12) as id from part""")
def config_ids(spark, sf_dir):
    text = P.canonical_json({"type": F.col("p_type"), "brand": F.col("p_brand"), "size": F.col("p_size").cast("string")})
    return table(spark, sf_dir, "part").select("p_partkey", P.short_id(text).alias("id"))


@query("select item_id, 'Context: ' || text || chr(10) || 'Question: item ' || item_id || chr(10) || 'Answer: ' as prompt from benchmark")
def template_render(spark, sf_dir):
    values = {"context_str": F.col("text"), "query_str": F.concat(F.lit("item "), F.col("item_id").cast("string"))}
    return table(spark, sf_dir, "benchmark").select("item_id", P.render("Context: {context_str}\nQuestion: {query_str}\nAnswer: ", values).alias("prompt"))
