"""Queries on loading: QA records and corpora from JSON lines, evidence, contexts, positional parts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.order import shared_folder
from ..sources import tables as S
from ..sources.tables import table
from .base import query


def _qa_lines(spark, sf_dir):
    """(value, place): turns as JSON lines under changing names, every eleventh cut off, so that it is no object."""
    turns = table(spark, sf_dir, "events")
    ids = F.array((F.col("event_id") % 50).cast("string"), F.lit("absent"), ((F.col("event_id") + 1) % 50).cast("string"))
    kind = F.col("event_id") % 3
    meta = F.struct(F.col("event_type").alias("type"), F.lit(None).cast("string").alias("difficulty"))
    record = F.to_json(F.struct(
        F.when(kind == 0, F.concat(F.lit("q"), "event_id")).alias("id"), F.when(kind == 1, F.concat(F.lit("x"), "event_id")).alias("_id"),
        F.when(kind < 2, F.concat(F.lit("ask "), "event_id")).alias("query"), F.when(kind == 2, F.concat(F.lit("ask "), "event_id")).alias("question"),
        F.when(kind == 0, "gold").alias("answer_ground_truth"), F.when(kind != 0, "plain").alias("answer"), ids.alias("text_ground_truth"), F.when(kind == 2, meta).alias("metadata"),
    ))
    return turns.select(F.when(F.col("event_id") % 11 == 0, F.substring(record, 1, 20)).otherwise(record).alias("value"), F.col("event_id").alias("place"))


_ID = "case event_id % 3 when 0 then 'q' || event_id when 1 then 'x' || event_id else 'set_' || event_id end"


@query(f"select {_ID} as id, 'ask ' || event_id as question, case event_id % 3 when 0 then 'gold' else 'plain' end as answer, case event_id % 3 when 2 then event_type else 'multihop' end as qtype, 'unknown' as difficulty, 3 as n_ids from events where event_id % 11 <> 0")
def qa_records_load(spark, sf_dir):
    rows = S.qa_records(S.parse_records(_qa_lines(spark, sf_dir)), "set")
    return rows.select("id", "question", "answer", "qtype", "difficulty", F.size("text_ground_truth").alias("n_ids"))


def _corpus_lines(spark, sf_dir):
    """(value, place): documents as JSON lines, with id, with a title only, with neither."""
    d = F.col("doc_id")
    record = F.to_json(F.struct(F.when(d % 3 == 0, d.cast("string")).alias("id"), F.when(d % 3 != 2, F.concat(F.lit("t"), d)).alias("title"), F.col("source").alias("text")))
    return table(spark, sf_dir, "documents").select(record.alias("value"), d.alias("place"))


@query("select case doc_id % 3 when 0 then doc_id::varchar when 1 then 't' || doc_id else 'doc_' || doc_id end as id, case doc_id % 3 when 2 then 'doc_' || doc_id else 't' || doc_id end as title, source as text from documents")
def corpus_load(spark, sf_dir):
    return S.corpus_records(S.parse_records(_corpus_lines(spark, sf_dir), S.CORPUS_SCHEMA))


@query("select source as id, arg_max(doc_id, doc_id) as doc_id, arg_max(n_chars, doc_id) as n_chars from documents group by source")
def corpus_mapping(spark, sf_dir):
    """Of entries with one id the last wins."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), "doc_id", "n_chars")
    return S.last_of_each(rows.withColumn("place", F.col("doc_id")), "id", "place").drop("place")


@query(f"with c as (select doc_id::varchar as id, source as text from documents where doc_id < 40) select {_ID} as id, array_to_string(list_filter([a.text, b.text], lambda x: x is not null), '|') as evidence from events e left join c a on a.id = (event_id % 50)::varchar left join c b on b.id = ((event_id + 1) % 50)::varchar where event_id % 11 <> 0")
def evidence_join(spark, sf_dir):
    corpus = table(spark, sf_dir, "documents").where("doc_id < 40").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("text"))
    rows = S.with_evidence(S.qa_records(S.parse_records(_qa_lines(spark, sf_dir)), "set"), corpus)
    return rows.select("id", F.array_join("evidence", "|").alias("evidence"))


@query("select 'ask ' || event_id as question, case event_id % 3 when 0 then ['a', 'b'] when 1 then ['g'] else ['one'] end as answers from events where event_id % 5 <> 0")
def qa_only_load(spark, sf_dir):
    kind = F.col("event_id") % 3
    raw = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("ask "), "event_id")).alias("question"), F.when(kind == 0, F.array(F.lit("a"), F.lit("b"))).alias("answers"),
        F.when(kind == 1, F.array(F.lit("g"))).alias("golden_answers"), F.lit("one").alias("answer"),
    )
    return S.qa_only(raw)


def _ranked(spark, sf_dir):
    """(question_id, ctxs): for each source its first seven documents by id as contexts without text; they are cut before they are collected."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    item = F.struct(F.col("doc_id").alias("id"), F.lit("old").alias("title"), F.lit("none").alias("text"), (F.col("doc_id") % 2 == 0).alias("has_answer"))
    return table(spark, sf_dir, "documents").withColumn("r", place).where("r <= 7").groupBy(F.col("source").alias("question_id")).agg(F.sort_array(F.collect_list(item)).alias("ctxs"))


@query("select source as question_id, string_agg(case when doc_id % 3 = 0 then coalesce(lang, '') || n_chars else 'oldnone' end, ',' order by doc_id) as ctxs from (select *, row_number() over (partition by source order by doc_id) as r from documents) d where r <= 7 group by source")
def contexts_hydrated(spark, sf_dir):
    """The first seven contexts with the passages that there are."""
    passages = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("string").alias("text"), F.coalesce("lang", F.lit("")).alias("title"))
    rows = S.hydrate(S.first_contexts(_ranked(spark, sf_dir), 7), passages)
    return rows.select("question_id", F.array_join(F.transform("ctxs", lambda c: F.concat(c["title"], c["text"])), ",").alias("ctxs"))


@query("with p as (select doc_id, row_number() over (order by doc_id) - 1 as place from documents) select part, count(*) as n, min(doc_id) as least, max(doc_id) as most from p join (values ('sample', 0, 10), ('train', 0, 100), ('test', 100, 400), ('holdout', 400, 500)) r(part, lo, hi) on place >= lo and place < hi group by part")
def positional_parts(spark, sf_dir):
    from ..operators.order import with_place

    ranges = {"sample": (0, 10), "train": (0, 100), "test": (100, 400), "holdout": (400, 500)}
    rows = S.in_ranges(with_place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), "place", ranges)
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))


@query("select conv_id, md5(string_agg(coalesce(text, ''), '' order by turn, role, text)) as id, count(*) filter (where role = 'user') as n from conversations group by conv_id")
def hashed_ids(spark, sf_dir):
    """Ids that are the md5 of a question's text."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.count_if(F.col("role") == "user").alias("n"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))), "").cast("binary")).alias("id"), "n")


@query("select doc_id // 10 as list, string_agg('t' || doc_id || '=' || coalesce(lang, '?') || ' ' || n_chars, ';' order by doc_id) as context from documents group by 1")
def title_contexts(spark, sf_dir):
    """Lists of (title, sentences), ten documents each, as one map a title."""
    pair = F.struct(F.col("doc_id"), F.concat(F.lit("t"), "doc_id").alias("title"), F.array(F.coalesce("lang", F.lit("?")), F.col("n_chars").cast("string")).alias("sentences"))
    rows = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("list")).agg(F.sort_array(F.collect_list(pair)).alias("c"))
    entry = lambda m: F.concat(F.map_keys(m)[0], F.lit("="), F.map_values(m)[0])
    return rows.select("list", F.array_join(F.transform(S.context_maps(F.col("c")), entry), ";").alias("context"))


@query("select o_custkey % 5 as base, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as config_id, max(o_totalprice) as average_score from orders where o_custkey % 5 = 2 group by 1")
def best_of_knowledge_base(spark, sf_dir):
    layer = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).cast("string").alias("base_id"), F.col("o_orderkey").alias("config_id"), F.col("o_totalprice").alias("average_score"))
    best = S.load_knowledge_base(layer, "2", ["base_id", "config_id", "average_score"])
    return best.select(F.col("base_id").cast("long").alias("base"), "config_id", "average_score")


_ANSWER = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'))"


@query(f"select conv_id, turn, {_ANSWER} as answer from conversations where role = 'assistant'")
def answer_extract(spark, sf_dir):
    """Answers in the five ways in which a model's reply holds them."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", ""))
    ways = [("The reasoning is long. Answer: ", ".\n\nmore of it"), ('(CompletionResponse(text="so. Answer: ', '. More", additional_kwargs={}))'), ("答案: ", ", additional_kwargs={}"), ('"', '"'), ('Reply(text="', '.")')]
    raw = F.get(F.array(*[F.concat(F.lit(a), t, F.lit(b)) for a, b in ways]), F.pmod(F.hash("conv_id", "turn"), F.lit(5)))
    return rows.select("conv_id", "turn", T.extract_answer(raw).alias("answer"))


@query("select event_id, case when event_id % 4 = 0 then 1.0 when event_id % 4 = 1 then 0.0 else 0.0 end::double as em, round(case event_id % 4 when 0 then 1.0 when 1 then 2.0 / 3 when 2 then 0.0 else 0.0 end, 6)::double as f1 from events where event_id % 4 < 3 union all select event_id, 1.0, 1.0 from events where event_id % 4 = 3")
def evidence_triple_scores(spark, sf_dir):
    """Sets of (head, relation, tail): equal in another order, one of two found, one side empty, both empty."""
    triple = lambda x: F.struct(F.lit(f"h{x}").alias("h"), F.lit("r").alias("r"), F.lit(f"t{x}").alias("t"))
    none = F.array().cast("array<struct<h:string,r:string,t:string>>")
    case = lambda *xs: F.when(F.col("event_id") % 4 == 0, xs[0]).when(F.col("event_id") % 4 == 1, xs[1]).when(F.col("event_id") % 4 == 2, xs[2]).otherwise(xs[3])
    gold = case(F.array(triple(1), triple(2)), F.array(triple(1), triple(2)), F.array(triple(1)), none)
    found = case(F.array(triple(2), triple(1), triple(1)), F.array(triple(2)), none, none)
    em, f1 = T.set_scores(found, gold)
    return table(spark, sf_dir, "events").select("event_id", em.alias("em"), F.round(f1, 6).alias("f1"))


@query("with g as (select doc_id // 12 as list, doc_id, row_number() over (partition by doc_id // 12 order by n_chars, doc_id) as r from documents) select list, round(coalesce(1.0 / min(r) filter (where doc_id % 7 = 3), 0), 6) as rr from g group by list")
def reciprocal_rank_by_evidence(spark, sf_dir):
    """The rank of the first context that names a gold id, in lists of twelve documents by their length."""
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 12).alias("list"), "n_chars", "doc_id", F.concat(F.lit("doc_id: D"), "doc_id", F.lit(" of this list")).alias("context"))
    ctx = rows.groupBy("list").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_chars", "doc_id", "context"))), lambda x: x["context"]).alias("contexts"))
    gold = rows.where("doc_id % 7 = 3").groupBy("list").agg(F.collect_list(F.concat(F.lit("D"), "doc_id")).alias("gold"))
    both = ctx.join(gold, "list", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
    return both.select("list", F.round(T.reciprocal_rank(F.col("contexts"), F.col("gold"), F.array().cast("array<string>")), 6).alias("rr"))


@query("select doc_id::varchar as id, 'what of ' || doc_id as question, lang as answer, case when doc_id % 3 = 0 then 1 else 0 end as contexts, case when doc_id % 4 = 0 then 0 else 1 end as facts, coalesce(source, 'default') as qtype, substr(text, 1, 100) as gold_evidence from documents")
def evidence_records_load(spark, sf_dir):
    """Documents as records with evidence, some without it or without a justification."""
    d = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(
        d.alias("key"), F.concat(F.lit("what of "), d).alias("question"), F.col("lang").alias("answer"), F.when(d % 3 == 0, F.col("text")).alias("evidence"), F.when(d % 4 != 0, F.lit("so")).alias("justification"), F.col("source").alias("question_type"), F.substring("text", 1, 100).alias("html_evidence"),
    )
    return S.evidence_records(raw, "key").select("id", "question", "answer", F.size("context").alias("contexts"), F.size("supporting_facts").alias("facts"), "qtype", "gold_evidence")


@query("select conv_id::varchar as id, count(distinct turn % 3) as results, string_agg(distinct 'h' || turn % 3, ',' order by 'h' || turn % 3) as hashes, max(turn) as latest from conversations group by conv_id")
def search_results_load(spark, sf_dir):
    """A conversation's turns as search results, of which those with one hash overwrite each other."""
    result = F.struct(F.col("turn"), F.concat(F.lit("h"), F.col("turn") % 3).alias("_hash"), "role")
    raw = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(result)).alias("search_results"))
    raw = raw.select(F.lit("q").alias("query"), F.lit("a").alias("answer"), F.col("conv_id").alias("interaction_id"), F.lit(None).cast("string").alias("question_type"), "search_results")
    rows = S.search_result_records(raw)
    latest = F.array_max(F.transform(F.map_values("context"), lambda x: F.get_json_object(x, "$.turn").cast("long")))
    return rows.select("id", F.size("context").cast("long").alias("results"), F.array_join(F.array_sort(F.map_keys("context")), ",").alias("hashes"), latest.alias("latest"))


@query("select item_id::varchar as id, text as question, length(text) as characters, 'default' as qtype, 'default' as difficulty from benchmark")
def plain_records_load(spark, sf_dir):
    raw = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit("none").alias("answer"))
    return S.plain_records(raw).select("id", "question", F.length("question").alias("characters"), "qtype", "difficulty")


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select o_custkey::varchar as qid, o_orderkey::varchar as pid, (row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey))::int as rank, o_totalprice as score from orders")
def trec_run_load(spark, sf_dir):
    """Orders ranked by price as a run file, written and read."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(order))
    path = _folder(spark, "run")
    ranked.select(F.concat_ws(" ", "o_custkey", F.lit("Q0"), "o_orderkey", "rank", "o_totalprice", F.lit("orders")).alias("value")).write.text(path)
    return S.read_trec(spark, path)


@query("select item_id::varchar as id, regexp_replace(text, '\\s+', ' ', 'g') || ' \"quoted\"' as question from benchmark")
def query_file_load(spark, sf_dir):
    """Benchmark texts as a tab-separated file of queries with quotes, written and read."""
    path = _folder(spark, "queries")
    question = F.concat(F.regexp_replace("text", r"\s+", " "), F.lit(' "quoted"'))
    table(spark, sf_dir, "benchmark").select("item_id", question.alias("q")).write.option("sep", "\t").option("quote", '"').option("escape", '"').csv(path)
    return S.read_queries(spark, path)


@query("select doc_id, lang, n_chars from documents")
def record_file_load(spark, sf_dir):
    """Documents as JSON lines, written and read."""
    path = f"{_folder(spark, 'records')}.jsonl"
    S.write_records(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path)
    return S.read_records(spark, path, "doc_id long, lang string, n_chars long")


@query("select 'configs' as layer, count(*) as n from customer union all select 'runs', count(*) from orders")
def memory_layers_load(spark, sf_dir):
    """Two layers of an experience memory, written twice and read."""
    path = _folder(spark, "memory")
    layers = {"configs": table(spark, sf_dir, "customer"), "runs": table(spark, sf_dir, "orders")}
    S.write_layers(layers, path)
    S.write_layers(layers, path)  # replaces the layers that are there
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "n") for name, rows in S.read_layers(spark, path, list(layers)).items()]
    return parts[0].union(parts[1])


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by event_type")
def result_rows_appended(spark, sf_dir):
    """Events appended to a result file in two goes."""
    path, rows = _folder(spark, "results"), table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    S.append_rows(rows.where("event_id % 3 = 0"), path)
    S.append_rows(rows.where("event_id % 3 <> 0"), path)
    back = spark.read.option("header", True).schema("event_id long, event_type string, value double").csv(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
