"""Queries on logs, configurations, insights and parameters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import memory as M
from ..operators import trials as T
from ..sources.tables import table
from .base import query
from .retrieval import _EMB
from .trials import part_trials

_RUN = ("event_id", "case when event_type <> 'view' then event_type end as m", "case when event_id % 3 > 0 then value end as f", "case when event_id % 7 = 0 then 3 end as k", "case when event_id % 2 = 0 then event_id % 4 = 0 end as r")


@query(f"select event_id, coalesce(m, 'unknown') as retrieval_method, coalesce(f, 0.0) as f1_score, coalesce(k, 10) as retrieval_top_k, coalesce(r, false) as reranker_enabled, 'Unknown question' as question, 0.5::double as hybrid_bm25_weight, 5 as reranker_top_k from (select {', '.join(_RUN)} from events)")
def run_projection(spark, sf_dir):
    """Events as logs of runs that are silent on some fields."""
    logs = table(spark, sf_dir, "events").selectExpr(*_RUN)
    logs = logs.withColumnsRenamed({"m": "retrieval_method", "f": "f1_score", "k": "retrieval_top_k", "r": "reranker_enabled"})
    return M.node_projection(logs).select("event_id", "retrieval_method", "f1_score", "retrieval_top_k", "reranker_enabled", "question", F.col("hybrid_bm25_weight").cast("double").alias("hybrid_bm25_weight"), "reranker_top_k")


@query("select o_orderkey, case when o_orderkey % 4 = 0 then o_totalprice when o_orderkey % 4 = 1 then o_totalprice / 2 when o_orderkey % 4 = 2 then o_totalprice / 4 else 0.0 end as objective from orders")
def objective_values(spark, sf_dir):
    """The target's value where a run reports it, else the joint score under either name, else 0."""
    p = F.col("o_totalprice")
    k = F.col("o_orderkey") % 4
    results = F.when(k == 0, F.create_map(F.lit("train_mrr"), p, F.lit("joint_f1"), F.lit(1.0))).when(k == 1, F.create_map(F.lit("train_joint_f1"), p / 2)).when(k == 2, F.create_map(F.lit("joint_f1"), p / 4)).otherwise(F.create_map(F.lit("other"), p))
    return table(spark, sf_dir, "orders").select("o_orderkey", M.objective(results, "train_mrr").alias("objective"))


_NODES = "(select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r from orders qualify r <= 12)"


@query(f"select o_custkey, (r - 1)::int as doc_id, substr(repeat(o_orderpriority || ' ', 60), 1, 500) as text, case when o_orderkey % 5 = 0 then 0.0 else o_totalprice end as score from {_NODES} n join orders using (o_custkey, o_orderkey) where r <= 10")
def context_documents(spark, sf_dir):
    """The first ten of a customer's first twelve orders as retrieved nodes, texts cut to 500 characters."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    first = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(order)).where("r <= 12")
    node = F.struct("r", F.repeat(F.concat("o_orderpriority", F.lit(" ")), 60).alias("text"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("score"))
    lists = first.groupBy("o_custkey").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    return lists.select("o_custkey", F.explode(M.context_documents(F.col("nodes"))).alias("d")).select("o_custkey", "d.*")


@query("select o_custkey as query_id, o_orderkey as node_id, rank, o_orderpriority as text, price as score from (select o_custkey, o_orderkey, o_orderpriority, o_totalprice / 2 as price, (row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey))::int as rank from orders) where rank <= 3 and o_orderkey % 6 > 0")
def reranked_nodes(spark, sf_dir):
    """A reranker's three best orders of a customer, brought back to the orders as nodes; some of its ids have no node."""
    orders = table(spark, sf_dir, "orders")
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("node_id"), F.row_number().over(order).alias("rank"), (F.col("o_totalprice") / 2).alias("score")).where("rank <= 3")
    nodes = orders.where("o_orderkey % 6 > 0").select(F.col("o_orderkey").alias("node_id"), F.col("o_orderpriority").alias("text"), F.lit(None).cast("double").alias("score"))
    return M.reranked_nodes(ranked, nodes).select("query_id", "node_id", "rank", "text", "score")


_SWITCHED = (
    "p_partkey % 2 = 0 as rr", "p_partkey % 3 = 0 as hy", "p_size > 25 as qd", "p_partkey % 5 = 0 as fu", "p_partkey % 7 = 0 as ac", "case when p_size % 3 = 0 then 'hybrid' when p_size % 3 = 1 then 'dense' end as rm",
    "case when p_size % 4 > 0 then concat('org/', p_brand) else '' end as em",
)


@query(f"""with c as (select *, {', '.join(_SWITCHED)} from part)
select p_partkey, 'retrieval=' || coalesce(rm, 'None') || ' | embedding=' || case when em = '' then 'unknown' else p_brand end || ' | template=' || p_type || ' | reranker=' || case when rr then 'enabled' else 'disabled' end || ' | hyde=' || case when hy then 'enabled' else 'disabled' end as signature,
       concat_ws(' → ', case when qd then 'Decomposed into ' || p_size || ' sub-queries' end, case when hy then 'Applied HyDE query transformation' end, 'Retrieved ' || (p_size % 11) || ' docs via ' || coalesce(rm, 'None') || case when rm = 'hybrid' then ' (BM25 weight: 0.5)' else '' end,
         case when fu then 'Fused results using simple' end, case when rr then 'Reranked to top-' || (p_size % 6) || ' docs' end, case when ac then 'Added ' || (p_size % 5) || ' context nodes' end, 'Synthesized using ' || p_type || ' template') as pattern,
       concat_ws(' → ', case when qd then 'QueryDecomp(' || p_size || ')' end, case when hy then 'HyDE' end, 'Retrieval(' || coalesce(rm, 'unknown') || '-' || (p_size % 11) || ')', case when rr then 'Rerank(top-' || (p_size % 6) || ')' end, 'Template(' || p_type || ')') as summary from c""")
def config_signatures(spark, sf_dir):
    """Signature, steps and summary of every part as a configuration."""
    c = table(spark, sf_dir, "part").selectExpr("*", *_SWITCHED)
    size = F.col("p_size")
    columns = {
        "query_decomposition_enabled": F.col("qd"), "hyde_enabled": F.col("hy"), "sub_queries": size, "query_decomposition_num_queries": size, "retrieved": size % 11, "retrieval_top_k": size % 11, "retrieval_method": F.col("rm"), "hybrid_bm25_weight": F.lit(0.5),
        "fusion_enabled": F.col("fu"), "fusion_mode": F.lit("simple"), "reranker_enabled": F.col("rr"), "reranker_top_k": size % 6, "additional_context_enabled": F.col("ac"), "additional_context_num_nodes": size % 5, "template_name": F.col("p_type"),
    }
    signature = M.config_signature(F.col("rm"), F.col("em"), F.col("p_type"), F.col("rr"), F.col("hy"))
    return c.select("p_partkey", signature.alias("signature"), M.execution_pattern(columns).alias("pattern"), M.config_summary(columns).alias("summary"))


@query("""with c as (select p_partkey, p_retailprice / 2111 as f, p_size / 50.3 as p, p_size / 77.7 as r, p_size as n, 'Template(' || p_type || ')' as s from part),
l as (select *, case when f > 0.7 then 'high_performance' when f > 0.5 then 'moderate_performance' else 'low_performance' end as k, case when f > 0.7 then 'High-performing configuration achieving F1=' when f > 0.5 then 'Moderate-performing configuration with F1=' else 'Low-performing configuration with F1=' end as d,
  case when f > 0.7 then 'Maintain current configuration and consider minor parameter tuning for optimization.' when f > 0.5 then 'Consider enhancing retrieval components or adjusting query processing parameters.' else 'Significant configuration changes needed, particularly in retrieval and synthesis components.' end as a from c)
select p_partkey, k as insight_type, 'Configuration Analysis: ' || s as title, '**Configuration Analysis**: ' || s || chr(10) || chr(10) || '**Performance Summary**: ' || d || printf('%.3f', f) || ' across ' || n || ' evaluations.' || chr(10) || chr(10) || '**Key Observations**: ' || chr(10) ||
  '- Retrieval precision: ' || printf('%.3f', p) || chr(10) || '- Retrieval recall: ' || printf('%.3f', r) || chr(10) || '- Component interaction patterns require further analysis' || chr(10) || chr(10) || '**Recommendation**: ' || a as description, a as recommendation, 0.7::double as confidence from l""")
def fallback_insights(spark, sf_dir):
    """Rule-based insights of parts as configurations, their price as score."""
    configs = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 2111).alias("avg_f1_score"), (F.col("p_size") / 50.3).alias("avg_retrieval_precision"), (F.col("p_size") / 77.7).alias("avg_retrieval_recall"), F.col("p_size").alias("runs"), "p_type")
    out = M.fallback_insight(configs, F.concat(F.lit("Template("), "p_type", F.lit(")")))
    return out.select("p_partkey", "insight_type", "title", "description", "recommendation", "confidence")


@query(f"select o_custkey as config_id, (r * 2 - 2)::int as place, o_orderkey as run_id, o_totalprice as f1 from {_NODES} n join orders using (o_custkey, o_orderkey)")
def config_runs(spark, sf_dir):
    """A customer's list of orders as run ids, with as many that no run has."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    first = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(order)).where("r <= 12")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: F.array(x, -x - 1)))
    configs = first.groupBy(F.col("o_custkey").alias("config_id")).agg(ids.alias("run_ids"))
    return M.runs_of_configs(configs, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("f1")))


@query("""with i as (select doc_id, source, text, lang, n_chars, unnest(list_distinct([doc_id % 50, doc_id % 70])) as c from documents),
p as (select *, row_number() over (partition by c order by doc_id) as r from i join (select distinct doc_id % 60 as config_id from documents) on config_id = c qualify r <= 2)
select config_id, string_agg('**Insight ' || r || '**: ' || source || chr(10) || '  Description: ' || substr(text, 1, 300) || case when length(text) > 300 then '...' else '' end || chr(10) || '  Recommendation: ' || lang || chr(10) || '  Confidence: ' || printf('%.2f', (n_chars % 100)::double / 100) || chr(10), chr(10) order by r) as digest from p group by config_id""")
def insight_digests(spark, sf_dir):
    """Documents as insights that support two configurations; the first two of each as text."""
    docs = table(spark, sf_dir, "documents")
    insights = docs.select(
        F.col("doc_id").alias("insight_id"), F.col("doc_id").alias("discovered"), F.col("source").alias("title"), F.col("text").alias("description"), F.col("lang").alias("recommendation"), (F.col("n_chars") % 100 / 100).alias("confidence"),
        F.array(F.col("doc_id") % 50, F.col("doc_id") % 70).alias("supporting_config_ids"),
    )
    return M.insight_digest(docs.select((F.col("doc_id") % 60).alias("config_id")), insights)


@query("""with recursive n as (select p_partkey as node, case when p_partkey > 5 then p_partkey // 5 end as parent, p_size as visits from part),
b as (select parent, arg_min(node, (-visits, node)) as child from n where parent is not null group by parent),
r as (select node as root, 0 as depth, node from n where parent is null union all select r.root, r.depth + 1, b.child from r join b on b.parent = r.node where r.depth < 12)
select root, depth::int as depth, node from r""")
def best_paths(spark, sf_dir):
    """Parts as a search tree with five children a node and their size as visits: from each root the most visited child, level by level."""
    k = F.col("p_partkey")
    return M.best_path(table(spark, sf_dir, "part").select(k.alias("node"), F.when(k > 5, F.floor(k / 5)).alias("parent"), F.col("p_size").alias("visits")), 12)


_STUDY = "case p_size % 4 when 0 then 'financebench' when 1 then 'crag-sports' when 2 then 'synthetic_financebench' else 'hotpot' end || '-' || p_brand"


@query(f"with s as (select distinct {_STUDY} as study from part), t(name, title, accuracy) as (values ('financebench', 'Amazon Q', 0.592::double), ('financebench', 'Azure Assistant (GPT-4o-Mini)', 0.551), ('financebench', 'Azure Assistant (GPT-4o)', 0.653), ('crag-sports', 'Amazon Q', 0.63), ('crag-music', 'Amazon Q', 0.735)) select study, title, accuracy from s join t on contains(study, name) where not contains(study, 'synthetic_')")
def published_comparisons(spark, sf_dir):
    """Published accuracies for studies whose name holds a data set's."""
    known = spark.createDataFrame(list(M.PUBLISHED), "name string, title string, accuracy double")
    return M.comparisons(table(spark, sf_dir, "part").selectExpr(f"{_STUDY} as study"), known)


@query("""with s as (select min(p_size) as a, max(p_size) as b, min(p_retailprice) as c, max(p_retailprice) as d from part),
e as (select list_transform(range(0, 11), lambda i: a + (b - a) * i / 10.0 - case when i = 0 then (b - a) * 0.001 else 0 end) as es, list_transform(range(0, 11), lambda i: c + (d - c) * i / 10.0 - case when i = 0 then (d - c) * 0.001 else 0 end) as ep from s),
p as (select *, greatest(1, list_sum(list_transform(range(1, 11), lambda i: (p_size > es[i])::int)))::int as i, greatest(1, list_sum(list_transform(range(1, 11), lambda i: (p_retailprice > ep[i])::int)))::int as j from part, e)
select p_partkey, '(' || trunc(es[i])::int || ', ' || trunc(es[i + 1])::int || ']' as size, '(' || printf('%g', ep[j]) || ', ' || printf('%g', ep[j + 1]) || ']' as price, p_brand as brand, case when p_partkey % 3 = 0 then 'True' else 'False' end as flag, case when p_size % 4 > 0 then p_type else 'N/A' end as kind, case when p_size % 3 > 0 then printf('%g', p_size % 5 / 4.0) else 'N/A' end as few from p""")
def mergeable_params(spark, sf_dir):
    """Parameters of parts as texts that studies can be merged by: bins, values, switches, N/A for null."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", size.alias("size"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 3 == 0, True).alias("flag"), F.when(size % 4 > 0, F.col("p_type")).alias("kind"), F.when(size % 3 > 0, size % 5 / 4.0).alias("few"), F.lit("x").alias("same"),
    )
    out, kept = M.mergeable(rows, ["size", "price", "brand", "flag", "kind", "few", "same"])
    return out.select("p_partkey", *kept)


@query("""with c as (select e.label, d.lang, e.vec_id from embeddings e join documents d on d.doc_id = e.vec_id),
k as (select label, lang, count(*) as n from c group by all),
s as (select label, list(vec_id order by vec_id)[1:3] as samples from c group by label)
select k.label, sum(n)::bigint as size, string_agg(lang || ':' || n, ',' order by n desc, lang) as types, arg_min(lang, (-n, lang)) as dominant, round(100.0 * max(n) / sum(n), 6) as percent, any_value(samples) as samples from k join s using (label) group by k.label""")
def cluster_types(spark, sf_dir):
    """Size, distribution of types, dominant type and its share, and three members of every cluster."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("doc_id")).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    kinds = rows.groupBy("label", "lang").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("doc_id"))).where("r <= 3").groupBy("label").agg(F.array_sort(F.collect_list("doc_id")).alias("samples"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "lang"))), lambda x: F.concat(x["lang"], F.lit(":"), (-x["n"]).cast("string")))
    out = kinds.groupBy("label").agg(F.sum("n").alias("size"), F.array_join(listed, ",").alias("types"), F.min_by("lang", F.struct((-F.col("n")).alias("n"), "lang")).alias("dominant"), F.round(100.0 * F.max("n") / F.sum("n"), 6).alias("percent"))
    return out.join(first, "label")


@query(f"""with p as (select vec_id, label, e[1] as x, e[2] as y, list_sum(list_transform(e, lambda v: v * v)) as s from {_EMB}),
c as (select * from p qualify row_number() over (partition by label order by round(s, 9) desc, vec_id) <= 5),
o as (select * from p order by vec_id * 7919 % 1000003, vec_id limit (select count(*) from c)),
d as (select avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as distance from c a join c b on a.vec_id < b.vec_id),
r as (select avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as other from o a join o b on a.vec_id < b.vec_id),
w as (select (select stddev_pop(x) from c) / stddev_pop(x) as sx, (select stddev_pop(y) from c) / stddev_pop(y) as sy from p)
select round(sx, 6) as spread_x, round(sy, 6) as spread_y, round((sx + sy) / 2, 6) as ratio, round(distance, 6) as distance, round(other, 6) as other_distance from w, d, r""")
def selection_spread(spark, sf_dir):
    """How widely the five longest vectors of each cluster lie in the first two coordinates, beside as many others."""
    size = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    at = lambda i: F.element_at("embedding", i).cast("double")
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label", at(1).alias("x"), at(2).alias("y"), size.alias("s"))
    order = Window.partitionBy("label").orderBy(F.desc(F.round("s", 9)), "vec_id")
    chosen = points.withColumn("r", F.row_number().over(order)).where("r <= 5")
    other = points.orderBy(F.col("vec_id") * 7919 % 1_000_003, "vec_id").limit(chosen.count())
    out = M.selection_spread(points.select("vec_id", "x", "y"), chosen, other)
    return out.select(*[F.round(c, 6).alias(c) for c in ("spread_x", "spread_y", "ratio", "distance", "other_distance")])


_BINNED = "greatest(1, ceil(({0} - min({0}) over ()) / ((max({0}) over () - min({0}) over ()) / 10.0)))::int"


@query(f"with b as (select {_BINNED.format('p_size')} as size_bin, {_BINNED.format('p_retailprice')} as price_bin, p_partkey % 1000 as v from part) select size_bin, price_bin, count(*)::bigint as n, round(avg(v), 6) as mean, max(v) as best from b group by all")
def param_pair_bins(spark, sf_dir):
    """Statistics of a score by ten bins of each of two parameters."""
    rows = T.bins(table(spark, sf_dir, "part"), "p_size").withColumnRenamed("bin", "size_bin")
    rows = T.bins(rows, "p_retailprice").withColumnRenamed("bin", "price_bin").withColumn("v", F.col("p_partkey") % 1000)
    return rows.groupBy("size_bin", "price_bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("best"))


@query(f"""with t as (select p_brand as study, {_BINNED.format('p_size')} as bin, p_partkey as number, p_retailprice / max(p_retailprice) over (partition by p_brand) as v0, (p_partkey * 7 % 101)::double as v1 from part),
f as (select * from t where not exists (select 1 from t o where o.study = t.study and o.bin = t.bin and (o.v0 >= t.v0 and o.v1 < t.v1 or o.v0 > t.v0 and o.v1 <= t.v1 or o.v0 = t.v0 and o.v1 = t.v1 and o.number < t.number)))
select bin, count(*)::bigint as n, round(min(v0), 6) as least, round(quantile_cont(v0, 0.25), 6) as q1, round(median(v0), 6) as median, round(quantile_cont(v0, 0.75), 6) as q3, round(max(v0), 6) as most, round(median(v1), 6) as median_cost from f group by bin""")
def param_bin_fronts(spark, sf_dir):
    """A parameter's bins over all studies: the fronts of each study and bin, with scores as shares of the study's best, in quartiles."""
    best = F.max("p_retailprice").over(Window.partitionBy("p_brand"))
    rows = T.bins(table(spark, sf_dir, "part"), "p_size").select(F.concat_ws("|", "p_brand", "bin").alias("study"), "bin", F.col("p_partkey").alias("number"), (F.col("p_retailprice") / best).alias("v0"), (F.col("p_partkey") * 7 % 101).cast("double").alias("v1"))
    q = lambda c, p, name: F.round(F.percentile(c, p), 6).alias(name)
    return T.pareto_front(rows).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("v0"), 6).alias("least"), q("v0", 0.25, "q1"), q("v0", 0.5, "median"), q("v0", 0.75, "q3"), F.round(F.max("v0"), 6).alias("most"), q("v1", 0.5, "median_cost"))


@query()
def kneedle_knees(spark, sf_dir):
    """The knee of each brand's front by its difference curve; a test holds it against a plain version."""
    return T.kneedle(part_trials(spark, sf_dir))
