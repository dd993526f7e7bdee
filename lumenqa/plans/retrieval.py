"""Queries on retrieval, selection and the experience memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import configs as C
from ..operators import retrieval as R
from ..operators import selection as S
from ..operators import trials as T
from ..operators.order import cut
from ..sources.tables import table
from ..streaming.rollup import windowed_average
from .answers import _words
from .base import query, sql

_SPLIT = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"
_CHUNKS = f"(select doc_id, chunk, array_to_string(w[1 + chunk * 48 : chunk * 48 + 64], ' ') as text from (select doc_id, {_SPLIT} as w, unnest(range(0, 1 + greatest(len({_SPLIT}) - 1 - 16, 0) // 48))::int as chunk from documents) where len(w) > 0)"
def _bm25(queries: str = "benchmark", key: str = "item_id", k: int = 20) -> str:
    return f"""(with d as (select doc_id, {_words('text')} as w from documents), s as (select count(*) as n, avg(len(w)) as mean from d),
p as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(w) as dl, unnest(w) as term from d) group by doc_id, term),
f as (select term, count(*) as df from p group by term), q as (select distinct {key}, unnest({_words('text')}) as term from {queries}),
h as (select {key}, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) as score from p join q using (term) join f using (term) cross join s group by {key}, doc_id)
select {key}, doc_id, score, row_number() over (partition by {key} order by round(score, 9) desc, doc_id) as rank from h qualify rank <= {k})"""


_BM25 = _bm25()
_EMB = "(select vec_id, label, embedding::double[] as e from embeddings)"
_DENSE = f"(select a.vec_id as item_id, b.vec_id as doc_id, list_cosine_similarity(a.e, b.e) as score, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.e, b.e), 9) desc, b.vec_id) as rank from {_EMB} a join benchmark i on i.item_id = a.vec_id join {_EMB} b on a.vec_id <> b.vec_id qualify rank <= 20)"


@query(f"select doc_id, chunk, text from {_CHUNKS}")
def chunk_documents_token(spark, sf_dir):
    return R.chunk_tokens(table(spark, sf_dir, "documents"), 64, 16)


@query(f"select doc_id, chunk, array_to_string(list(text order by chunk) over (partition by doc_id order by chunk rows between 1 preceding and 1 following), ' ') as context from {_CHUNKS}")
def neighbour_context(spark, sf_dir):
    return R.neighbours(R.chunk_tokens(table(spark, sf_dir, "documents"), 64, 16), 1)


def _lexical(spark, sf_dir, k=20):
    return R.bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k)


@query(f"select item_id, doc_id, round(score, 6) as score, rank::int as rank from {_BM25}")
def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"with q as (select vec_id as query_id, e as q from {_EMB} where vec_id % 20 = 0), h as (select query_id, vec_id, list_cosine_similarity(q, e) as score from q join {_EMB} b on vec_id <> query_id) select query_id, vec_id, round(score, 6) as score, (row_number() over (partition by query_id order by round(score, 9) desc, vec_id))::int as rank from h qualify rank <= 10")
def dense_topk(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    queries = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.dense(queries, base.select("vec_id", "embedding"), 10).withColumn("score", F.round("score", 6))


def _two_lists(spark, sf_dir):
    """A lexical list and a dense one: the vectors of an item and of a document are those with their ids."""
    items, base = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    own = base.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = R.dense(own, base, 20).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "score", "rank")
    lists = [(name, x.select("item_id", "doc_id", F.lit(name).alias("list"), "score", "rank")) for name, x in (("lexical", _lexical(spark, sf_dir)), ("dense", near))]
    return lists[0][1].union(lists[1][1])


def _fused(value: str, total: str) -> str:
    return f"""with h as (select *, 'lexical' as list from {_BM25} union all select *, 'dense' from {_DENSE}),
    v as (select *, {value} as value from h window w as (partition by item_id, list)), f as (select item_id, doc_id, {total}(value) as score from v group by item_id, doc_id)
    select item_id, doc_id, round(score, 6) as score, (row_number() over (partition by item_id order by round(score, 9) desc, doc_id))::int as rank from f qualify rank <= 10"""


_RELATIVE = "case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 1.0 end"
_DISTANCE = "case when stddev_pop(score) over w > 0 then greatest(0.0, least(1.0, (score - (avg(score) over w - 3 * stddev_pop(score) over w)) / (6 * stddev_pop(score) over w))) else 1.0 end"


@query(_fused("score", "max"))
def hybrid_simple(spark, sf_dir):
    return R.fuse(_two_lists(spark, sf_dir), "simple", 10).withColumn("score", F.round("score", 6))


@query(_fused("1 / (60 + rank)::double", "sum"))
def hybrid_rrf(spark, sf_dir):
    return R.fuse(_two_lists(spark, sf_dir), "reciprocal_rerank", 10).withColumn("score", F.round("score", 6))


@query(_fused(_RELATIVE, "sum"))
def hybrid_relative_score(spark, sf_dir):
    return R.fuse(_two_lists(spark, sf_dir), "relative_score", 10).withColumn("score", F.round("score", 6))


@query(_fused(_DISTANCE, "sum"))
def hybrid_dist_based(spark, sf_dir):
    return R.fuse(_two_lists(spark, sf_dir), "dist_based_score", 10).withColumn("score", F.round("score", 6))


_WEIGHT = "case when list = 'lexical' then 0.3 else 0.7 end"


@query(_fused(f"{_WEIGHT} * ({_RELATIVE})", "sum"))
def hybrid_weighted(spark, sf_dir):
    """Relative scores, weighted 0.3 for the lexical and 0.7 for the dense list."""
    weights = F.when(F.col("list") == "lexical", 0.3).otherwise(0.7)
    return R.fuse(_two_lists(spark, sf_dir), "relative_score", 10, weight=weights).withColumn("score", F.round("score", 6))


@query(f"with h as (select *, 0 as place from {_BM25} union all select *, 1 from {_DENSE}), f as (select item_id, doc_id, arg_min(score, place) as score from h group by item_id, doc_id) select item_id, doc_id, round(score, 6) as score, (row_number() over (partition by item_id order by round(score, 9) desc, doc_id))::int as rank from f qualify rank <= 10")
def dedup_fusion(spark, sf_dir):
    """The first occurrence of each document, lexical list first, by score."""
    hits = _two_lists(spark, sf_dir).withColumn("place", F.when(F.col("list") == "lexical", 0).otherwise(1))
    return R.dedup(hits, 10).withColumn("score", F.round("score", 6))


_THIRDS = "(select item_id * 3 + sub as part, array_to_string(w[1 + len(w) * sub // 3 : len(w) * (sub + 1) // 3], ' ') as text from (select item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w, unnest([0, 1, 2])::int as sub from benchmark))"


@query(f"with h as (select part // 3 as item_id, (part % 3)::int as sub, doc_id, score from {_bm25(_THIRDS, 'part')}), f as (select item_id, doc_id, max(score * (1 - 0.1 * sub)) as weighted, arg_max(score, score * (1 - 0.1 * sub)) as score from h group by item_id, doc_id) select item_id, doc_id, round(score, 6) as score, round(weighted, 6) as weighted, (row_number() over (partition by item_id order by round(weighted, 9) desc, doc_id))::int as rank from f qualify rank <= 5")
def subquery_fusion(spark, sf_dir):
    """Sub-queries are the thirds of an item's words; their hits are regrouped by item, earlier sub-queries weigh more."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    thirds = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("sub"))
    start, end = F.floor(F.size("w") * F.col("sub") / 3).cast("int"), F.floor(F.size("w") * (F.col("sub") + 1) / 3).cast("int")
    parts = thirds.select((F.col("item_id") * 3 + F.col("sub")).alias("part"), F.array_join(F.slice("w", start + 1, end - start), " ").alias("text"))
    hits = R.bm25(parts, table(spark, sf_dir, "documents"), 20, "part").withColumns({"item_id": F.floor(F.col("part") / 3).cast("long"), "sub": (F.col("part") % 3).cast("int")})
    return R.fuse_subqueries(hits, 5).withColumns({"score": F.round("score", 6), "weighted": F.round("weighted", 6)})


@query(f"select item_id, string_agg('Context ' || rank || ':' || chr(10) || text, chr(10) || chr(10) order by rank) as context from {_BM25} h join documents using (doc_id) where rank <= 3 and trim(text) <> '' group by item_id")
def context_assembly(spark, sf_dir):
    hits = cut(_lexical(spark, sf_dir, 3))
    sent = F.broadcast(hits) if hits.count() <= R.MAX_SENT_PAIRS else hits  # so texts stay where they are
    return R.contexts(table(spark, sf_dir, "documents").select("doc_id", "text").join(sent, "doc_id"))


@query(f"with h as (select item_id, doc_id, score, rank from {_BM25}), r as (select h.*, row_number() over (partition by item_id order by quality desc nulls last, rank) as place, coalesce(quality, 0) as gain from h left join labels using (doc_id)), i as (select *, row_number() over (partition by item_id order by gain desc, doc_id) as ideal from r) select item_id, round(coalesce(sum(case when rank <= 10 then (power(2, gain) - 1) / log2(1 + rank) end) / nullif(sum(case when ideal <= 10 then (power(2, gain) - 1) / log2(1 + ideal) end), 0), 0), 6) as ndcg, round(coalesce(max(case when gain > 0 then 1.0 / rank end), 0), 6) as reciprocal_rank from i group by item_id")
def ndcg_reciprocal_rank(spark, sf_dir):
    judged = _lexical(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("gain", F.coalesce("quality", F.lit(0)))
    rows = judged.withColumn("ideal", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("gain"), "doc_id")))
    dcg = lambda place: F.sum(F.when(F.col(place) <= 10, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(1 + F.col(place))))
    found = F.max(F.when(F.col("gain") > 0, 1.0 / F.col("rank")))
    return rows.groupBy("item_id").agg(F.round(F.coalesce(F.when(dcg("ideal") > 0, dcg("rank") / dcg("ideal")), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(found, F.lit(0.0)), 6).alias("reciprocal_rank"))


@query(f"with m as (select q.label as query_label, q.vec_id, d.label, max(list_dot_product(q.e, d.e)) as best from {_EMB} q join {_EMB} d on true group by all) select query_label::bigint as query_label, label::bigint as label, round(sum(best) / count(*), 6) as score from m group by all")
def maxsim_colbert(spark, sf_dir):
    """All vectors of a label are its query tokens, and all of each label a document's."""
    return R.max_sim(table(spark, sf_dir, "embeddings")).withColumn("score", F.round("score", 6))


sql("tournament_rerank", """
with r as (select doc_id, source, n_chars, row_number() over (partition by source order by doc_id) - 1 as pos from {documents}),
     c as (select *, floor(pos / 5) as heat, row_number() over (partition by source, floor(pos / 5) order by n_chars desc, doc_id) as place from r)
select source, doc_id, cast(row_number() over (partition by source order by case when place <= 2 then 0 else 1 end, case when place <= 2 then n_chars end desc, pos) as int) as rank from c""")
sql("rerank_topn", """
select source, doc_id, rank from (select source, doc_id, cast(row_number() over (partition by source order by n_chars desc, doc_id) as int) as rank from {documents}) r where rank <= 5""")
sql("html_to_text", r"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' '), '[ \t\n\r]+', ' ')) as text from {pages}", r"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) as text from pages")


_PLANES = "[" + ", ".join("[" + ", ".join(f"{x!r}::double" for x in row) + "]" for row in S.lsh_planes(64).tolist()) + "]"


@query(f"select array_to_string(list_transform({_PLANES}, lambda h: case when list_dot_product(e, h) > 0 then '1' else '0' end), '') as code, count(*)::bigint as n, min(vec_id) as least from {_EMB} group by 1")
def lsh_clusters(spark, sf_dir):
    """Signs of projections on 64 fixed planes over all 64 coordinates."""
    return S.lsh_codes(table(spark, sf_dir, "embeddings")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))


@query(f"select a.vec_id, b.label::bigint as label, round(max(list_distance(a.e, b.e)), 6) as bound from {_EMB} a cross join {_EMB} b group by all")
def cluster_upper_bounds(spark, sf_dir):
    """The exact bound, which is the largest distance itself."""
    return S.farthest_in_clusters(table(spark, sf_dir, "embeddings")).withColumn("bound", F.round("bound", 6))


@query(f"with x as (select vec_id, label, i * 8 // 64 as part, i, e[i + 1] as x from (select *, unnest(range(0, 64)) as i from {_EMB})), c as (select label, part, i, avg(x) as c from x group by all), d as (select x.vec_id, x.label as own, c.label, x.part, sqrt(sum((x - c) * (x - c))) as far from x join c on x.i = c.i group by all), r as (select label, part, max(far) as radius from d where own = label group by all) select vec_id, d.label, round(sum(far + radius), 6) as bound from d join r on d.label = r.label and d.part = r.part group by all")
def cluster_subspace_bounds(spark, sf_dir):
    """Bounds by centres and radii in eight subspaces."""
    return S.cluster_bounds(table(spark, sf_dir, "embeddings")).withColumn("bound", F.round("bound", 6))


@query(f"select a.vec_id as u, b.vec_id as v, round(1 - list_cosine_similarity(a.e, b.e), 6) as w from {_EMB} a join {_EMB} b on a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) < -0.2")
def dissimilarity_graph(spark, sf_dir):
    return S.dissimilarity_graph(table(spark, sf_dir, "embeddings"), -0.2).withColumn("w", F.round("w", 6))


@query(f"""with p as (select vec_id, e, row_number() over (order by vec_id) - 1 as place, count(*) over () as n from {_EMB}),
near as (select a.vec_id as u, b.vec_id as v from p a join p b on a.vec_id <> b.vec_id qualify row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.e, b.e), 9) desc, b.vec_id) <= 10),
d as (select vec_id as u, e as x, place, n, unnest(range(0, least(n - 1, 60)::bigint)) as draw from p),
s as (select d.u, p.vec_id as v, x, p.e as y, draw from d join p on p.place = (d.place + 1 + draw * 7919 % (d.n - 1)) % d.n),
k as (select * from s anti join near using (u, v) qualify row_number() over (partition by u order by draw) <= 50)
select least(u, v) as u, greatest(u, v) as v, round(max(1 - list_cosine_similarity(x, y)), 6) as w from k where list_cosine_similarity(x, y) < -0.1 group by 1, 2""")
def dissimilarity_graph_sampled(spark, sf_dir):
    """50 partners a node, none of its 10 nearest."""
    return S.sampled_graph(table(spark, sf_dir, "embeddings"), -0.1, 50, 10).withColumn("w", F.round("w", 6))


@query(f"with g as (select a.vec_id as u, b.vec_id as v, 1 - list_cosine_similarity(a.e, b.e) as w from {_EMB} a join {_EMB} b on a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) < -0.2), n as (select u as x from g union select v from g) select (select count(*) from n)::bigint as nodes, count(*)::bigint as edges, round(sum(w) / (select count(*) from n), 6) as density from g")
def subgraph_density(spark, sf_dir):
    nodes = S.dissimilarity_degrees(table(spark, sf_dir, "embeddings"), -0.2)
    edges = F.coalesce(F.sum("links") / 2, F.lit(0)).cast("long")
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), edges.alias("edges"), F.round(F.sum("degree") / 2 / F.count(F.lit(1)), 6).alias("density"))


@query(f"with p as (select a.vec_id as u, b.vec_id as v, 1 - list_cosine_similarity(a.e, b.e) as w from {_EMB} a join {_EMB} b on a.vec_id <> b.vec_id), f as (select u, v from p qualify row_number() over (partition by u order by round(w, 9) desc, v) <= 3) select u, v from f union select v, u from f")
def kfn_graph(spark, sf_dir):
    return S.farthest_neighbours(table(spark, sf_dir, "embeddings"), 3)


@query()
def maxmin_selection(spark, sf_dir):
    return S.max_min(table(spark, sf_dir, "embeddings"), 10)


@query()
def submodular_selection(spark, sf_dir):
    return S.submodular(table(spark, sf_dir, "embeddings"), 10)


@query()
def greedy_peeling(spark, sf_dir):
    return S.densest_dissimilar(table(spark, sf_dir, "embeddings"), -0.2)


@query()
def dalkss_selection(spark, sf_dir):
    return S.dalkss(S.sampled_graph(table(spark, sf_dir, "embeddings"), -0.1, 50, 10), 40)


@query()
def coreset_weights(spark, sf_dir):
    return S.coreset(table(spark, sf_dir, "embeddings"), 5)


sql("cluster_profile", """
with c as (select e.label, d.lang, count(*) as n from {embeddings} e join {documents} d on d.doc_id = e.vec_id group by e.label, d.lang),
     r as (select *, sum(n) over (partition by label) as total, row_number() over (partition by label order by n desc, lang) as place from c)
select label, lang as dominant, cast(total as bigint) as size, round(cast(100 * n as double) / total, 6) as percent from r where place = 1""")


@query(f"with c as (select label, i, avg(e[i]) as m from (select label, e, unnest(range(1, 65)) as i from {_EMB}) group by label, i), k as (select label, list(m order by i) as centre from c group by label), d as (select vec_id, b.label, list_distance(e, centre) as far from {_EMB} b join k on b.label = k.label), r as (select *, row_number() over (partition by label order by round(far, 9) desc, vec_id) as place, count(*) over (partition by label) as n from d) select vec_id, label, round(far, 6) as far from r where place <= floor(n * 0.1)")
def outlier_two_stage(spark, sf_dir):
    """The tenth of each cluster that is farthest from its centre."""
    base = table(spark, sf_dir, "embeddings")
    mean = base.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    apart = F.sqrt(F.aggregate(F.zip_with("embedding", "centre", lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, t: s + t))
    rows = base.join(centre, "label").select("vec_id", "label", apart.alias("far"))
    order, whole = Window.partitionBy("label").orderBy(F.desc(F.round("far", 9)), "vec_id"), Window.partitionBy("label")
    placed = rows.withColumns({"place": F.row_number().over(order), "n": F.count(F.lit(1)).over(whole)})
    return placed.where("place <= floor(n * 0.1)").select("vec_id", "label", F.round("far", 6).alias("far"))


sql("selection_rate", "select lang, count(*) as n, sum(case when doc_id % 5 = 0 then 1 else 0 end) as selected, round(sum(case when doc_id % 5 = 0 then 1 else 0 end) / cast(count(*) as double), 6) as rate from {documents} group by lang", "select lang, count(*) as n, sum(case when doc_id % 5 = 0 then 1 else 0 end)::bigint as selected, round(sum(case when doc_id % 5 = 0 then 1 else 0 end) / cast(count(*) as double), 6) as rate from documents group by lang")
_CONFIG = """(select p_partkey as config_id, p_partkey as created, p_retailprice as avg_f1_score, p_brand as splitter_method, p_type as retrieval_method, concat(p_brand, '-', p_size % 5) as embedding_model, concat(p_type, '-', p_size % 3) as template_name,
  p_size as retrieval_top_k, cast(floor(p_retailprice) as int) as splitter_chunk_size, cast(p_size % 10 as double) / 10 as splitter_overlap, p_partkey % 2 = 0 as reranker_enabled, p_partkey % 3 = 0 as hyde_enabled, p_size > 25 as query_decomposition_enabled from {part})"""
_ALIKE = "round(" + " + ".join(
    [f"{w} * (a.{c} = b.{c})::int" for c, w in C.SAME.items()]
    + [f"{w} * case when a.{c} = b.{c} then 1.0 when a.{c} <> 0 and b.{c} <> 0 then greatest(0.0, 1 - abs(a.{c} - b.{c}) / greatest(a.{c}, b.{c})::double) else 0.0 end" for c, w in C.RELATIVE.items()]
    + [f"{w} * case when abs(a.{c} - b.{c}) < 0.01 then 1.0 else greatest(0.0, 1 - 2 * abs(a.{c} - b.{c})) end" for c, w in C.ABSOLUTE.items()]
    + [f"{w} * (a.{c} = b.{c})::int" for c, w in C.FLAGS.items()]
) + ", 12)"
_DUCK_CONFIG = _CONFIG.replace("{part}", "part")


def _configs(spark, sf_dir):
    """Parts as configurations of all ten parameters that are compared."""
    return spark.sql(f"select * from {_CONFIG}", part=table(spark, sf_dir, "part"))


@query(f"with c as {_DUCK_CONFIG} select a.config_id as older, b.config_id as newer, {_ALIKE} as similarity, round(b.avg_f1_score - a.avg_f1_score, 4) as delta from c a join c b on a.config_id < b.config_id where {_ALIKE} > 0.5")
def config_relations(spark, sf_dir):
    d = F.col("delta")  # rounded by arithmetic as in DuckDB: a row a pair is too many for decimals; null where a score is
    rounded = F.when(~F.isnan(d), F.signum(d) * F.floor(F.abs(d) * 10000 + 0.5) / 10000)
    return C.config_relations(_configs(spark, sf_dir)).withColumn("delta", rounded)


def _top_configs(over: float) -> str:
    return f"with c as {_DUCK_CONFIG}, r as (select a.config_id as config, b.config_id as other, {_ALIKE} as s from c a join c b on a.config_id <> b.config_id), t as (select *, row_number() over (partition by config order by s desc, other) as place from r where s > {over}) select config, other, s as similarity from t where place <= 3"


@query(_top_configs(-1.0))
def similar_configs_top3(spark, sf_dir):
    return C.similar_configs(_configs(spark, sf_dir)).select(F.col("config_id").alias("config"), "other", "similarity")


@query(_top_configs(0.5))
def similar_configs_over_half(spark, sf_dir):
    return C.similar_configs(_configs(spark, sf_dir), 3, 0.5).select(F.col("config_id").alias("config"), "other", "similarity")


_DESCRIBED = "concat_ws(' ', p_name, p_type, p_brand, concat('size', p_size))"


@query(f"with w as (select p_partkey as id, list_distinct(list_filter(regexp_split_to_array(lower({_DESCRIBED}), '\\s+'), lambda x: x <> '')) as w from part), j as (select a.id as older, b.id as newer, len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))) as s from w a join w b on a.id < b.id) select older, newer, round(s, 6) as strength from j where s > 0.3")
def insight_relations(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("insight_id"), F.expr(_DESCRIBED).alias("description"))
    return C.insight_relations(rows, digits=6)  # rounded once a pair of distinct sets of words


_INSIGHT = "case doc_id % 4 when 0 then 'Hybrid search helps' when 1 then 'CoT and rerank' when 2 then 'rerank a location question' else 'nothing' end"
_CONF = "cast(n_chars % 100 as double) / 100"


@query(f"with r as (select doc_id, least(1.0, 0.5 * ({_CONF}) + case when doc_id % 4 = 0 and doc_id % 3 = 0 then 0.3 else 0 end + case when doc_id % 4 = 1 and doc_id % 5 = 0 then 0.2 else 0 end + case when doc_id % 4 in (1, 2) and doc_id % 2 = 0 then 0.2 else 0 end + case when doc_id % 4 = 2 and doc_id % 7 = 0 then 0.3 else 0 end) as relevance, doc_id % 10 as grp from documents) select grp, doc_id, round(relevance, 6) as relevance from r where relevance > 0.5 qualify row_number() over (partition by grp order by round(relevance, 9) desc, doc_id) <= 5")
def insight_top5(spark, sf_dir):
    """The five most relevant insights of each group whose relevance is over one half."""
    d = F.col("doc_id")
    relevance = C.insight_relevance(
        F.expr(_CONF), F.expr(_INSIGHT), F.when(d % 3 == 0, "hybrid").otherwise("sparse"), F.when(d % 5 == 0, "CoT").otherwise("default"), d % 2 == 0, F.when(d % 7 == 0, "location").otherwise(""),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", (d % 10).alias("grp"), relevance.alias("relevance")).where("relevance > 0.5")
    return R.top_k(rows, "grp", "doc_id", 5, "relevance").select("grp", "doc_id", F.round("relevance", 6).alias("relevance"))


@query("with a as (select event_id, event_id % 500 as config, ts, value from events where event_id % 3 <> 0), b as (select event_id, event_id % 500, ts, value from events where event_id % 3 = 0) select config, arg_max(event_id, (epoch_us(ts), f, event_id)) as event_id, arg_max(value, (epoch_us(ts), f, event_id)) as value from (select *, 0 as f from a union all select *, 1 from b) group by config")
def memory_upsert(spark, sf_dir):
    """The latest run of each configuration of a stored and a fresh table; ids make times distinct here."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("config"), "event_id", F.struct("ts", (F.col("event_id") % 3 == 0).cast("int").alias("f"), "event_id").alias("at"), "value")
    latest = C.upsert(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"), "config", "at")
    return latest.select("config", "event_id", "value")


sql("config_qa_consistency", """
select o_custkey as config, count(*) as runs, sum(case when c_custkey is null then 1 else 0 end) as missing from {orders} left join {customer} on c_custkey = o_custkey and c_nationkey >= 5 group by o_custkey""", """
select o_custkey as config, count(*) as runs, sum(case when c_custkey is null then 1 else 0 end)::bigint as missing from orders left join customer on c_custkey = o_custkey and c_nationkey >= 5 group by o_custkey""")
sql("missing_runs", "select o.o_orderkey from {orders} o left anti join {lineitem} l on l.l_orderkey = o.o_orderkey", "select o.o_orderkey from orders o anti join lineitem l on l.l_orderkey = o.o_orderkey")
_PICKED = "with r as (select p_brand as study, p_partkey as id, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) - 1 as i, count(*) over (partition by p_brand) as n from part where p_partkey % 9 < 2 or p_size < 25) "
_HIGH_LOW = "select study, id, case when i < 5 then 'high' when n > 5 and i >= n - 5 then 'low' else 'medium' end as kind from r where i < 5 or n > 5 and i >= n - 5 or n > 10 and i >= n // 3 and i < least(n // 3 + 5, 2 * n // 3)"


@query(_PICKED + _HIGH_LOW)
def representative_queries(spark, sf_dir):
    return T.representatives(_scored(spark, sf_dir), "study", "id", "score")


@query(_PICKED + "select study, id from r where n < 5 or n >= 10 and (i < 3 or i >= n - 3 or i >= n // 3 and i < least(n // 3 + 4, 2 * n // 3)) or n >= 5 and n < 10 and (i < 2 or i >= n - 2 or i = n // 2)")
def diverse_sample(spark, sf_dir):
    return T.diverse_sample(_scored(spark, sf_dir), "study", "id", "score")


@query("select event_type, event_id from events qualify row_number() over (partition by event_type order by ts desc, event_id) <= 5")
def most_recent_five(spark, sf_dir):
    order = Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(order)).where("r <= 5").select("event_type", "event_id")


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 9 < 2 or p_size < 25").select(F.col("p_brand").alias("study"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))


@query("select date_trunc('day', ts) as start, event_type, count(*)::bigint as n, round(avg(value), 6) as mean from events group by 1, 2")
def windowed_event_average(spark, sf_dir):
    return windowed_average(table(spark, sf_dir, "events")).withColumn("mean", F.round("mean", 6))
