"""Queries on the vector index, codebooks, rank correlation and selected subgraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation, graphs, vector_index
from ..operators import selection as S
from ..sources.tables import table
from .base import query
from .retrieval import _EMB

_QUERIES = "select vec_id as query_id, e as q from {0} where vec_id % 20 = 0".format(_EMB)


def _asked(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return base, base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query()
def vector_index_topk(spark, sf_dir):
    """The ten nearest in the lists that a query is sent to; a test holds recall at 0.9 or more against dense_topk."""
    base, asked = _asked(spark, sf_dir)
    return vector_index.search(vector_index.build(base), asked, 10).withColumn("score", F.round("score", 6))


@query(f"with q as ({_QUERIES}), h as (select query_id, vec_id, list_cosine_similarity(q, e) as score from q join {_EMB} b on vec_id <> query_id) select query_id, vec_id, round(score, 6) as score, (row_number() over (partition by query_id order by round(score, 9) desc, vec_id))::int as rank from h qualify rank <= 10")
def vector_index_exact_topk(spark, sf_dir):
    """The ten nearest of all; lists whose centroid and radius rule them out are not visited."""
    base, asked = _asked(spark, sf_dir)
    return vector_index.search_exact(vector_index.build(base), asked, 10).withColumn("score", F.round("score", 6))


@query()
def cluster_codebook_bounds(spark, sf_dir):
    """Bounds by learned code words in eight subspaces; a test holds them against all distances."""
    return vector_index.codebook_bounds(table(spark, sf_dir, "embeddings"))


_SELECTED = f"""g as (select a.vec_id as u, b.vec_id as v, 1 - list_cosine_similarity(a.e, b.e) as w from {_EMB} a join {_EMB} b on a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) < -0.3),
n as (select x as node, sum(w) as degree from (select u as x, w from g union all select v, w from g) group by x),
s as (select node from n where round(degree, 9) <= (select round(avg(degree), 9) from n)),
i as (select * from g semi join s on s.node = u semi join s t on t.node = v)"""


@query(f"""with recursive {_SELECTED},
e as (select u, v from i union select v, u from i),
r as (select node as a, node as b from s union select r.a, e.v from r join e on e.u = r.b),
p as (select a, min(b) as part from r group by a),
z as (select part, count(*) as size from p group by part),
c as (select (select count(*) from s) as n, (select count(*) from i) as m, (select coalesce(sum(w), 0) from i) as w)
select n::bigint as nodes, m::bigint as edges, round(w / n, 6) as weighted_density, round(2.0 * m / (n * (n - 1)), 6) as density, round(2.0 * m / n, 6) as mean_degree,
       (select count(*) from z) = 1 as connected, (select count(*) from z)::bigint as parts, (select max(size) from z)::bigint as largest_part from c""")
def selected_subgraph_report(spark, sf_dir):
    """The part of the dissimilarity graph that nodes of at most the mean weighted degree span."""
    base = table(spark, sf_dir, "embeddings")
    degrees = S._cut(S.dissimilarity_degrees(base, -0.3))
    mean = degrees.agg(F.round(F.avg("degree"), 9).alias("mean"))
    chosen = S._cut(degrees.crossJoin(F.broadcast(mean)).where(F.round("degree", 9) <= F.col("mean")).select("node"))  # one row
    joined = S._cut(S.dissimilarity_parts(base.join(chosen.withColumnRenamed("node", "vec_id"), "vec_id", "left_semi"), -0.3))
    weights = joined.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    report = graphs.report_of(joined.select("u", "v"), chosen, weights)
    return report.withColumns({c: F.round(c, 6) for c in ("weighted_density", "density", "mean_degree")})


_PARAMS = "(select p_partkey, p_retailprice as y, p_size as params_size, p_brand as params_brand, case when p_size > 25 then 'True' else 'False' end as params_large, 'part' as params_kind from part)"


@query(f"""with o as (select *, row_number() over (order by y, p_partkey) as i from {_PARAMS}), n as (select count(*) as n from o),
j as (select sign(a.params_size - b.params_size) as dx, sign(a.y - b.y) as dy from o a join o b on a.i < b.i),
ty as (select sum(abs(dy)) as q from j),
k as (select 'size' as parameter, '*' as value, sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))) as correlation, (select n from n) as count from j),
l as (select p.p_partkey, p.y, u.parameter, u.value from {_PARAMS} p, (select unnest(['brand', 'large']) as k) x, lateral (select k as parameter, case k when 'brand' then p.params_brand else p.params_large end as value) u),
c as (select parameter, value, count(*) as m from l group by all),
s as (select a.parameter, a.value, sum(sign(a.y - b.y)) as s from l a join o b on true group by all),
h as (select c.parameter, c.value, s.s / sqrt(c.m * (n - c.m) * q) as correlation, least(c.m, n - c.m) as count from c join s using (parameter, value) cross join n cross join ty),
t as (select * from k union all select * from h union all select 'kind', '*', null, (select n from n))
select parameter, value, round(correlation, 9) as correlation, count::bigint as count,
       round(case when count(correlation) over w = count(*) over w then sum(abs(correlation) * count) over w / sum(count) over w end, 9) as strength from t window w as (partition by parameter)""")
def what_correlates(spark, sf_dir):
    """Kendall's tau of every parameter of parts, or of each of its values, with the price."""
    rows = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("params_size"), F.col("p_brand").alias("params_brand"), (F.col("p_size") > 25).alias("params_large"), F.lit("part").alias("params_kind"), "p_retailprice",
    )
    out = correlation.what_correlates(rows, [c for c in rows.columns if c.startswith("params_")], "p_retailprice")
    return out.withColumns({c: F.round(c, 9) for c in ("correlation", "strength")})


@query(f"""with c as (select label, i, avg(e[i]) as m from (select label, e, unnest(range(1, 65)) as i from {_EMB}) group by label, i), k as (select label, list(m order by i) as centre from c group by label),
d as (select vec_id, b.label, list_distance(e, centre) as far from {_EMB} b join k on b.label = k.label),
f as (select vec_id, label from (select *, row_number() over (partition by label order by round(far, 9) desc, vec_id) as place, count(*) over (partition by label) as n from d) where place <= floor(n * 0.1)),
o as (select vec_id, label from d where vec_id not in (select vec_id from f) order by vec_id * 7919 % 1000003, vec_id limit (select floor(count(*) * 0.2)::bigint from d))
select vec_id, label, 1 as stage from f union all select vec_id, label, 2 from o""")
def outliers_removed(spark, sf_dir):
    """The farthest tenth of each cluster, then a fifth of all by chance from the rest."""
    return S.two_stage_outliers(table(spark, sf_dir, "embeddings"), 0.1, 0.2, F.col("vec_id") * 7919 % 1_000_003)
