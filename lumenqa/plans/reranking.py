"""Queries on reranking, ranking losses and scores of models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import losses, scoring
from ..operators import reranking
from ..operators.retrieval import top_k
from ..sources.tables import table
from .base import query


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def _placed(spark, sf_dir):
    """A customer's orders with their place in the order of keys."""
    return table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)


@query("""with recursive p as (select o_custkey as q, o_orderkey as d, floor(o_totalprice / 1000)::bigint as w, o_orderstatus <> 'F' as yes, o_totalprice as price, row_number() over (partition by o_custkey order by o_orderkey) as r from orders qualify r <= 12),
s as (select q, 0::bigint as r, 0::bigint as used, false as taken from p where r = 1
      union all select p.q, p.r, s.used + case when s.used + p.w < 900 then p.w else 0 end, s.used + p.w < 900 from s join p on p.q = s.q and p.r = s.r + 1),
t as (select p.*, from s join p on p.q = s.q and p.r = s.r where s.taken)
select q as query_id, d as doc_id, (row_number() over (partition by q order by yes desc, case when yes then -price end, case when yes then d else r end))::int as rank, case when yes then 1.0 else 0.0 end::double as score from t""")
def budget_rerank(spark, sf_dir):
    """A customer's first twelve orders as passages with their price in thousands as words; those not yet filled are relevant, and the dearer of two is preferred."""
    placed = _placed(spark, sf_dir).where("place < 12")
    passages = placed.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), "place", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("words"), (F.col("o_orderstatus") != "F").alias("relevant"))
    price = placed.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("x"))
    other = price.withColumnsRenamed({"a": "b", "x": "y"})
    dearer = price.join(other, "query_id").where("y > x or y = x and b < a").select("query_id", "a", "b")  # of twelve orders
    return reranking.budget_rerank(passages, dearer, 1800, first=12)


@query("""with p as (select o_custkey as q, o_orderkey as d, o_totalprice as s, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders),
l as (select *, count(*) over (partition by q) as n from p where i < 100),
u as (select q, c, k, case when c * 5 + k < n then c * 5 + k else (c * 5 + k - n) % n end as i from (select distinct q, n, unnest(range(0, (n + 4) // 5)) as c from l), (select unnest(range(0, 5)) as k)),
w as (select u.*, row_number() over (partition by u.q, c order by s desc, k) as r from u join l on l.q = u.q and l.i = u.i),
b as (select q, i, min(c * 5 + r) as at from w where r <= 2 group by q, i),
o as (select l.q, l.d, row_number() over (partition by l.q order by b.at nulls last, l.i) as rank from l left join b on b.q = l.q and b.i = l.i)
select o.q as query_id, o.d as doc_id, o.rank::int as rank, l.s as score from o join l on l.q = o.q and l.i = o.rank - 1""")
def tournament_heats(spark, sf_dir):
    """A customer's first 100 orders in heats of five, of which two win, by price."""
    hits = _placed(spark, sf_dir).select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), "place", F.col("o_totalprice").alias("score"))
    return reranking.tournament_rerank(hits)


@query("""with p as (select o_custkey as q, o_orderkey as i, strftime(o_orderdate, '%Y-%m') as d, o_orderstatus = 'O' as yes, o_orderpriority || ' ' || o_orderkey as t from orders),
f as (select q, arg_min(t, i) as best from p where yes group by q),
b as (select p.*, row_number() over (partition by q order by i, d) as r from p where not yes and not exists (select 1 from p x where x.yes and x.q = p.q and x.d = p.d) qualify r <= 3)
select f.q as query_id, list_concat([best], coalesce(o, []), list_transform(range(0, 3 - coalesce(len(o), 0)), lambda x: '<padding_passage>')) as slate from f left join (select q, list(t order by r) as o from b group by q) b on b.q = f.q""")
def training_slates(spark, sf_dir):
    """A customer's first open order with up to three others of months without an open one."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("query_id"), F.date_format("o_orderdate", "yyyy-MM").alias("doc_id"), F.col("o_orderkey").alias("place"), (F.col("o_orderstatus") == "O").alias("positive"), F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("text"),
    )
    return reranking.training_slates(rows, 3)


_PAIR = "greatest(1 / (1 + exp(-(a.p - b.p))), 1e-10)"
_NEAR = "case when a.r = b.r then 0 else abs(1 / log2(1 + greatest(abs(a.r - b.r), 1)) - 1 / log2(2 + abs(a.r - b.r))) end * abs(a.g - b.g)"
_SWAP = "abs(1 / log2(1 + a.r) - 1 / log2(1 + b.r)) * abs(a.g - b.g)"
_WEIGHTS = {
    "none": "1", "ndcg_loss1": "a.g / log2(1 + a.r)", "ndcg_loss2": _NEAR, "ndcg_loss2pp": f"10 * ({_NEAR}) + {_SWAP}", "lambda_rank": _SWAP, "rank_net": "1", "rank_net_gt": "abs(a.t - b.t)", "rank_net_gt_squared": "abs(a.t * a.t - b.t * b.t)",
}
_LAMBDA = " union all ".join(f"select 'lambda_{name}' as loss, avg(-log2(greatest(pow({_PAIR}, {w}), 1e-10))) as value from g a join g b on a.q = b.q{'' if name == 'ndcg_loss1' else ' and a.t > b.t'}" for name, w in _WEIGHTS.items())


@query(f"""with s as (select o_custkey as q, (floor(o_totalprice) % 100) / 20 as p, (o_orderkey % 4)::double as t, o_orderkey as i from orders),
o as (select *, row_number() over (partition by q order by p desc, i) as r, row_number() over (partition by q order by t desc) as ideal from s),
b as (select q, greatest(sum((pow(2, t) - 1) / log2(1 + ideal)), 1e-10) as best, sum(exp(p)) as zp, sum(exp(t)) as zt from o group by q),
g as (select o.*, (pow(2, t) - 1) / best as g, exp(p) / zp as sp, exp(t) / zt as st from o join b using (q)),
v as (select 'rmse' as loss, avg(x) as value from (select sqrt(avg((t - p) * (t - p))) as x from g group by q)
      union all select 'list_net', avg(x) from (select sum(-st * ln(sp + 1e-10)) as x from g group by q)
      union all select 'rank_net', avg(greatest(b.p - a.p, 0) + ln(1 + exp(-abs(b.p - a.p)))) from g a join g b on a.q = b.q and a.t > b.t
      union all {_LAMBDA})
select loss, round(value, 6) as value from v""")
def ranking_losses(spark, sf_dir):
    """All losses over slates of a customer's orders, means over slates or pairs."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("i"), (F.floor("o_totalprice") % 100 / 20).alias("p"), (F.col("o_orderkey") % 4).cast("double").alias("t"))))
    slates = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(ordered.alias("x"))  # a customer has few orders
    slates = slates.select(losses.slate(F.transform("x", lambda x: x["p"]), F.transform("x", lambda x: x["t"])).alias("s"))
    parts = {"rmse": losses.rmse(F.col("s")), "list_net": losses.list_net(F.col("s")), "rank_net": losses.rank_net(F.col("s"))} | {f"lambda_{n}": losses.lambda_loss(F.col("s"), n) for n in losses.SCHEMES}
    rows = slates.select(F.explode(F.array(*[F.struct(F.lit(n).alias("loss"), x.alias("x")) for n, x in parts.items()])).alias("r"))
    return rows.groupBy("r.loss").agg(F.round(F.sum("r.x.total") / F.sum("r.x.n"), 6).alias("value"))


@query("""with l as (select l_orderkey, l_linenumber, l_discount * 30 - 1 as a, l_tax * 40 as b, l_quantity as n, l_extendedprice as s, l_returnflag as f from lineitem)
select l_orderkey, l_linenumber, round(1 / (1 + exp(b - a)), 9) as yes, round(1 / (1 + exp(-a)), 9) as sigmoid, round(exp(b) / (exp(a) + exp(b)), 9) as last, round(b - ln(exp(a) + exp(b)), 9) as last_log, round(a - b, 9) + 0.0 as difference,
       round(exp(b) / (exp(a) + exp(b)) * (b - a) + exp(a) / (exp(a) + exp(b)) * (a - b), 9) + 0.0 as divergence,
       round(case f when 'A' then (n * 3 + 2 * n * 10) / 1000000 when 'N' then (s * 3 + s * 10) / 1000000 else 4 * n / 3600 end, 9) as cost from l""")
def model_scores(spark, sf_dir):
    """Scores of two logits a line, how far they are from their exchange, and what a call would cost by tokens, characters or time."""
    a, b, n, s = F.col("l_discount") * 30 - 1, F.col("l_tax") * 40, F.col("l_quantity"), F.col("l_extendedprice")
    logits = [a, b]
    kind = F.when(F.col("l_returnflag") == "A", "tokens").when(F.col("l_returnflag") == "N", "characters").otherwise("hourly")
    scores = {"yes": scoring.yes_probability(a, b), **{k: scoring.relevance(logits, k) for k in ("sigmoid", "last", "last_log", "difference")}, "divergence": scoring.divergence([b, a], logits)}
    scores["cost"] = scoring.call_cost(kind, n, 2 * n, s, s, n, F.lit(3.0), F.lit(10.0), F.lit(4.0))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(x, 9).alias(k) for k, x in scores.items()])


@query("select query_id, doc_id, round(score, 6) as score, rank::int as rank from (select l_orderkey as query_id, l_partkey as doc_id, sum(-l_tax - l_discount) as score, row_number() over (partition by l_orderkey order by round(sum(-l_tax - l_discount), 9) desc, l_partkey) as rank from lineitem group by 1, 2) where rank <= 3")
def question_likelihood_topk(spark, sf_dir):
    """Passages by the summed log probability of a question's tokens: here two tokens a line of an order and part."""
    tokens = F.flatten(F.collect_list(F.array(-F.col("l_tax"), -F.col("l_discount"))))
    rows = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(scoring.question_likelihood(tokens).alias("score"))
    return top_k(rows, "query_id", "doc_id", 3).withColumn("score", F.round("score", 6))


@query(r"select doc_id, 'passage: ' || case when len(w) > 0 then array_to_string(w[1:64], ' ') else 'blank' end as input from (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') as w from documents)")
def embedding_inputs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scoring.embedding_input(F.col("text"), 64, "passage: ").alias("input"))


@query("select o_custkey, count(*) > 0 and sum((o_orderstatus = 'F')::int) > 2 and sum((o_orderstatus = 'F')::int) < count(*) and sum(case when o_orderstatus = 'F' then o_totalprice else 0 end) / sum((o_orderstatus = 'F')::int) * count(*) > 2000000 as late from orders group by o_custkey")
def embedding_out_of_time(spark, sf_dir):
    """Whether a customer's orders, done when filled and with their price as time, would take over a limit at their rate so far."""
    done = F.sum((F.col("o_orderstatus") == "F").cast("int"))
    spent = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(scoring.out_of_time(done, F.count(F.lit(1)), spent, F.lit(2_000_000.0), 2, float("inf")).alias("late"))


@query()
def hash_embeddings(spark, sf_dir):
    """Every turn's text as 384 numbers drawn by its hash; a test holds them against the generator."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scoring.hash_embedding("text").alias("embedding"))
