"""Queries on tuning trials: filters, curves, fronts, correlation, bins, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation
from ..operators import trials as T
from ..operators.order import rolling, running, tiles
from ..sources.tables import table
from .base import query, sql

_TRIALS = "(select o_orderpriority as study, o_orderkey as number, o_totalprice as v0, cast(o_custkey % 500 as double) as v1 from {orders})"
_PARTS = "(select p_brand as study, p_partkey as number, p_retailprice as v0, cast(p_size as double) as v1 from {part})"
_DUCK = {"t": _TRIALS.replace("{orders}", "orders"), "p": _PARTS.replace("{part}", "part")}
_FRONT = "(select * from t x where not exists (select 1 from t y where y.study = x.study and ((y.v0 >= x.v0 and y.v1 < x.v1) or (y.v0 > x.v0 and y.v1 = x.v1) or (y.v0 = x.v0 and y.v1 = x.v1 and y.number < x.number))))"


def order_trials(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("study"), F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("v0"), (F.col("o_custkey") % 500).cast("double").alias("v1"))


def part_trials(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("study"), F.col("p_partkey").alias("number"), F.col("p_retailprice").alias("v0"), F.col("p_size").cast("double").alias("v1"))


@query(f"select study, number, ntile(4) over (partition by study order by v0, number)::int as quarter from {_DUCK['t']}")
def group_quarters(spark, sf_dir):
    return tiles(order_trials(spark, sf_dir).select("study", "number", "v0"), "study", ["v0", "number"], 4, "quarter").select("study", "number", "quarter")



@query("""
select event_type as study, event_id, row_number() over w as number, round(sum(value) over w, 4) as total, max(value) over w as best, min(value) over w as least
from events window w as (partition by event_type order by ts, event_id rows between unbounded preceding and current row)""")
def trial_curves(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("study"), "ts", "event_id", "value")
    curves = running(rows, "study", ["ts", "event_id"], {"number": ("count", "event_id"), "total": ("sum", "value"), "best": ("max", "value"), "least": ("min", "value")})
    return curves.select("study", "event_id", "number", F.round("total", 4).alias("total"), "best", "least")


@query("select event_id, ((epoch_us(ts) - min(epoch_us(ts)) over (partition by event_type)) // 1000000)::bigint as seconds from events")
def wall_clock(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    start = rows.groupBy("event_type").agg(F.min("at").alias("began"))  # one row a study
    return rows.join(start, "event_type").select("event_id", F.floor((F.col("at") - F.col("began")) / 1_000_000).cast("long").alias("seconds"))


@query("""
select event_type as study, number, round(mean, 6) as mean, n from (
  select event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as number,
         avg(value) over (partition by event_type order by ts, event_id rows between 99 preceding and current row) as mean,
         count(value) over (partition by event_type order by ts, event_id rows between 99 preceding and current row) as n
  from events) r where number > 0 and number % 10 = 0""")
def rolling_window_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("study"), "ts", "event_id", "value")
    means = rolling(rows, "study", ["ts", "event_id"], "value", 100).where("number > 0 and number % 10 = 0")
    return means.select("study", "number", F.round("mean", 6).alias("mean"), "n")


@query(f"select study, number, round(v0 / max(v0) over (partition by study), 9) as share from {_DUCK['t']}")
def fraction_of_best(spark, sf_dir):
    rows = order_trials(spark, sf_dir)
    best = rows.groupBy("study").agg(F.max("v0").alias("best"))  # one row a study
    return rows.join(best, "study").select("study", "number", F.round(F.col("v0") / F.col("best"), 9).alias("share"))


@query("""with o as (select p_partkey as id, p_retailprice as y, p_size as x from part), j as (select sign(a.x - b.x) as dx, sign(a.y - b.y) as dy from o a join o b on a.id < b.id)
select 'p_size' as param, round(sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))), 9) as tau from j""")
def param_correlation(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lit("p_size").alias("g"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return correlation.tau_b(rows).select(F.col("g").alias("param"), F.round("tau", 9).alias("tau"))


@query(f"with t as {_DUCK['t']} select study, number, v0, v1 from {_FRONT}")
def pareto_front(spark, sf_dir):
    return T.pareto_front(order_trials(spark, sf_dir))


@query(f"with t as {_DUCK['p']}, f as {_FRONT} select study, number, v0, v1, row_number() over (partition by study order by v1) as place, lead(v1) over (partition by study order by v1) as next_v1 from f")
def pareto_ordered_table(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("study").orderBy("v1")
    return T.pareto_front(part_trials(spark, sf_dir)).withColumns({"place": F.row_number().over(order).cast("long"), "next_v1": F.lead("v1").over(order)})


@query(f"""with t as {_DUCK['t']}, f as {_FRONT},
l as (select study, quantile_cont(v0, 0.1) as y0, max(v0) as y1, min(v1) as x0, quantile_cont(v1, 0.9) as x1 from t group by study),
c as (select f.study, v1, greatest(x0, least(x1, v1)) as x, greatest(y0, least(y1, v0)) as y, y0, y1, x0, x1 from f join l using (study)),
s as (select *, coalesce(lead(x) over (partition by study order by v1), x1) - x as w from c)
select study, round(sum(w * (y - y0)) / any_value((x1 - x0) * (y1 - y0)), 9) as area from s group by study""")
def pareto_area(spark, sf_dir):
    return T.pareto_area(order_trials(spark, sf_dir)).withColumn("area", F.round("area", 9))


@query(f"""with t as {_DUCK['p']}, f as {_FRONT},
k as (select *, round(coalesce((v0 - min(v0) over w) / nullif(max(v0) over w - min(v0) over w, 0), 0) - coalesce((v1 - min(v1) over w) / nullif(max(v1) over w - min(v1) over w, 0), 0), 9) as rise from f window w as (partition by study))
select study, number, v0, v1, rise from k qualify row_number() over (partition by study order by rise desc, v1, number) = 1""")
def knee_point(spark, sf_dir):
    return T.knee(part_trials(spark, sf_dir))


@query(f"""with t as {_DUCK['p']}, f as {_FRONT}, s as (select greatest(stddev_pop(v0), 1e-9) as s0, greatest(stddev_pop(ln(v1 + 1)), 1e-9) as s1 from t)
select t.number, round(min(sqrt(power((ln(t.v1 + 1) - ln(f.v1 + 1)) / s1, 2) + power((t.v0 - f.v0) / s0, 2))), 6) as distance from t join f on t.study = f.study cross join s group by t.number""")
def distance_to_front(spark, sf_dir):
    """Each study's front is small beside its trials and joins them by study."""
    trials = part_trials(spark, sf_dir)
    front = T.pareto_front(trials).select("study", F.col("v0").alias("f0"), F.col("v1").alias("f1"))
    scale = trials.agg(F.greatest(F.stddev_pop("v0"), F.lit(1e-9)).alias("s0"), F.greatest(F.stddev_pop(F.log(F.col("v1") + 1)), F.lit(1e-9)).alias("s1"))
    apart = F.sqrt(F.pow((F.log(F.col("v1") + 1) - F.log(F.col("f1") + 1)) / F.col("s1"), 2) + F.pow((F.col("v0") - F.col("f0")) / F.col("s0"), 2))
    return trials.join(front, "study").crossJoin(F.broadcast(scale)).groupBy("number").agg(F.round(F.min(apart), 6).alias("distance"))


@query(f"""with t as {_DUCK['p']}, j as (select a.study, sign(a.v0 - b.v0) as x, sign(a.v1 - b.v1) as y from t a join t b on a.study = b.study and a.number < b.number)
select study, round(sum(x * y) / sqrt(sum(abs(x)) * sum(abs(y))), 9) as tau, count(*)::bigint as n from j group by study""")
def study_similarity_kendall(spark, sf_dir):
    return T.kendall(part_trials(spark, sf_dir), "study", "v0", "v1").withColumn("tau", F.round("tau", 9))


sql("study_medians", """
with m as (select l_returnflag as study, l_linestatus as status, l_linenumber as line, median(l_quantity) as q from {lineitem} group by l_returnflag, l_linestatus, l_linenumber)
select a.study as study_a, b.study as study_b, a.status, a.line, a.q as q_a, b.q as q_b from m a join m b on a.status = b.status and a.line = b.line and a.study < b.study""")
@query(f"select study, number, round((rank() over (partition by study order by v1) + (count(*) over (partition by study, v1) - 1)::double / 2) / count(*) over (partition by study), 9) as pct from {_PARTS.replace('{part}', 'part')}")
def percentile_rank(spark, sf_dir):
    return T.average_rank_share(part_trials(spark, sf_dir), "study", "v1").select("study", "number", F.round("pct", 9).alias("pct"))


@query("""with e as (select min(p_size) as lo, max(p_size) as hi from part), b as (select p.*, greatest(1, ceil((p_size - lo) / ((hi - lo) / 10.0)))::int as bin from part p, e)
select bin, count(*)::bigint as n, min(p_retailprice) as least, max(p_retailprice) as most, round(avg(p_retailprice), 6) as mean from b group by bin""")
def param_bin_stats(spark, sf_dir):
    rows = T.bins(table(spark, sf_dir, "part"), "p_size")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"), F.round(F.avg("p_retailprice"), 6).alias("mean"))


sql("param_pair_stats", "select p_brand, p_size, count(*) as n, min(p_retailprice) as least, max(p_retailprice) as most, round(avg(p_retailprice), 6) as mean from {part} group by p_brand, p_size")
sql("metric_variability", "select p_brand, p_size, count(*) as n, round(stddev_samp(p_retailprice), 6) as deviation from {part} group by p_brand, p_size having count(*) > 1")
sql("slowest_components", """
with m as (select 'quantity' as component, l_quantity as seconds, l_returnflag as study from {lineitem} union all select 'discount', l_discount, l_returnflag from {lineitem} union all select 'tax', l_tax, l_returnflag from {lineitem})
select study, component, round(max(log10(seconds + 1)), 6) as most, round(avg(log10(seconds + 1)), 6) as mean from m group by study, component""")
sql("pareto_appearance_rate", f"""
with t as {_PARTS}, b as (select study, v1, max(v0) as v0 from t group by study, v1),
     r as (select *, max(v0) over (partition by study order by v1 rows between unbounded preceding and 1 preceding) as before from b),
     f as (select study, case when v1 <= 10 then 'small' when v1 <= 30 then 'medium' else 'large' end as size from r where before is null or v0 > before)
select study, sum(case when size = 'small' then 1 else 0 end) as small, sum(case when size = 'medium' then 1 else 0 end) as medium, sum(case when size = 'large' then 1 else 0 end) as large, round(count(*) / cast((select count(*) from f) as double), 9) as share
from f group by study""", f"""
with t as {_DUCK['p']}, b as (select study, v1, max(v0) as v0 from t group by study, v1),
     r as (select *, max(v0) over (partition by study order by v1 rows between unbounded preceding and 1 preceding) as before from b),
     f as (select study, case when v1 <= 10 then 'small' when v1 <= 30 then 'medium' else 'large' end as size from r where before is null or v0 > before)
select study, sum(case when size = 'small' then 1 else 0 end)::bigint as small, sum(case when size = 'medium' then 1 else 0 end)::bigint as medium, sum(case when size = 'large' then 1 else 0 end)::bigint as large, round(count(*) / cast((select count(*) from f) as double), 9) as share
from f group by study""")
sql("benchmark_table", f"""
with t as {_TRIALS}, b as (select study, min(v1) as base_cost, max(v0) as base_best from t where number % 50 = 0 group by study),
     r as (select t.study, max(t.v0) as best, max(case when t.v1 <= 1.01 * b.base_cost then t.v0 end) as at_cost, min(case when t.v0 >= 0.99 * b.base_best then t.v1 end) as cheapest from t join b on t.study = b.study group by t.study)
select study, best, at_cost, cheapest from r
union all select 'average', round(case when count(*) = count(best) then avg(best) end, 6), round(case when count(*) = count(at_cost) then avg(at_cost) end, 6), round(case when count(*) = count(cheapest) then avg(cheapest) end, 6) from r""")
sql("subspace_bounds", "select p_brand, min(p_size) as least_size, max(p_size) as most_size, count(distinct p_type) as types, min(p_retailprice) as least_price, max(p_retailprice) as most_price from {part} group by p_brand")
sql("space_cardinality", "with d as (select count(distinct p_brand) as a, count(distinct p_type) as b, count(distinct p_size) as c from {part}) select a * b * c as combined, a + b + c as total from d")
_TREE = """(select event_type || '/' || user_id % 10 as node, event_type as parent, count(*) as visits, sum(value) as value_sum from {events} group by 1, 2
  union all select event_type || '/new', event_type, 0, 0.0 from {events} group by event_type union all select event_type, null, count(*), sum(value) from {events} group by event_type)"""


@query(f"with n as {_TREE.replace('{events}', 'events')} select n.node, case when n.visits = 0 then 'infinity'::double when p.visits is null then round(n.value_sum / n.visits, 6) else round(n.value_sum / n.visits + 1.414 * sqrt(ln(p.visits::double) / n.visits), 6) end as ucb from n left join n p on p.node = n.parent")
def ucb_scores(spark, sf_dir):
    nodes = spark.sql(f"select * from {_TREE}", events=table(spark, sf_dir, "events"))
    return T.ucb(nodes).select("node", F.when(F.col("visits") == 0, F.col("ucb")).otherwise(F.round("ucb", 6)).alias("ucb"))


sql("best_path", """
with n as (select event_type, user_id % 10 as bucket, count(*) as visits from {events} group by event_type, user_id % 10),
     r as (select *, row_number() over (partition by event_type order by visits desc, bucket) as place from n)
select event_type, bucket, visits from r where place = 1""")
sql("duration_percentiles", "select event_type, round(percentile(value, 0.5), 6) as p50, round(percentile(value, 0.8), 6) as p80 from {events} group by event_type", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.8), 6) as p80 from events group by event_type")
