"""Trial tables: union, cleaning, filters, parameter maps, exceptions, statistics.

A trial is a row with study_name, number, state, values_0 (larger is better), values_1 (smaller is better), datetime_start,
datetime_complete, duration in seconds, params_* columns, flow (JSON of parameters) and user attributes. Columns that a
function doesn't name may be missing or more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NDIGITS = 4
# What counts as true and as false.
TRUE, FALSE = ("true", "1", "t", "y", "yes", "on"), ("false", "0", "f", "n", "no", "off")
LEAST_COST = 1e-6


def concat_studies(studies: dict[str, DataFrame]) -> DataFrame:
    """All studies with their name, columns that one lacks as null; trials of infinite second value are left out."""
    tagged = [df.withColumn("study_name", F.lit(name)) for name, df in sorted(studies.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).where("values_1 is null or abs(values_1) < double('infinity')")


def completed_trials(trials: DataFrame, success_rate: float | None = None, ndigits: int = NDIGITS) -> DataFrame:
    """Completed trials that did not fail, with both values; of each study those whose successes reach the rate of its most."""
    rows = trials.where("state = 'COMPLETE' and values_0 is not null and values_1 is not null")
    if "failed" in trials.columns:
        rows = rows.where("failed = false")
    if success_rate:
        most = rows.groupBy("study_name").agg(F.max("num_success").alias("_most"))  # one row a study
        rows = rows.join(most, "study_name").where(F.col("num_success") / F.col("_most") >= success_rate).drop("_most")
    return rows.withColumns({c: F.round(c, ndigits) for c, kind in rows.dtypes if c.startswith("params_") and kind in ("double", "float")})


def failed_trials(trials: DataFrame) -> DataFrame:
    return trials.where("state = 'FAIL' or failed")


def names_like(rows: DataFrame, name: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows whose name any of the include patterns matches from its start and none of the exclude patterns does."""
    some = lambda patterns: F.col(name).rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")") if patterns else F.lit(False)
    return rows.where(some(include) & ~some(exclude))


def with_flow(trials: DataFrame, params: dict[str, str]) -> DataFrame:
    """trials with a column params_<name> of the given type for each parameter of the flow; where the flow has it, it wins."""
    flow = F.from_json("flow", "map<string,string>")
    value = lambda name, kind: F.element_at(flow, F.lit(name)).try_cast(kind)
    old = lambda c: [F.col(c)] if c in trials.columns else []
    return trials.withColumns({f"params_{name}": F.coalesce(value(name, kind), *old(f"params_{name}")) for name, kind in params.items()})


def recombine(trials: DataFrame, sources: list[str], name: str) -> DataFrame:
    """The first of the source columns that has a value, as one column in their place."""
    have = [c for c in sources if c in trials.columns]
    return trials.withColumn(name, F.coalesce(*[F.col(c) for c in have], F.lit(None))).drop(*[c for c in have if c != name])


def load_study(trials: DataFrame, params: dict[str, str], cost: bool = False) -> DataFrame:
    """A cleaned study: parameters from the flow, no embedding model for sparse retrievers, numbers 1 ... n by completion,
    cumulative compute hours, hours since the study's start, costs in hundredths of cents, one column for the response
    model, missing columns as they count (no exception, no errors), no trial without a rag mode.

    Running sums need one order a study: a study is the unit that is read whole, in one sort.
    """
    rows = with_flow(trials, params).withColumn("values_0", F.col("values_0").cast("double"))
    rows = rows.withColumn("values_1", F.col("values_1").cast("double") * (10_000.0 if cost else 1.0))
    if "params_retriever" in rows.columns and "params_embedding_model" in rows.columns:
        rows = rows.withColumn("params_embedding_model", F.when(F.coalesce(F.col("params_retriever"), F.lit("")) != "sparse", F.col("params_embedding_model")))
    order = Window.partitionBy("study_name").orderBy(F.asc_nulls_last("datetime_complete"), "number")
    start = rows.groupBy("study_name").agg(F.min("datetime_start").alias("_start"))  # one row a study
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = rows.join(F.broadcast(start) if start.count() <= 1_000_000 else start, "study_name")
    rows = rows.withColumn("compute_hours", F.sum("duration").over(upto) / 3600).withColumn("number", F.row_number().over(order))
    rows = rows.withColumn("wallclock_hours", (micros("datetime_complete") - micros("_start")) / 3_600_000_000).drop("_start")
    for c in ("exception_class", "exception_message"):
        rows = rows.withColumn(c, F.col(c) if c in trials.columns else F.lit("None"))
    for c in ("num_errors", "num_total"):
        rows = rows.withColumn(c, F.col(c) if c in trials.columns else F.lit(0))
    rows = recombine(rows, ["params_response_synthesizer_llm", "params_no_rag_response_synthesizer_llm", "params_no_rag_llm_name"], "params_response_synthesizer_llm")
    return rows.where("params_rag_mode is not null")


def usable_trials(trials: DataFrame) -> DataFrame:
    """Trials whose successes are over nine tenths of their study's largest total, and pruned ones; a second value that isn't positive becomes LEAST_COST."""
    most = trials.groupBy("study_name").agg(F.max("num_total").alias("_most"))  # one row a study
    rows = trials.join(most, "study_name").where((F.col("num_success") / F.col("_most") > 0.9) | F.coalesce("is_pruned", F.lit(False))).drop("_most")
    return rows.withColumn("values_1", F.when(F.col("values_1") > 0, F.col("values_1")).otherwise(LEAST_COST))


def objective_names(trials: DataFrame) -> DataFrame:
    """(study_name, objective): the one name of a study's second objective, null where there are several; p80_time is latency."""
    named = F.when(F.col("objective_2_name") == "p80_time", "latency").otherwise(F.col("objective_2_name"))
    return trials.groupBy("study_name").agg(F.when(F.count_distinct(named) == 1, F.max(named)).alias("objective"))


def baselines(trials: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted setting (name and params_* columns) the matching trial of the most successes, null matching null; ties to the smaller number."""
    keys = [c for c in wanted.columns if c.startswith("params_")]
    sent = wanted.select("name", *[F.col(c).alias(f"_{c}") for c in keys])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    best = Window.partitionBy("name").orderBy(F.desc_nulls_last("num_success"), "number")
    return trials.join(sent, on).drop(*[f"_{c}" for c in keys]).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def without_keys(params: Column, keys: list[str]) -> Column:
    return F.map_filter(params, lambda k, v: ~k.isin(keys))


def canonical(params: Column) -> Column:
    """One text for equal maps: entries in the order of their keys."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(params))))


def existing(wanted: DataFrame, trials: DataFrame, params: str = "params") -> DataFrame:
    """The wanted rows whose parameter map a trial has."""
    have = trials.select(canonical(F.col(params)).alias("_key")).distinct()
    return wanted.withColumn("_key", canonical(F.col(params))).join(have, "_key", "left_semi").drop("_key")


def within_range(value: Column, low: float, high: float, step: float | None = None, tolerance: float = 1e-9) -> Column:
    """Whether a value lies in a range and on its steps, up to the tolerance."""
    inside = (value >= low - tolerance) & (value <= high + tolerance)
    if not step:
        return inside
    off = F.pmod(value - low, F.lit(float(step)))
    return inside & ((off <= tolerance) | (step - off <= tolerance))


def text_to_bool(text: Column) -> Column:
    """Whether a text says yes; one that says neither is an error, null stays null."""
    word = F.lower(F.trim(text))
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(word.isin(*TRUE), True).when(word.isin(*FALSE), False).otherwise(F.raise_error(F.concat(F.lit("neither yes nor no: "), text)).cast("boolean"))


def unique_values(trials: DataFrame, column: str, ndigits: int = NDIGITS) -> Column:
    """The distinct values of a column as an aggregate, in order; fractions rounded, null and NaN left out."""
    kind = dict(trials.dtypes)[column]
    value = F.round(F.nanvl(F.col(column), F.lit(None).cast(kind)), ndigits) if kind in ("double", "float") else F.col(column)
    return F.sort_array(F.collect_set(value))


def normalised_params(params: Column, aliases: dict[str, str], defaults: dict[str, str]) -> Column:
    """A map with aliases by their proper names and defaults for what is missing; a given proper name wins over its alias."""
    literal = lambda d: F.map_from_arrays(F.array(*[F.lit(k) for k in d]), F.array(*[F.lit(v) for v in d.values()]))
    proper = F.transform(F.map_entries(params), lambda e: F.struct(F.coalesce(F.try_element_at(literal(aliases), e["key"]), e["key"]).alias("key"), e["value"].alias("value"), e["key"].isin(*aliases).alias("alias")))
    part = lambda alias: F.map_from_entries(F.transform(F.filter(proper, lambda e: e["alias"] == alias), lambda e: F.struct(e["key"], e["value"])))
    keep = lambda old, new: F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    given = F.map_concat(keep(part(True), part(False)), part(False))
    return F.map_concat(keep(literal(defaults), given), given)


def exception_stats(trials: DataFrame) -> DataFrame:
    """(exception_class, exception_message, count): null counts as None; messages are shortened to 1000 characters, then numbers after = are masked."""
    from ..functions.parsing import truncate_label

    message = truncate_label(F.coalesce("exception_message", F.lit("None")), 1000)
    masked = F.regexp_replace(message, r"=\d+\.\d+\b", "=[number]")
    return trials.groupBy(F.coalesce("exception_class", F.lit("None")).alias("exception_class"), masked.alias("exception_message")).agg(F.count(F.lit(1)).alias("count"))


def study_stats(trials: DataFrame, states: list[str]) -> DataFrame:
    """One row a study: trials by state, seeds, error rate per sample, mean of pruned trials, cost, start, age, trials an hour."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = (F.max(micros("datetime_complete")) - F.min(micros("datetime_start"))) / 3_600_000_000
    counts = [F.count_if(F.col("state") == s).alias(f"n_{s.lower()}") for s in states]
    return trials.groupBy("study_name").agg(
        F.count(F.lit(1)).alias("trials"), *counts, F.count_if(F.col("is_seeding")).alias("seeds"), F.try_divide(F.sum("num_errors"), F.sum("num_total")).alias("error_rate"),
        F.avg(F.when(F.col("is_pruned"), F.col("values_0"))).alias("pruned_mean"), F.sum("llm_cost_total").alias("cost"), F.min("datetime_start").alias("started"), hours.alias("hours"),
        F.try_divide(F.count(F.lit(1)), hours).alias("trials_per_hour"),
    )


def exceptions_by_class(trials: DataFrame, classes: list[str]) -> DataFrame:
    """(study_name, one count for each class)."""
    return trials.groupBy("study_name").pivot("exception_class", classes).count().na.fill(0)


def binned(trials: DataFrame, column: str, n: int = 10) -> DataFrame:
    """trials with <column>_binned: ranges ``(low, high]`` of equal width for numbers of over 15 distinct values, else the value; N/A for null.

    The lowest edge is a thousandth of the range under the least value. Whole numbers have whole edges.
    """
    kind = dict(trials.dtypes)[column]
    name, text = f"{column}_binned", F.coalesce(F.col(column).cast("string"), F.lit("N/A"))
    if kind not in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        from ..functions.parsing import truncate_label

        return trials.withColumn(name, truncate_label(text))
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    row = trials.agg(F.min(value), F.max(value), F.count_distinct(value), F.bool_and(value == F.floor(value))).first()
    low, high, distinct, whole = row
    shown = lambda x: F.regexp_replace(F.format_string("%.6g", x), r"^(-?\d+)\.0+$", "$1")
    if low is None or distinct <= 15:
        return trials.withColumn(name, F.when(value.isNull(), "N/A").otherwise(shown(value) if not whole else F.format_string("%d", value.cast("long"))))
    width = (high - low) / n
    edges = [low - (high - low) / 1000] + [low + width * i for i in range(1, n + 1)]
    if whole:
        edges = sorted({round(x) for x in edges[:-1]}) + [round(edges[-1]) + 1]
    out = F.lit("N/A")
    for a, b in reversed(list(zip(edges, edges[1:]))):
        label = f"({int(a)}, {int(b)}]" if whole else f"({a:g}, {b:g}]"
        out = F.when((value > a) & (value <= b), label).otherwise(out)
    return trials.withColumn(name, out)


def quantile_cut(rows: DataFrame, group: str, column: str, names: list[str]) -> DataFrame:
    """rows with ``cut``: the class of the value between its group's quantiles (linear, right-closed), one name a class."""
    n = len(names)
    bounds = rows.groupBy(group).agg(*[F.percentile(column, i / n).alias(f"_q{i}") for i in range(1, n)])  # one row a group
    out = F.lit(names[-1])
    for i in range(n - 1, 0, -1):
        out = F.when(F.col(column) <= F.col(f"_q{i}"), names[i - 1]).otherwise(out)
    return rows.join(bounds, group).withColumn("cut", F.when(F.col(column).isNotNull(), out)).drop(*[f"_q{i}" for i in range(1, n)])
