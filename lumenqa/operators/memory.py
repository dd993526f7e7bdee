"""Logs, configurations and insights: projections with defaults, signatures, links and their digests, rule-based insights, best paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import cut

# What a node of a run holds where its log is silent.
NODE_DEFAULTS = {
    "question": "Unknown question", "ground_truth": "Unknown answer", "predicted_answer": "Unknown prediction", "f1_score": 0.0, "exact_match": False, "retrieval_precision": 0.0, "retrieval_recall": 0.0,
    "context_overlap": 0.0, "answer_relevance": 0.0, "query_decomposition_enabled": False, "decomposition_time": 0.0, "hyde_enabled": False, "hyde_time": 0.0, "embedding_model": "unknown",
    "retrieval_method": "unknown", "retrieval_top_k": 10, "hybrid_bm25_weight": 0.5, "retrieval_time": 0.0, "fusion_enabled": False, "fusion_time": 0.0, "reranker_enabled": False, "reranker_top_k": 5,
    "reranking_time": 0.0, "additional_context_enabled": False, "additional_context_num_nodes": 0, "additional_context_time": 0.0, "final_context": "", "context_assembly_time": 0.0,
    "few_shot_enabled": False, "few_shot_retrieval_time": 0.0, "response_synthesizer_llm": "unknown", "template_name": "unknown", "final_prompt": "", "synthesis_time": 0.0, "execution_time": 0.0,
}
# Insights of configurations by their score.
LEVELS = ((0.7, "high_performance", "High-performing configuration achieving F1="), (0.5, "moderate_performance", "Moderate-performing configuration with F1="), (None, "low_performance", "Low-performing configuration with F1="))
ADVICE = {
    "high_performance": "Maintain current configuration and consider minor parameter tuning for optimization.",
    "moderate_performance": "Consider enhancing retrieval components or adjusting query processing parameters.",
    "low_performance": "Significant configuration changes needed, particularly in retrieval and synthesis components.",
}
ARROW = " → "


def node_projection(logs: DataFrame) -> DataFrame:
    """logs with every field of NODE_DEFAULTS, defaults where it is null or missing; other columns stay."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in logs.columns else F.lit(v) for c, v in NODE_DEFAULTS.items()}
    return logs.withColumns(filled)


def objective(results: Column, target: str) -> Column:
    """The target's value in a map of results; of train_joint_f1 where it is missing, then of joint_f1, else 0."""
    return F.coalesce(F.element_at(results, target), F.element_at(results, "train_joint_f1"), F.element_at(results, "joint_f1"), F.lit(0.0))


def context_documents(nodes: Column, n: int = 10, characters: int = 500) -> Column:
    """array<struct(doc_id, text, score)>: the first n of an array of nodes(text, score), cut to so many characters, a null score as 0."""
    return F.transform(F.slice(nodes, 1, n), lambda x, i: F.struct(i.alias("doc_id"), F.substring(F.coalesce(x["text"], F.lit("")), 1, characters).alias("text"), F.coalesce(x["score"].cast("double"), F.lit(0.0)).alias("score")))


def reranked_nodes(reranked: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """nodes as the reranker ordered them: its score replaces theirs; ids that no node has are dropped."""
    return reranked.select("query_id", key, "rank", F.col("score").alias("_score")).join(nodes, key).withColumn("score", F.col("_score")).drop("_score")


# signatures


def config_signature(retrieval: Column, embedding: Column, template: Column, reranker: Column, hyde: Column) -> Column:
    """``retrieval=... | embedding=... | ...``: the embedding's last part behind a slash, ``unknown`` where it is empty; switches as enabled or disabled."""
    switch = lambda name, x: F.concat(F.lit(f"{name}="), F.when(F.coalesce(x, F.lit(False)), "enabled").otherwise("disabled"))
    said = lambda name, x: F.concat(F.lit(f"{name}="), F.coalesce(x, F.lit("None")))
    short = F.when(F.coalesce(embedding, F.lit("")) == "", "unknown").otherwise(F.substring_index(embedding, "/", -1))
    return F.concat_ws(" | ", said("retrieval", retrieval), said("embedding", short), said("template", template), switch("reranker", reranker), switch("hyde", hyde))


def execution_pattern(c: dict[str, Column]) -> Column:
    """The steps of a run in words, joined by arrows; c holds the run's columns by name."""
    on = lambda name: F.coalesce(c[name], F.lit(False))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    docs = F.coalesce(c["retrieved"], F.lit(0))
    retrieved = text("Retrieved ", docs, " docs via ", c["retrieval_method"])
    retrieved = F.when(c["retrieval_method"] == "hybrid", F.concat(retrieved, text(" (BM25 weight: ", c["hybrid_bm25_weight"], ")"))).otherwise(retrieved)
    steps = [
        F.when(on("query_decomposition_enabled"), text("Decomposed into ", c["sub_queries"], " sub-queries")),
        F.when(on("hyde_enabled"), F.lit("Applied HyDE query transformation")),
        retrieved,
        F.when(on("fusion_enabled"), text("Fused results using ", c["fusion_mode"])),
        F.when(on("reranker_enabled"), text("Reranked to top-", c["reranker_top_k"], " docs")),
        F.when(on("additional_context_enabled"), text("Added ", c["additional_context_num_nodes"], " context nodes")),
        text("Synthesized using ", c["template_name"], " template"),
    ]
    return F.concat_ws(ARROW, *steps)  # which leaves nulls out


def config_summary(c: dict[str, Column]) -> Column:
    """The parts of a configuration in a few words, joined by arrows."""
    on = lambda name: F.coalesce(c[name], F.lit(False))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    known = lambda name, other: F.coalesce(c[name].cast("string"), F.lit(other))
    return F.concat_ws(
        ARROW,
        F.when(on("query_decomposition_enabled"), text("QueryDecomp(", known("query_decomposition_num_queries", "N/A"), ")")),
        F.when(on("hyde_enabled"), F.lit("HyDE")),
        text("Retrieval(", known("retrieval_method", "unknown"), "-", known("retrieval_top_k", "N/A"), ")"),
        F.when(on("reranker_enabled"), text("Rerank(top-", known("reranker_top_k", "N/A"), ")")),
        text("Template(", known("template_name", "unknown"), ")"),
    )


# insights


def fallback_insight(configs: DataFrame, summary: Column) -> DataFrame:
    """configs with insight_type, title, description, recommendation and confidence by rules on avg_f1_score; a null score counts as 0.

    Reads avg_f1_score, avg_retrieval_precision, avg_retrieval_recall and runs. Numbers are written with three digits.
    """
    f1 = F.coalesce("avg_f1_score", F.lit(0.0))
    digits = lambda x: F.format_string("%.3f", F.coalesce(x.cast("double"), F.lit(0.0)))

    def level(value) -> Column:
        out = F.when(f1 > LEVELS[0][0], value(LEVELS[0])).when(f1 > LEVELS[1][0], value(LEVELS[1]))
        return out.otherwise(value(LEVELS[2]))

    kind = level(lambda x: F.lit(x[1]))
    said = F.concat(level(lambda x: F.lit(x[2])), digits(f1), F.lit(" across "), F.coalesce("runs", F.lit(0)).cast("string"), F.lit(" evaluations."))
    advice = level(lambda x: F.lit(ADVICE[x[1]]))
    seen = F.concat(F.lit("- Retrieval precision: "), digits(F.col("avg_retrieval_precision")), F.lit("\n- Retrieval recall: "), digits(F.col("avg_retrieval_recall")))
    parts = [F.concat(F.lit("**Configuration Analysis**: "), summary), F.concat(F.lit("**Performance Summary**: "), said), F.concat(F.lit("**Key Observations**: \n"), seen, F.lit("\n- Component interaction patterns require further analysis")), F.concat(F.lit("**Recommendation**: "), advice)]
    return configs.withColumns({"insight_type": kind, "title": F.concat(F.lit("Configuration Analysis: "), summary), "description": F.concat_ws("\n\n", *parts), "recommendation": advice, "confidence": F.lit(0.7)})


def runs_of_configs(configs: DataFrame, runs: DataFrame, ids: str = "run_ids", key: str = "run_id") -> DataFrame:
    """Each configuration's runs by its list of ids, each id once, in the list's order as ``place``; ids without a run are left out."""
    listed = configs.withColumn("_ids", F.array_distinct(F.coalesce(ids, F.array().cast(dict(configs.dtypes)[ids])))).select("*", F.posexplode("_ids").alias("place", key)).drop("_ids", ids)
    return listed.join(runs, key)


def linked_insights(configs: DataFrame, insights: DataFrame, n: int | None = None) -> DataFrame:
    """(config_id, place, insight columns): insights whose supporting_config_ids name the configuration, in their order, the first n.

    The lists are exploded and joined by id, so no pair is looked at that isn't one.
    """
    named = insights.withColumn("config_id", F.explode(F.array_distinct("supporting_config_ids")))
    met = configs.select("config_id").distinct().join(named, "config_id")
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("config_id").orderBy("discovered", "insight_id")))
    return placed if n is None else placed.where(F.col("place") <= n)


def insight_digest(configs: DataFrame, insights: DataFrame, n: int = 2, characters: int = 300) -> DataFrame:
    """(config_id, digest): the first n linked insights of each configuration as text, descriptions cut to so many characters; without insights no row."""
    short = F.concat(F.substring("description", 1, characters), F.when(F.length("description") > characters, "...").otherwise(""))
    line = F.concat(F.lit("**Insight "), F.col("place").cast("string"), F.lit("**: "), "title", F.lit("\n  Description: "), short, F.lit("\n  Recommendation: "), "recommendation", F.lit("\n  Confidence: "), F.format_string("%.2f", F.col("confidence").cast("double")), F.lit("\n"))
    rows = linked_insights(configs, insights, n).select("config_id", F.struct("place", line.alias("line")).alias("x"))
    return rows.groupBy("config_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("digest"))


# paths and comparisons


def best_path(nodes: DataFrame, depth: int) -> DataFrame:
    """(root, depth, node): from each root, the most visited child of each node on the way, down to a leaf or to the given depth.

    nodes(node, parent, visits), roots with a null parent; ties go to the smaller node. One join a level.
    """
    children = nodes.where("parent is not null").groupBy("parent").agg(F.min_by("node", F.struct((-F.col("visits")).alias("v"), "node")).alias("child"))
    children = cut(children)
    at = nodes.where("parent is null").select(F.col("node").alias("root"), F.lit(0).alias("depth"), "node")
    out = at
    for level in range(1, depth + 1):
        at = cut(at.join(children, F.col("node") == F.col("parent")).select("root", F.lit(level).alias("depth"), F.col("child").alias("node")))
        if at.isEmpty():
            break
        out = out.union(at)
    return out


def comparisons(studies: DataFrame, table: DataFrame) -> DataFrame:
    """(study, title, accuracy): entries of table(name, title, accuracy) whose name a study's name holds; studies with ``synthetic_`` in it have none.

    The table is a list that someone has written, so it is sent to every task.
    """
    named = studies.select("study").distinct().where(~F.contains("study", F.lit("synthetic_")))
    return named.join(F.broadcast(table), F.contains("study", "name")).select("study", "title", "accuracy")


# parameters


def mergeable(trials: DataFrame, params: list[str], n: int = 10, strict: bool = False) -> tuple[DataFrame, list[str]]:
    """(trials with these parameters as text, those of more than one value).

    A boolean is ``True`` or ``False``, null as ``False``; a text stays, null as ``N/A``; a number with up to n distinct values, or any if strict, is
    written in its shortest form; others get the bounds of one of n right-closed bins of equal width over their range, of which the first is
    a thousandth of the range wider below. Null numbers are ``N/A``.
    """
    kinds = {f.name: f.dataType.typeName() for f in trials.schema.fields}
    number = lambda c: kinds[c] in ("byte", "short", "integer", "long", "float", "double", "decimal")
    numeric = [c for c in params if number(c)]
    asked = [x for c in numeric for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count_distinct(F.col(c)).alias(f"n_{c}"), F.bool_and(F.col(c) == F.floor(c)).alias(f"w_{c}"))]
    stats = trials.agg(*asked).first() if asked else None
    columns = {}
    for c in params:
        if not number(c):
            columns[c] = F.when(F.coalesce(F.col(c), F.lit(False)), "True").otherwise("False") if kinds[c] == "boolean" else F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
        elif strict or stats[f"n_{c}"] <= n:
            columns[c] = F.coalesce(shortest(F.col(c).cast("double")), F.lit("N/A"))
        else:
            columns[c] = _bin(F.col(c).cast("double"), float(stats[f"lo_{c}"]), float(stats[f"hi_{c}"]), n, stats[f"w_{c}"])
    out = trials.withColumns(columns)
    counts = out.agg(*[F.count_distinct(F.col(c)).alias(c) for c in params]).first()
    return out, [c for c in params if counts[c] > 1]


def shortest(x: Column) -> Column:
    """A number with up to six significant digits and no trailing zeros, as ``%g`` writes those from 0.0001 to under 1,000,000."""
    places = F.when(x == 0, 0).otherwise(F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(x)))).cast("int"))
    text = F.when(places == 0, F.format_string("%.0f", x))
    for i in range(1, 11):
        text = text.when(places == i, F.format_string(f"%.{i}f", x))
    return F.when(x.isNotNull(), F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text))


def _bin(x: Column, low: float, high: float, n: int, whole: bool) -> Column:
    edges = [low + (high - low) * i / n for i in range(n + 1)]
    edges[0] -= (high - low) * 0.001
    shown = [F.lit(str(int(e))) if whole else shortest(F.lit(e)) for e in edges]
    out = F.when(x.isNull(), "N/A")
    for i in range(n):
        out = out.when(x <= edges[i + 1] if i + 1 < n else F.lit(True), F.concat(F.lit("("), shown[i], F.lit(", "), shown[i + 1], F.lit("]")))
    return out


# Published accuracies of other systems by data set.
PUBLISHED = (("financebench", "Amazon Q", 0.592), ("financebench", "Azure Assistant (GPT-4o-Mini)", 0.551), ("financebench", "Azure Assistant (GPT-4o)", 0.653), ("crag-sports", "Amazon Q", 0.63), ("crag-music", "Amazon Q", 0.735))


def selection_spread(points: DataFrame, chosen: DataFrame, other: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row (spread_x, spread_y, ratio, distance, other_distance): how widely chosen points lie, of points(key, x, y) and two lists of keys.

    spread: standard deviation of the chosen over that of all, by axis; ratio: their mean; distances: the mean over all pairs of the chosen, and of
    the other list. Both lists are selections, so their pairs are few.
    """
    mine, others = cut(points.join(chosen.select(key).distinct(), key)), cut(points.join(other.select(key).distinct(), key))
    whole = points.agg(*[F.stddev_pop(c).alias(f"all_{c}") for c in "xy"])

    def mean_distance(rows: DataFrame, name: str) -> DataFrame:
        b = rows.select(F.col(key).alias("_k"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        return rows.join(b, F.col(key) < F.col("_k")).agg(F.avg(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))).alias(name))

    one = mine.agg(*[F.stddev_pop(c).alias(f"own_{c}") for c in "xy"]).crossJoin(F.broadcast(whole))  # single rows
    one = one.select(*[F.try_divide(f"own_{c}", f"all_{c}").alias(f"spread_{c}") for c in "xy"]).withColumn("ratio", (F.col("spread_x") + F.col("spread_y")) / 2)
    return one.crossJoin(F.broadcast(mean_distance(mine, "distance"))).crossJoin(F.broadcast(mean_distance(others, "other_distance")))
