"""Sources and sinks: Parquet tables, QA records, corpora, passages, ranked lists, TREC runs, layers, appended rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import with_input_place


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The fields of a QA record and of a corpus entry, under all names they go by.
QA_SCHEMA = """id string, _id string, query string, question string, answer_ground_truth string, answer string, text_ground_truth array<string>,
  supporting_facts array<string>, metadata struct<type: string, difficulty: string, supporting_facts: array<string>>"""
CORPUS_SCHEMA = "id string, title string, text string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the entries of a file: the elements of one JSON array, or the lines that aren't blank.

    An array must fit in a task, as it has no places at which a reader could start; lines are split among tasks.
    """
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if first and first[0][0].lstrip().startswith("["):
        return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    return spark.read.text(path).where("trim(value) <> ''")


def parse_records(lines: DataFrame, schema: str = QA_SCHEMA) -> DataFrame:
    """The fields of JSON objects in lines(value, ...), and the other columns of lines; lines that aren't objects are left out."""
    parsed = lines.withColumn("_r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("_r is not null and _r._bad is null").select(*[c for c in lines.columns if c != "value"], "_r.*").drop("_bad")


def read_records(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON lines or one JSON array; records that don't parse are left out."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)


def qa_records(raw: DataFrame, dataset: str) -> DataFrame:
    """(id, question, answer, text_ground_truth, supporting_facts, qtype, difficulty) with either name of each field.

    A missing id is ``dataset_place``; the place is column place where raw has it, else the row's as it is read.
    """
    has = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(None))
    meta = lambda name: F.col(f"metadata.{name}") if "metadata" in raw.columns else F.lit(None)
    if "place" not in raw.columns:
        raw = with_input_place(raw)
    name = F.coalesce(has("id", "_id").cast("string"), F.concat(F.lit(f"{dataset}_"), F.col("place").cast("string")))
    facts = F.coalesce(meta("supporting_facts"), has("supporting_facts")).cast("array<string>")
    return raw.select(
        name.alias("id"), has("query", "question").alias("question"), has("answer_ground_truth", "answer").alias("answer"), has("text_ground_truth").cast("array<string>").alias("text_ground_truth"),
        facts.alias("supporting_facts"), F.coalesce(meta("type").cast("string"), F.lit("multihop")).alias("qtype"), F.coalesce(meta("difficulty").cast("string"), F.lit("unknown")).alias("difficulty"),
    )


def qa_only(raw: DataFrame) -> DataFrame:
    """(question, answers) of records with a question; answers are the first of answers, golden_answers and answer that there is, one value as a list."""
    lists = [F.col(c) for c in ("answers", "golden_answers") if c in raw.columns] + ([F.when(F.col("answer").isNotNull(), F.array("answer"))] if "answer" in raw.columns else [])
    return raw.where("question is not null and question <> ''").select("question", F.coalesce(*lists, F.array().cast("array<string>")).alias("answers"))


def _qa(question, answer, key, context, facts, qtype, difficulty, evidence) -> list[Column]:
    text = lambda x: x.cast("string")
    return [
        text(key).alias("id"), text(question).alias("question"), text(answer).alias("answer"), context.alias("context"), F.array_compact(facts).alias("supporting_facts"), F.coalesce(text(qtype), F.lit("default")).alias("qtype"),
        F.lit(difficulty).alias("difficulty"), evidence.alias("gold_evidence"),
    ]


def evidence_records(raw: DataFrame, key: str) -> DataFrame:
    """(id, question, answer, context, supporting_facts, qtype, difficulty, gold_evidence) of records with the evidence that their answer rests on.

    Reads question, answer, evidence, justification, question_type, html_evidence and the key; context is the map with the evidence under ``evidence``.
    """
    context = F.when(F.col("evidence").isNotNull(), F.create_map(F.lit("evidence"), F.col("evidence").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return raw.select(*_qa(F.col("question"), F.col("answer"), F.col(key), context, F.array(F.col("justification")), F.col("question_type"), "", F.col("html_evidence").cast("string")))


def search_result_records(raw: DataFrame) -> DataFrame:
    """As evidence_records, of records(query, answer, interaction_id, question_type, search_results array<struct<_hash, ...>>): each result as JSON in a map by its hash.

    Results without a hash are left out; of results with one hash the last stays.
    """
    kept = F.filter(F.coalesce("search_results", F.array().cast(raw.schema["search_results"].dataType)), lambda r: r["_hash"].isNotNull())
    last = F.filter(kept, lambda r, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda o: o["_hash"] == r["_hash"]))
    context = F.map_from_entries(F.transform(last, lambda r: F.struct(r["_hash"].cast("string"), F.to_json(r))))
    return raw.select(*_qa(F.col("query"), F.col("answer"), F.col("interaction_id"), context, F.array().cast("array<string>"), F.col("question_type"), "default", F.lit(None).cast("string")))


def plain_records(raw: DataFrame) -> DataFrame:
    """As evidence_records, of records(id, question, answer) without contexts or types."""
    return raw.select(*_qa(F.col("question"), F.col("answer"), F.col("id"), F.create_map().cast("map<string,string>"), F.array().cast("array<string>"), F.lit(None), "default", F.lit(None).cast("string")))


def named_documents(raw: DataFrame, text: str, name: str = "filename") -> DataFrame:
    """(text, metadata) of grounding documents, with the file's name as their metadata."""
    return raw.select(F.col(text).alias("text"), F.create_map(F.lit("file_name"), F.col(name)).alias("metadata"))


def corpus_records(raw: DataFrame) -> DataFrame:
    """(id, title, text) of corpus entries with their place: a missing title is the id, a missing id the title, and ``doc_place`` if both are missing."""
    name = F.coalesce("id", "title", F.concat(F.lit("doc_"), F.col("place").cast("string")))
    return raw.select(name.alias("id"), F.coalesce("title", name).alias("title"), "text")


def corpus_from_map(raw: DataFrame, column: str) -> DataFrame:
    """(id, title, text) of a map from id to text, one entry a row."""
    return raw.select(F.explode(column).alias("id", "text")).select("id", F.col("id").alias("title"), "text")


def with_evidence(qa: DataFrame, corpus: DataFrame) -> DataFrame:
    """QA records with their ground-truth ids replaced by corpus texts, in order; ids that the corpus lacks are dropped."""
    each = qa.select("id", F.posexplode("text_ground_truth").alias("pos", "doc")).join(corpus.select(F.col("id").alias("doc"), "text"), "doc")
    texts = each.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("evidence"))
    return qa.join(texts, "id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, whatever its other columns."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def hydrate(documents: DataFrame, passages: DataFrame, key: str = "question_id") -> DataFrame:
    """documents(key, ctxs array<struct<id, title, text, ...>>) whose contexts have the text and title of the passage with their id; others stay as they are."""
    fields = [f.name for f in documents.schema["ctxs"].dataType.elementType.fields]
    each = documents.select(key, F.posexplode("ctxs").alias("pos", "c"))
    found = each.join(passages.select(F.col("id").alias("_id"), F.col("text").alias("_text"), F.col("title").alias("_title")), F.col("c.id") == F.col("_id"), "left")
    new = {"text": F.when(F.col("_id").isNotNull(), F.col("_text")).otherwise(F.col("c.text")), "title": F.when(F.col("_id").isNotNull(), F.col("_title")).otherwise(F.col("c.title"))}
    whole = F.struct(*[new.get(f, F.col(f"c.{f}")).alias(f) for f in fields])
    lists = found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", whole.alias("c")))), lambda x: x["c"]).alias("ctxs"))
    return documents.drop("ctxs").join(lists, key, "left").withColumn("ctxs", F.coalesce("ctxs", F.array().cast(lists.schema["ctxs"].dataType)))


def first_contexts(documents: DataFrame, n: int) -> DataFrame:
    return documents.withColumn("ctxs", F.slice("ctxs", 1, n))


def context_maps(context: Column) -> Column:
    """A list of (title, sentences) as one map a title, sentences joined by a blank."""
    return F.transform(context, lambda c: F.create_map(c["title"], F.array_join(c["sentences"], " ")))


def in_ranges(rows: DataFrame, place: str, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """rows with ``part``, once for each named range of places that holds them (ranges may overlap)."""
    named = [F.when((F.col(place) >= low) & (F.col(place) < high), F.lit(name)) for name, (low, high) in ranges.items()]
    return rows.withColumn("part", F.explode(F.array_compact(F.array(*named))))


def load_knowledge_base(layer: DataFrame, base_id: str, required: list[str]) -> DataFrame:
    """The one configuration of a knowledge base with the largest average score, ties to the smaller id; an error if columns are missing."""
    if missing := [c for c in required if c not in layer.columns]:
        raise ValueError(f"missing: {', '.join(missing)}")
    order = Window.partitionBy("base_id").orderBy(F.desc("average_score"), "config_id")
    return layer.where(F.col("base_id") == base_id).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').schema("id long, text string, title string").csv(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, question) of a tab-separated file without a header; doubled quotes in a quoted field are one."""
    return spark.read.option("sep", "\t").option("quote", '"').option("escape", '"').schema("id string, question string").csv(path)


def read_beir(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, collection) of a folder; a title that isn't empty stands before its text."""
    options = lambda schema: spark.read.option("sep", "\t").option("quote", '"').option("escape", '"').schema(schema)
    collection = options("id string, text string, title string").csv(f"{path}/collection.tsv")
    whole = F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), "text")
    return options("id string, question string").csv(f"{path}/queries.test.tsv"), collection.select("id", whole.alias("text"))


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid, rank, score) of a run file with six blank-separated columns."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(part[0].alias("qid"), part[2].alias("pid"), part[3].cast("int").alias("rank"), part[4].cast("double").alias("score"))


def write_records(rows: DataFrame, path: str) -> None:
    if not path.endswith((".json", ".jsonl")):
        raise ValueError("only .json and .jsonl")
    rows.write.mode("overwrite").json(path)


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Each layer of an experience memory as a Parquet table, replacing the one before."""
    for name, rows in layers.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_layers(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)
