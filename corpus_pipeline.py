"""Corpus pipeline: documents -> language ID -> near duplicates -> decontamination -> mixing -> sharding.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

The stages keep every column of docs, whatever it is called: rows travel as one struct, so no name clashes with one that
a stage makes. They decide on rows, not on ids: rows whose id is null or occurs again have a key of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenqa.llm import decontamination, language_id, mixing, ngram_jaccard, sharding
from lumenqa.llm.shared import checkpoint_root, cut, join_hot, load, remove

#: A text whose best cosine is lower has no language that was learned.
MIN_LANGUAGE_SCORE = 0.02
SHARDS = 8
#: Keys that are broadcast at most; beyond it, they are joined by a shuffle.
MAX_SENT_KEYS = 1_000_000
COMMON = ("doc_id", "text", "odd", "key")


def _whole(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): the row as a struct."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= MAX_SENT_KEYS else keys


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, row, odd, key) of rows whose id no other has, keyed by it, and of the odd others, keyed by a number."""
    whole = _whole(docs)
    repeated = cut(whole.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")))
    again = _small(repeated)
    plain = whole.where("doc_id is not null").join(again, F.col("doc_id") == F.col("_id"), "left_anti")
    odd = whole.where("doc_id is null").union(whole.join(again, F.col("doc_id") == F.col("_id"), "left_semi"))
    odd = cut(odd.withColumn("key", F.monotonically_increasing_id()))
    return plain.withColumns({"odd": F.lit(False), "key": F.col("doc_id")}), odd.withColumn("odd", F.lit(True)).select(*plain.columns, "odd", "key")


def _without(parts: tuple[DataFrame, DataFrame], gone: DataFrame) -> DataFrame:
    """The rows of both parts whose (odd, key) is not in gone."""
    kept = []
    for odd, rows in zip((False, True), parts):
        keys = gone.where(F.col("odd") == odd).select(F.col("key").alias("_gone")).distinct()
        kept.append(rows.join(_small(keys), F.col("key") == F.col("_gone"), "left_anti").select("row.*"))
    return kept[0].union(kept[1])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows without a letter, null and empty texts included, and those that are like no learned language.

    Learns from rows with a lang that aren't held out; a null doc_id is not held out. If nothing can be learned, nothing is
    rejected. Texts of any length are taken whole; repeated rows are alike; an empty table stays empty.
    """
    rows = docs.select("doc_id", "text", "lang", language_id.held_out(F.col("doc_id")).alias("held_out"))
    model = language_id.train(rows.where("not held_out"))
    if not model.labels:  # nothing to compare with
        return docs
    scored = language_id.predict(_whole(docs).select("text", "row"), model)
    return scored.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that links of 5-word shingles at 0.8 join: that with the smallest doc_id, null last.

    Of rows of a group that share the smallest id, or of which none has one, any one stays. Rows without words, null and
    empty texts included, are in no group and all stay. Texts of any length are taken whole; an empty table stays empty.
    """
    parts = _keyed(docs)
    params = ngram_jaccard.JaccardParams(5, 80, 100)
    rows = parts[0].select(*COMMON).union(parts[1].select(*COMMON))
    groups = cut(ngram_jaccard.ngram_jaccard_join(rows, params, ("odd", "key")).where("component is not null"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "odd", "key")
    first = groups.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    gone = join_hot(groups, cut(first), "component", groups.count()).where(F.col("first").isNotNull() & (place != F.col("first")))
    return _without(parts, cut(gone.select("odd", "key")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item's question and answer.

    Null and empty texts hold nothing and stay; a row goes whatever its id, and others with that id stay; texts of any
    length are searched whole; without items all rows stay; an empty table stays empty.
    """
    parts = _keyed(docs)
    rows = parts[0].select(*COMMON).union(parts[1].select(*COMMON))
    hits = decontamination.decontaminate(rows, load(spark, sf_dir, "benchmark"), carry=("odd", "key"))
    return _without(parts, cut(hits.select("odd", "key").distinct()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats rows until each source has its share of words.

    A null source is a source of its own. Null, empty and very long texts count with the words they have; a row without
    words goes out as often as its draw says. Rows that share an id are drawn alike; an empty table stays empty.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, the text's UTF-8 bytes plus 1 (a null text has none), and the shard; copies of a document share its shard.

    Columns of docs that have these names, in any case, are replaced. A null doc_id counts as 0; an empty table stays empty.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "shard")])
    sized = docs.withColumn("size", (F.octet_length(F.coalesce("text", F.lit("")).cast("binary")) + F.lit(1)).cast("long"))
    return sharding.with_shards(sized, SHARDS)


STAGES = [
    ("language_id", identify_languages),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Language ID and the exact join have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what they write goes to the folder of spark.checkpoint.dir, the last stage's rows stay there."""
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, past = load(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        own = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(own)
        docs = spark.read.parquet(own)
        if past:  # its rows are in the table that was written from it
            remove(spark, past)
        past = own
    return docs
