"""Operator 5: shards by jump consistent hashing (Lamping and Veach, 2014): no ring table, and with one more shard only
the rows that go into it move."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, partitions

#: Rows of a shard that one task numbers.
SLOT_ROWS = 100_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each 64-bit key."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard, following = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = following[live]
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            following[live] = ((shard[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[following[live] < shards]
    return shard


@F.pandas_udf(T.IntegerType())
def _jump(keys: pd.Series, shards: pd.Series) -> pd.Series:
    if not len(keys):
        return pd.Series([], dtype="int32")
    return pd.Series(jump_hash(keys.to_numpy(), int(shards.iloc[0])).astype("int32"))


def with_shards(docs: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs with the shard of every row, from its key (a whole number) and the number of shards alone.

    A null key counts as key 0; rows that share a key share its shard; a column of that name is replaced; an empty table
    stays empty.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    return docs.withColumn(name, _jump(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(shards)))


def number_rows(rows: DataFrame, group: str, order: list[str], name: str = "slot") -> DataFrame:
    """rows with their number in their group, gapless from 0, without bringing a group into one task.

    A group's rows are dealt into buckets by their hash, numbered there, and moved up by the sizes of earlier buckets.
    Rows that agree in ``order`` get their numbers in any order; otherwise reruns agree.
    """
    total = rows.count()
    buckets = max(1, -(-total // SLOT_ROWS))
    salted = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(_window(group).orderBy("_bucket")) - F.col("_n")
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), before.alias("_before"))
    own = F.row_number().over(_window(group, "_bucket").orderBy(*order)) - 1
    joined = salted.withColumn("_own", own).join(offsets, (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(name, F.col("_own") + F.col("_before")).drop("_bucket", "_own", "_g", "_b", "_before")


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs(doc_id, text, ...).

    size: UTF-8 bytes of the text plus 1, a null text has none (and the checksum of the empty text). The law is ``key``: rows with one doc_id are in
    one shard, a null doc_id counts as 0 and stays null; grown_shard is the shard if there were one more. Rows that agree in all
    three have slots in any order; texts of any length are taken whole; an empty table gives no rows. Other columns are not read.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = cut(with_shards(with_shards(rows, shards), shards + 1, name="grown_shard"))
    out = number_rows(rows, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int | None = None) -> None:
    """Write docs as Parquet, one folder a shard; each shard's rows are spread over tasks by their key.

    Null, empty and very long texts are written as they are, repeated rows as often as they occur, a null doc_id as key 0;
    a column ``shard`` is replaced; an empty table writes no row.
    """
    spread = with_shards(docs, shards)
    spread = spread.repartition(files or partitions(docs.sparkSession), "shard", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    spread.write.partitionBy("shard").parquet(path)
