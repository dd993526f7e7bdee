"""Operator 13: the prefix trie of conversations, by leaf-peeling message passing.

A node is a distinct sequence of a conversation's first turns. Its key is its depth and the sums of its turns' digests, each
salted with the turn's place, so keys of all prefixes are running totals and no prefix is ever built.

The smallest member of a node names it. The nodes of one name are a run down the trie, so the trie is a tree of runs. Every
run holds a counter of child runs that have not reported; a run whose counter is 0 sends its totals to its parent run, round
by round, until only the root's run finishes. Totals of the nodes within a run are then running totals from its end.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import running
from .shared import cut, join_hot, map_batches, partitions, remove, write_out

#: A conversation's first turns come from the one whose id is the next lower multiple of this.
FAMILY = 20
#: More first turns than a conversation can take over.
MAX_HEAD = 3
#: Consecutive turns of a conversation that one task sums up.
SPAN = 4096
#: Consecutive ids whose ends are joined to one string at most.
IDS = 4096
LANES = ("l1", "l2", "l3", "l4")
WORD = r"[^\x20\x09-\x0D]+"


def along(rows: DataFrame, key: str, order: str, columns: list[str], back: bool = False) -> DataFrame:
    """rows with each column replaced by its running total along ``order``, whole numbers from 0; from the end if back.

    A key's rows are summed in spans of SPAN places, to which the totals of the spans before are added.
    """
    way = F.desc if back else F.asc
    spanned = rows.withColumn("_span", F.floor(F.col(order) / SPAN))
    upto = Window.partitionBy(key, "_span").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(way("_span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = spanned.groupBy(key, "_span").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    offsets = whole.select(key, "_span", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    own = spanned.withColumns({c: F.sum(c).over(upto) for c in columns})
    summed = own.join(offsets, [key, "_span"]).withColumns({c: F.col(c) + F.col(f"_{c}") for c in columns})
    return summed.select(*rows.columns)


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, digest, words) of all rebuilt turns from depth 1, (conv_id) of all conversations).

    turns(conv_id, turn, role, text, ...): in the order of turn, null first, then role and text; a null role or text counts as
    empty, rows without a conv_id belong to no conversation. A conversation starts with the first h turns of its family's
    first (fewer if that has fewer, none if it is absent) and goes on with its own turns after its first h.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", blank("role").alias("role"), blank("text").alias("text"))
    rows = running(rows.withColumn("_one", F.lit(1)), "conv_id", ["turn", "role", "text"], {"number": ("count", "_one")})
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    own = cut(rows.select("conv_id", "number", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    convs = convs.withColumns({"h": head_length(F.col("conv_id")), "first": F.col("conv_id") - F.col("conv_id") % FAMILY})
    given = convs.select(F.col("conv_id").alias("first"), F.least("size", F.lit(MAX_HEAD)).alias("given"))
    convs = cut(convs.join(given, "first", "left").select("conv_id", "h", "first", F.least("h", F.coalesce("given", F.lit(0))).alias("taken")))
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("number") <= MAX_HEAD)).withColumnRenamed("conv_id", "first")
    taken = convs.join(heads, "first").where("number <= taken").select("conv_id", F.col("number").alias("depth"), "digest", "words")
    moved = convs.where("h <> taken").select("conv_id", (F.col("h") - F.col("taken")).alias("gap"))  # few: families without enough first turns
    rest = own.where(F.col("number") > head_length(F.col("conv_id"))).join(moved, "conv_id", "left")
    rest = rest.select("conv_id", (F.col("number") - F.coalesce("gap", F.lit(0))).alias("depth"), "digest", "words")
    return taken.unionByName(rest), convs.select("conv_id")


def members(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words, last) of every node of every rebuilt conversation, the root included; node and parent are keys."""
    rebuilt, convs = rebuild(turns)
    lane = lambda i: F.xxhash64(F.lit(i), "depth", "digest").bitwiseAND(F.lit(0x7FFFFFFF))
    dealt = rebuilt.withColumns({c: lane(i) for i, c in enumerate(LANES)}).withColumns({f"own_{c}": F.col(c) for c in LANES})
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(c) for c in (*LANES, *[f"own_{c}" for c in LANES])])
    summed = along(dealt.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "conv_id", "depth", list(LANES))
    ends = rebuilt.groupBy("conv_id").agg(F.max("depth").alias("length"))
    node = F.struct("depth", *LANES)
    parent = F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), *[(F.col(c) - F.col(f"own_{c}")).alias(c) for c in LANES]))
    out = summed.join(ends, "conv_id", "left")
    return out.select("conv_id", "depth", node.alias("node"), parent.alias("parent"), "words", (F.col("depth") == F.coalesce("length", F.lit(0))).alias("last"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): ids are joined in chunks of IDS consecutive ones, and the chunks hashed in their order as they come."""
    chunk = F.floor(F.col("conv_id") / IDS)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy("node", chunk.alias("chunk")).agg(joined.alias("ids"))

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _pairs(out)
        if key is not None:
            yield _pairs([(key, state.hexdigest())])

    dealt = chunks.withColumn("node", F.to_json("node")).repartition(partitions(ends.sparkSession), "node").sortWithinPartitions("node", "chunk")
    return map_batches(dealt.select("node", "ids"), run, "node string, ends_sha256 string").withColumn("node", F.from_json("node", "struct<depth long, l1 long, l2 long, l3 long, l4 long>"))


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["node", "ends_sha256"])


def peel(runs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(run, leaves, saved) with the totals of each run's whole subtree, and the folders that hold them.

    runs(run, parent, leaves, saved, waiting): waiting is the number of child runs. In every round the runs that wait for none
    send their totals to their parents, whose counters go down by as many, and are written; the others go on.
    """
    state, folder = write_out(runs)
    done, kept = [], []
    while state.limit(1).count():
        ready, own = write_out(state.where("waiting = 0"))
        done.append(ready.select("run", "leaves", "saved"))
        kept.append(own)
        sent = ready.where("parent is not null").groupBy(F.col("parent").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        left = state.where("waiting > 0").join(sent, "run", "left")
        none = lambda c: F.coalesce(F.col(c), F.lit(0))
        left = left.select("run", "parent", (F.col("leaves") + none("more")).alias("leaves"), (F.col("saved") + none("more_saved")).alias("saved"), (F.col("waiting") - none("n")).alias("waiting"))
        past, (state, folder) = folder, write_out(left)
        remove(runs.sparkSession, past)
    remove(runs.sparkSession, folder)
    out = done[0] if done else runs.select("run", "leaves", "saved")
    for part in done[1:]:
        out = out.union(part)
    return out, kept


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the rebuilt conversations' trie.

    See rebuild() for nulls and order; repeated rows are repeated turns; a conversation left without turns belongs to the root
    only; texts of any length count whole; other columns are not read; without conversations there are no rows, not even a root.
    """
    spark = turns.sparkSession
    every = cut(members(turns))
    named = every.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"), F.first("words").alias("words"))
    nodes = cut(named.withColumn("own_saved", (F.col("n_convs") - 1) * F.col("words")).drop("words"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    below = join_hot(nodes.where("parent is not null"), parents, "parent", nodes.count()).unionByName(nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    leaf = (F.col("n_children") == 0).cast("long")
    nodes = cut(below.select("node", "conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", leaf.alias("n_leaves"), F.col("own_saved").alias("saved_tokens")))

    tops = nodes.where((F.col("parent_conv_id") != F.col("conv_id")) | F.col("parent_conv_id").isNull())
    tops = tops.select(F.col("conv_id").alias("run"), F.col("parent_conv_id").alias("parent"), (F.col("depth") - 1).alias("at"))
    waiting = tops.where("parent is not null").groupBy(F.col("parent").alias("run")).agg(F.count(F.lit(1)).alias("waiting"))
    own = nodes.groupBy(F.col("conv_id").alias("run")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    runs = own.join(tops, "run").join(waiting, "run", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)))
    totals, folders = peel(runs.select("run", "parent", "leaves", "saved", "waiting"))
    hung = totals.join(tops.where("parent is not null"), "run").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
    grown = nodes.join(hung, ["conv_id", "depth"], "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))}).drop("more", "more_saved")
    summed = along(grown, "conv_id", "depth", ["n_leaves", "saved_tokens"], back=True)
    digests = _end_digests(every.where("last").select("node", "conv_id"))
    out = cut(summed.join(digests, "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
    for folder in folders:
        remove(spark, folder)
    return out
