"""Operator 10: exact Jaccard join on word shingles with token-combination prefixes.

Every text becomes the set of its distinct shingles (see ``words``). Texts with one and the same set are one *node*. All
tokens stand in one global order, rare ones first, and a node's prefix is its first ``n - ceil(t*n) + K`` tokens, so two
nodes that link share at least K = 2 prefix tokens. The index then holds

* single tokens for the rare class,
* combinations of K tokens for the frequent class (tokens that many unconnected components have in their prefixes),

and what it finds is verified on the whole sets. Only components are wanted, so before the index is searched each list's
smallest node is tried against the others (a star), then some others by hash; a large group of near copies becomes one
component by that. The index then yields pairs between components only, without those that a parity bitmap of 512 bits
rules out, and in portions by the pair's hash: a small portion's links join components before the next portion is made,
so that few pairs of a group are ever made though every pair is in one portion.

Hashes have 64 bits and a node is its set's hash alone; at a billion distinct texts the expected number of confusions is
about 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import FOREST_EDGES, components
from .shared import cut, join_hot, map_batches, partitions, release
from .words import mix, shingle_sets

K = 2
#: Tokens of fewer texts are the rarest class; the order of the others is by the power of two of their count.
BASE_COUNT = 4
#: Entries of the broadcast count table; the least count that has an entry rises until they fit.
MAX_COUNTED = 500_000
#: Tokens of a task that are counted at once.
FLUSH = 1_000_000
#: Postings, or tokens of sets, that a task hands over at once.
SENT_ROWS = 100_000
#: Tokens whose lists span more components are indexed one by one still, but with each node's other tokens beside them.
SMALL_COMPONENTS = 8
#: Tokens whose lists span more components are frequent: they are indexed in combinations.
FREQUENT_COMPONENTS = 1024
#: Leaders with which a turn tries the nodes of each longer list, so that a large group is one component before pairs are made.
LEADERS = 4
#: Another turn follows while at least this share of a turn's pairs link.
STAR_YIELD = 0.1
MAX_STAR_TURNS = 8
#: Pairs of the index are made in portions, of which the first is about as many pairs at most, and each PORTION_GROWTH times the one before.
PORTION_PAIRS = 2_000_000
PORTION_GROWTH = 16
PORTION_PARTS = 1 << 20
#: 64-bit words of a node's parity bitmap.
BIT_WORDS = 8
BITS = [f"bits{i}" for i in range(BIT_WORDS)]
#: Nodes whose rows are found by a broadcast of their hashes; beyond it, by a join.
MAX_SENT_NODES = 2_000_000


@dataclass(frozen=True)
class JaccardParams:
    """Two texts link when ``den * intersection >= num * union``."""

    width: int = 5
    num: int = 80
    den: int = 100

    def __post_init__(self) -> None:
        if not self.den < 2 * self.num <= 2 * self.den or self.width < 1:
            raise ValueError("the similarity must be over 0.5 and at most 1, the width at least 1")

    def least(self, n):
        """The least overlap of a set of n with any partner."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return min(n, n - self.least(n) + K)


def _node(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set of tokens."""
    with np.errstate(over="ignore"):
        total = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(mix(np.array([total + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """For each of the bit places, whether an odd number of tokens fall on it; packed into 64-bit words."""
    odd = np.bincount((tokens % np.uint64(64 * BIT_WORDS)).astype(np.int64), minlength=64 * BIT_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def members(docs: DataFrame, p: JaccardParams, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, node, bits0 ..., and the columns to carry) of every row; n is 0 and node null without words, so for null and empty texts.

    Repeated rows and equal texts have one node; a null doc_id stays null; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            bits = np.zeros((BIT_WORDS, batch.num_rows), np.int64)
            for row, tokens in shingle_sets(batch.column(1), p.width):
                n[row] = len(tokens)
                if len(tokens):
                    node[row] = _node(tokens)
                    bits[:, row] = _bitmap(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node, mask=n == 0), *map(pa.array, bits), *batch.columns[2:]], names)

    rows = docs.select(F.col("doc_id").cast("long"), "text", *carry)
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "n", "node", *BITS)), *rows.schema.fields[2:]])
    names = schema.names
    return map_batches(rows, run, schema)


def token_counts(docs: DataFrame, p: JaccardParams, total: int) -> DataFrame:
    """(token, count): exact counts, over all texts, of tokens that over BASE_COUNT texts hold.

    A token is here the upper 32 bits of its hash. Tasks send sorted distinct tokens in one binary value for each of
    many token ranges, so that a hot token costs one entry a task.
    """
    ranges = max(16, 1 << (total // 1_000_000).bit_length())
    shift = 32 - (ranges.bit_length() - 1)

    def flush(held: list[np.ndarray]):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(tokens, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(shift))
        rows = [(i, tokens[a:b], counts[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1][r[2] == 1].tobytes() for r in rows], pa.binary()),
                pa.array([r[1][r[2] > 1].tobytes() for r in rows], pa.binary()),
                pa.array([r[2][r[2] > 1].astype(np.int64).tobytes() for r in rows], pa.binary()),
            ],
            ["part", "once", "more", "times"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, tokens in shingle_sets(batch.column(0), p.width):
                held.append((tokens >> np.uint64(32)).astype(np.uint32))
                size += len(tokens)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def merge(rows: pa.Table) -> pa.Table:
        column = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in rows[name]]
        once, more = column("once", np.uint32), column("more", np.uint32)
        tokens = np.concatenate(once + more)
        weights = np.concatenate([np.ones(sum(map(len, once)), np.int64)] + column("times", np.int64))
        order = np.argsort(tokens, kind="stable")
        tokens, weights = tokens[order], weights[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        sums = np.add.reduceat(weights, first)
        keep = sums > BASE_COUNT
        return pa.table({"token": tokens[first][keep].astype(np.int64), "count": sums[keep]})

    sent = map_batches(docs.select("text"), run, "part int, once binary, more binary, times binary")
    return sent.groupBy("part").applyInArrow(merge, "token long, count long")


def order_table(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and their classes, at most MAX_COUNTED: a bounded table whatever the corpus."""
    sizes = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).count().collect()
    least, left = 0, MAX_COUNTED
    for power, n in sorted(map(tuple, sizes), reverse=True):
        if n > left:
            least = 1 << (power + 1)
            break
        left -= n
    table = counts.where(F.col("count") >= least).toArrow()
    tokens, count = table["token"].to_numpy(), table["count"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order].astype(np.uint64), (1 + np.log2(np.maximum(count[order], 1))).astype(np.uint64)


def postings(docs: DataFrame, p: JaccardParams, table: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, node, n, pos): the prefix of every text, in the global order.

    The order is by class, then by hash: rare tokens come first, then the counted ones by the power of two of their count.
    """
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def packed(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["token", "node", "n", "pos"])

    def run(batches):
        known, classes = sent.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            seen: set[int] = set()
            size = 0
            for _, tokens in shingle_sets(batch.column(0), p.width):
                n = len(tokens)
                if not n or (node := _node(tokens)) in seen:
                    continue
                seen.add(node)
                rank = np.zeros(n, np.uint64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens >> np.uint64(32)), len(known) - 1)
                    hit = known[at] == tokens >> np.uint64(32)
                    rank[hit] = classes[at[hit]]
                first = p.prefix(n)
                order = np.lexsort((tokens, rank))[:first] if rank.any() else np.arange(first)
                out[0].append(tokens[order].view(np.int64))
                out[1].append(np.full(first, node, np.int64))
                out[2].append(np.full(first, n, np.int64))
                out[3].append(np.arange(first, dtype=np.int64))
                size += first
                if size >= SENT_ROWS:
                    yield packed(out)
                    out, size = [[], [], [], []], 0
            if size:
                yield packed(out)

    return map_batches(docs.select("text"), run, "token long, node long, n long, pos long")


def shared_postings(rows: DataFrame) -> DataFrame:
    """Postings of tokens that at least two nodes have, each with its list's smallest node (leader).

    Runs over sorted partitions and holds one row of state, so a list of any length fits.
    """

    def run(batches):
        last = None  # (token, node, n, pos) of the leader, and of the row before; whether the leader's row is out
        for batch in batches:
            token, node, n, pos = (batch.column(i).to_numpy() for i in range(4))
            if not len(token):
                continue
            new = np.concatenate(([last is None or token[0] != last[0][0]], token[1:] != token[:-1]))
            again = np.concatenate(([False], (node[1:] == node[:-1]))) & ~new
            if not new[0]:
                again[0] = node[0] == last[1]
            at = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            lead_node, lead_n, lead_pos = (np.where(at >= 0, x[np.maximum(at, 0)], last[0][i] if last else 0) for i, x in ((1, node), (2, n), (3, pos)))
            keep = np.flatnonzero(~new & ~again)
            runs, firsts = np.unique(at[keep], return_index=True)
            heads = runs >= 0
            extra = runs[heads]
            cols = [token[keep], node[keep], n[keep], pos[keep], lead_node[keep], lead_n[keep], lead_pos[keep]]
            head = [token[extra], node[extra], n[extra], pos[extra], node[extra], n[extra], pos[extra]]
            if not new[0] and not last[2] and len(runs) and runs[0] < 0:
                head = [np.concatenate((x, np.array([last[0][i]], np.int64))) for x, i in zip(head, (0, 1, 2, 3, 1, 2, 3))]
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(cols, head)], ["token", "node", "n", "pos", "lead", "lead_n", "lead_pos"])
            tail = at[-1]
            told = bool((at[keep] == tail).any())
            leader = (token[tail], node[tail], n[tail], pos[tail]) if tail >= 0 else last[0]
            last = (leader, node[-1], told or (tail < 0 and last[2]))

    dealt = rows.repartition(partitions(rows.sparkSession), "token").sortWithinPartitions("token", "n", "node", "pos")
    return map_batches(dealt, run, "token long, node long, n long, pos long, lead long, lead_n long, lead_pos long")


def _overlap(a_n, b_n, p: JaccardParams):
    """The least intersection of sets of these sizes that link: i >= num * (a + b) / (num + den)."""
    return F.ceil((a_n + b_n) * p.num / (p.num + p.den) - 1e-9).cast("long")


def _fits(a_n, b_n, p: JaccardParams):
    return p.den * F.least(a_n, b_n) >= p.num * F.greatest(a_n, b_n)


def _near_bits(a_n, b_n, p: JaccardParams):
    """Whether the bitmaps u_bits and v_bits leave two sets a chance: sets that differ in d tokens differ in at most d bits."""
    apart = sum((F.bit_count(F.col(f"u_{b}").bitwiseXOR(F.col(f"v_{b}"))) for b in BITS[1:]), F.bit_count(F.col(f"u_{BITS[0]}").bitwiseXOR(F.col(f"v_{BITS[0]}"))))
    return apart <= a_n + b_n - 2 * _overlap(a_n, b_n, p)


def _early(a_n, a_pos, b_n, b_pos, p: JaccardParams):
    """Whether enough can still overlap after this shared token, if at most K - 1 shared ones precede it."""
    return K + F.least(a_n - 1 - a_pos, b_n - 1 - b_pos) >= _overlap(a_n, b_n, p)


def _shared_prefix(a_n, b_n, p: JaccardParams):
    """The least number of tokens that the prefixes of two linked sets share, K at least."""
    least = lambda n: F.ceil(n * p.num / p.den - 1e-9).cast("long")
    o = _overlap(a_n, b_n, p)
    return F.greatest(F.lit(1), F.least(o - least(a_n), o - least(b_n)) + K)


def token_sets(docs: DataFrame, people: DataFrame, nodes: DataFrame, p: JaccardParams) -> DataFrame:
    """(node, tokens): the whole set of each of the nodes, sorted uint64 in a binary value, from one text of each.

    Texts are found by their row's id where it has one; those of nodes that only rows without an id carry, by their set.
    """
    spark = docs.sparkSession
    wanted = cut(people.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")))

    def packed(batches, ids=None):
        for batch in batches:
            if ids is not None:
                doc = batch.column(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, doc), max(0, len(ids) - 1))
                batch = batch.filter(pa.array(ids[at] == doc if len(ids) else np.zeros(len(doc), bool)))
            node, sets, size = [], [], 0
            for _, tokens in shingle_sets(batch.column(1), p.width) if batch.num_rows else ():
                if len(tokens):
                    node.append(_node(tokens))
                    sets.append(tokens.tobytes())
                    size += len(tokens)
                if size >= SENT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])
                    node, sets, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, named = whole.where("doc_id is not null"), wanted.where("doc_id is not null").select("doc_id")
    if wanted.count() <= MAX_SENT_NODES:
        sent = spark.sparkContext.broadcast(np.sort(named.toArrow()["doc_id"].to_numpy()))
        out = map_batches(rows, lambda b: packed(b, sent.value), "node long, tokens binary")
    else:
        out = map_batches(rows.join(named, "doc_id").select("doc_id", "text"), packed, "node long, tokens binary")
    if not wanted.where("doc_id is null").isEmpty():  # texts that only rows without an id carry
        out = out.union(map_batches(whole.where("doc_id is null"), packed, "node long, tokens binary"))
    return cut(out.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def verify(pairs: DataFrame, sets: DataFrame, p: JaccardParams) -> DataFrame:
    """The rows of pairs(u, v) whose whole sets of sets(node, tokens) link; a pair with an end that has no set, a null one included, is left out.

    Repeated pairs stay repeated; empty tables give no rows.
    """

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(p.den * same >= p.num * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("u"), F.col("tokens").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("tokens").alias("b"))
    pairs = pairs.select("u", "v")
    if pairs.count() <= MAX_SENT_NODES:  # only the sets of these pairs are shuffled
        found = left.join(F.broadcast(pairs), "u").join(right.join(F.broadcast(pairs), "v"), ["u", "v"])
    else:
        found = pairs.join(left, "u").join(right, "v")
    return map_batches(found.select("u", "v", "a", "b"), run, "u long, v long")


def _placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with comp, the node's component."""
    return rows.join(labels.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _spanning(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """rows with comp and top, the largest component of the list; lists within one component are left out."""
    now = _placed(rows, labels)
    spans = now.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("rows")).groupBy(*keys)
    spans = spans.agg(F.max_by("comp", F.struct("rows", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return now.join(spans.drop("comps"), keys)


def _sides(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs of a list: the left one without the list's largest component, whose nodes need no pairs among them."""
    side = lambda x, these: these.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in (*columns, "n", "pos", "comp", "top", "others", *BITS)))
    return side("u", rows.where("comp <> top")), side("v", rows)


def _apart(p: JaccardParams):
    """Whether a pair joins two components and may link; a pair of which neither is in the largest one counts once."""
    u_n, v_n = F.col("u_n"), F.col("v_n")
    once = (F.col("u") < F.col("v")) | (F.col("v_comp") == F.col("v_top"))
    return (F.col("u_comp") != F.col("v_comp")) & once & _fits(u_n, v_n, p) & _near_bits(u_n, v_n, p)


def _early_pair(p: JaccardParams):
    return _early(F.col("u_n"), F.col("u_pos"), F.col("v_n"), F.col("v_pos"), p)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _small_lists(lists: DataFrame, p: JaccardParams) -> DataFrame:
    """(u, v) that share enough tokens of small lists, given how many others they may share."""
    u, v = _sides(lists, "token")
    ends = F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")
    found = u.join(v, (F.col("u_token") == F.col("v_token")) & _apart(p)).groupBy(*ends)
    shared = _shared_prefix(F.col("u_n"), F.col("v_n"), p) - F.least("u_others", "v_others")
    found = found.agg(F.count(F.lit(1)).alias("tokens"), F.bool_or(_early_pair(p)).alias("early"), F.max(shared).alias("least"))
    return found.where(F.col("early") & (F.col("tokens") >= F.col("least"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _long_lists(lists: DataFrame, keys: list[str], portion: tuple[int, int], p: JaccardParams) -> DataFrame:
    """(u, v) once each: at the first tokens of their class (as many as there are keys) that both have in their prefixes."""
    u, v = _sides(lists, *keys, "own")
    both = F.array_intersect("u_own", "v_own")
    at = _in_portion(portion) & _apart(p) & _early_pair(p)
    for i, key in enumerate(keys):
        at = at & (F.col(f"u_{key}") == F.col(f"v_{key}")) & (F.col(f"u_{key}") == F.element_at(both, i + 1))
    enough = F.size(both) + F.least("u_others", "v_others") >= _shared_prefix(F.col("u_n"), F.col("v_n"), p)
    return _ordered(u.join(v, at & enough))


def _portions(spans: list[DataFrame], keys: list[list[str]]) -> list[tuple[int, int]]:
    """Ranges of parts, growing, that hold every pair: the first is so small that its pairs are few whatever the groups."""
    most = None
    for rows, key in zip(spans, keys):
        one = rows.groupBy(*key).agg((F.count(F.lit(1)) * F.count_if(F.col("comp") != F.col("top")).cast("double")).alias("most")).select("most")
        most = one if most is None else most.union(one)
    total = most.agg(F.sum("most")).first()[0] or 0.0
    end = max(1, min(PORTION_PARTS // PORTION_GROWTH, int(PORTION_PARTS * PORTION_PAIRS / max(1.0, total))))
    out = [(0, end)]
    while end < PORTION_PARTS:
        out.append((end, min(PORTION_PARTS, end * PORTION_GROWTH)))
        end = out[-1][1]
    return out


def _lists(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, node, n, pos, kind) of the lists that span several components; kind is 1 for small, 2 for longer ones."""
    lists = _placed(shared.select("token", "node", "n", "pos"), labels)
    spans = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows")).groupBy("token").agg(F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return lists.drop("comp").join(spans.select("token", F.when(F.col("comps") <= SMALL_COMPONENTS, 1).otherwise(2).alias("kind")), "token")


def _stars(longer: DataFrame, labels: DataFrame, turn: int, p: JaccardParams) -> DataFrame:
    """(u, v): each node of the longer lists with its list's leaders, the nodes whose hashes of this turn are the least."""
    longer = _placed(longer, labels)
    least = [F.min(F.struct(F.xxhash64("node", F.lit(turn * LEADERS + i)), "node", "n", "comp")).alias(f"lead{i}") for i in range(LEADERS)]
    leaders = longer.groupBy("token").agg(*least)
    each = F.array_distinct(F.array(*[F.struct(f"lead{i}.node", f"lead{i}.n", f"lead{i}.comp") for i in range(LEADERS)]))
    pairs = longer.join(leaders, "token").select("node", "n", "comp", F.explode(each).alias("lead"))
    pairs = pairs.where((F.col("comp") != F.col("lead.comp")) & _fits(F.col("n"), F.col("lead.n"), p))
    return _likely(pairs.select("node", "n", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")), p)


def _likely(pairs: DataFrame, p: JaccardParams) -> DataFrame:
    """(u, v) of (node, n, lead, lead_n), a row for each shared token, that share half of what linked ones must."""
    found = pairs.groupBy(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v"))
    found = found.agg(F.count(F.lit(1)).alias("tokens"), F.first("n").alias("a"), F.first("lead_n").alias("b"))
    return found.where(2 * F.col("tokens") >= _shared_prefix(F.col("a"), F.col("b"), p)).select("u", "v")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, component) after links(u, v): beyond what one task contracts, only the graph of components is searched."""
    if labels.count() + links.count() <= FOREST_EDGES:
        return components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links.select("u", "v")))
    ends = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    everyone = cut(labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))))
    of = lambda x: everyone.select(F.col("node").alias(x), F.col("component").alias(f"{x}_comp"))
    edges = cut(links.join(of("u"), "u").join(of("v"), "v").select(F.col("u_comp").alias("u"), F.col("v_comp").alias("v")).distinct())
    moved = components(edges).select(F.col("node").alias("component"), F.col("component").alias("least"))
    return cut(everyone.join(moved, "component", "left").select("node", F.coalesce("least", "component").alias("component")))


def _in_portion(portion: tuple[int, int]):
    """Whether the pair of u and v, in either order, is in this portion; every pair is in one."""
    part = F.pmod(F.xxhash64(F.least("u", "v"), F.greatest("u", "v")), F.lit(PORTION_PARTS))
    return part.between(portion[0], portion[1] - 1)


def _index(lists: DataFrame, longer: DataFrame, labels: DataFrame, people: DataFrame) -> list[DataFrame]:
    """The index's three classes (rare tokens, longer lists, combinations of two frequent tokens), each with what its node has beside them.

    A pair's first two shared tokens decide where it is found: one of a rare class finds it alone, two of the frequent
    class find it as a combination. Parity bitmaps of the sets then reject most pairs that share a lot but do not link;
    they never reject one that links.
    """
    spans = _placed(longer, labels).groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows")).groupBy("token").agg(F.count(F.lit(1)).alias("comps"))
    frequent = F.when(F.col("comps") > FREQUENT_COMPONENTS, 3).otherwise(2).alias("kind")
    longer = cut(longer.join(spans.where("comps > 1").select("token", frequent), "token"))
    rare = lists.where("kind = 1").select(*longer.columns)
    placed = F.struct("pos", "token")
    own = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, placed))), lambda x: x["token"])
    few = F.count(F.when(F.col("kind") == 1, F.lit(1)))
    nodes = rare.union(longer).groupBy("node").agg(own(2).alias("middle"), own(3).alias("frequent"), few.alias("small"))
    bitmaps = people.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(*(F.first(b).alias(b) for b in BITS))
    nodes = cut(nodes.join(bitmaps, "node"))
    rare = rare.join(nodes.select("node", (F.size("middle") + F.size("frequent")).alias("others"), *BITS), "node")
    middle = longer.where("kind = 2").join(nodes.select("node", F.col("middle").alias("own"), (F.col("small") + F.size("frequent")).alias("others"), *BITS), "node")
    often = longer.where("kind = 3").join(nodes.select("node", F.col("frequent").alias("own"), (F.col("small") + F.size("middle")).alias("others"), *BITS), "node")
    second = longer.where("kind = 3").select("node", F.col("token").alias("t2"), F.col("pos").alias("second"))
    combined = often.withColumnRenamed("token", "t1").join(second, "node").where("pos < second").withColumn("pos", F.col("second"))
    return [rare.drop("kind"), cut(middle.drop("kind")), cut(combined.drop("kind"))]


def ngram_jaccard_join(docs: DataFrame, params: JaccardParams = JaccardParams(), carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text, ...); with columns to carry, then component and those.

    component_id is the smallest doc_id that links reach, the row's own included. Null and word-less texts have no
    shingle, link with nothing and are their own component; a null doc_id counts as the largest of its component and
    stays null only where no other is reachable. Rows that repeat are alike, and so are kept apart as rows but not as
    components. Texts of any length are taken whole. An empty table gives an empty result; columns other than doc_id,
    text and those to carry are not read. component is a hash that tells components apart without ids, null without words.
    """
    p = params
    spark: SparkSession = docs.sparkSession
    people = cut(members(docs, p, carry))
    rows, total = people.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    empty = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    labels = _node_components(docs, people, p, total) if total else empty
    nodes = people.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    nodes = cut(nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = join_hot(nodes.withColumnRenamed("size", "copies"), least, "component", rows).select("node", "component", "component_id", F.col("copies").alias("size"))
    joined = join_hot(people.where("node is not null").drop(*BITS), named, "node", rows)
    alone = people.where("node is null").drop(*BITS).withColumns({"component": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long")})
    found = joined.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component", *carry)
    return found if carry else found.drop("component")


def _node_components(docs: DataFrame, people: DataFrame, p: JaccardParams, total: int) -> DataFrame:
    table = order_table(cut(token_counts(docs, p, total)))
    spark = docs.sparkSession
    release(spark)
    shared = cut(shared_postings(postings(docs, p, table)))
    release(spark)
    ends = lambda pairs: pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    tried = cut(_likely(shared.where((F.col("node") != F.col("lead")) & _fits(F.col("n"), F.col("lead_n"), p)), p))
    sets = token_sets(docs, people, ends(tried), p)
    labels = components(cut(verify(tried, sets, p)))
    lists = cut(_lists(shared, labels))
    del shared, tried
    release(spark)
    longer = cut(lists.where("kind = 2").drop("kind"))
    if not longer.isEmpty():
        sets = sets.union(token_sets(docs, people, longer.select("node").distinct().join(sets, "node", "left_anti"), p))
    for turn in range(MAX_STAR_TURNS if not longer.isEmpty() else 0):
        stars = cut(_stars(longer, labels, turn, p))
        new = cut(verify(stars, sets, p))
        found, tries = new.count(), stars.count()
        if found:
            labels = _joined(labels, new)
        if found < STAR_YIELD * tries or not tries:
            break
    rare, *frequent = _index(lists, longer, labels, people)
    release(spark)
    keys, portions = [["token"], ["t1", "t2"]], None
    while portions is None or portions:
        spans = [cut(_spanning(rows, labels, key)) for rows, key in zip(frequent, keys)]
        portions = _portions(spans, keys) if portions is None else portions
        portion = portions.pop(0)
        pairs = _long_lists(spans[0], keys[0], portion, p).union(_long_lists(spans[1], keys[1], portion, p))
        if not portions:  # the small lists come with the last portion, when most components are joined
            pairs = pairs.union(_small_lists(_spanning(rare, labels, ["token"]), p))
        pairs = cut(pairs.distinct())
        release(spark)
        if pairs.isEmpty():
            continue
        rest = ends(pairs).join(sets, "node", "left_anti")
        if not rest.isEmpty():
            sets = sets.union(token_sets(docs, people, rest, p))
        new = cut(verify(pairs, sets, p))
        if not new.isEmpty():
            labels = _joined(labels, new)
    return labels
