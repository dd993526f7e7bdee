"""Operator 12: removal of long repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes covers it that starts anywhere else too. Suffixes are sorted at anchors only: the
anchor of a window of ``length`` bytes is the place with the smallest hash among its first places, a choice that its content
alone makes, so equal windows have their anchors at the same distance. Windows that follow each other and share an anchor
are one entry: the suffix at the anchor, and the bytes between the first window's start and the anchor.

* The first ``core`` bytes of an anchor's suffix lie in all its windows. Suffixes whose core occurs once in the corpus by a 64-bit
  hash go no further, as in distributed string sorting by approximate distinguishing prefixes (Bingmann, Sanders and Schimek,
  IPDPS 2020).
* Every task sorts the others into runs, in which an entry states how many bytes it shares with the one before and gives
  only the rest, and deals the runs out by core.
* A task merges the runs of its cores by a loser tree that holds the length of each contender's common prefix with the last
  winner: the longer one wins unseen, and equal ones are compared from there on, so known prefixes are never compared again.
* Merged entries come with their common prefixes, so those that share the bytes right of the anchor are neighbours; with a
  hash of the bytes left of it, every window's copies are found.

Equal texts are one text with a count before anything is sorted. Cores of more than ``hot`` entries don't meet in one
task: their windows are counted by 128-bit fingerprints instead, with partial sums in every task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint_root, join_hot, map_batches, partitions, release, remove, write_out
from .words import mix, text_chunks

#: Bytes of a text whose anchors are found at once; longer texts are taken in pieces that overlap by a window. At least words.CHUNK_BYTES.
PIECE = 1 << 20
#: Bytes of entries that a task sorts into one run.
RUN_BYTES = 16 << 20
#: Bytes of entries, about, that one task merges.
MERGE_BYTES = 16 << 20
#: Entries whose windows are looked at together.
BLOCK = 1 << 15
_GRAM = 16
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_SECOND = 0xC2B2AE3D27D4EB4F


@dataclass(frozen=True)
class SuffixParams:
    """length: bytes of a repeated string; core: bytes that all windows of an anchor share; hot: entries of a core that one task merges at most."""

    length: int = 200
    core: int = 100
    hot: int = 20_000


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def _doubled(raw: np.ndarray, most: int, base: int) -> dict[int, np.ndarray]:
    """width -> polynomial hash of the bytes from each place, for powers of two up to most."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
    out, w = {1: table[raw]}, 1
    while 2 * w <= most:
        last = out[w]
        out[2 * w] = last[:-w] * _power(base, w) + last[w:]
        w *= 2
    return out


def _hash_at(hashes: dict[int, np.ndarray], at: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of ``width`` bytes from each of the places, put together from powers of two."""
    out, done = np.zeros(len(at), np.uint64), 0
    for w in sorted(hashes, reverse=True):
        while width - done >= w:
            out = out * _power(base, w) + hashes[w][at + done]
            done += w
    return mix(out)


def _pieces(raw: np.ndarray, offsets: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first byte's place); a single long text comes in pieces whose windows don't repeat."""
    if len(offsets) > 2 or len(raw) <= PIECE:
        yield raw, offsets, 0
        return
    for start in range(0, len(raw) - overlap, PIECE):
        piece = raw[start : start + PIECE + overlap]
        yield piece, np.array([0, len(piece)]), start


def anchors(raw: np.ndarray, offsets: np.ndarray, p: SuffixParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first window, last window, hash of the core) of all entries of these texts, in order; places in raw."""
    gram = min(_GRAM, p.core)
    for piece, own, base in _pieces(raw, offsets, p.length - 1):
        n = len(piece)
        if n < p.length:
            continue
        with np.errstate(over="ignore"):
            hashes = _doubled(piece, p.core, _BASE)
            order = mix(hashes[gram]) if gram in hashes else _hash_at(hashes, np.arange(n - gram + 1), gram, _BASE)
            least = (order & ~_PLACE) | np.arange(len(order), dtype=np.uint64)
            width = 1
            while 2 * width <= p.length - p.core + 1:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            rest = p.length - p.core + 1 - width
            least = np.minimum(least[: len(least) - rest], least[rest:])
            ends = np.repeat(own[1:], np.diff(own))
            starts = np.flatnonzero(np.arange(n) + p.length <= ends)
            if not len(starts):
                continue
            at = (least[starts] & _PLACE).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
            last = np.concatenate((new[1:], [len(starts)])) - 1
            yield at[new] + base, starts[new] + base, starts[last] + base, _hash_at(hashes, at[new], p.core, _BASE).view(np.int64)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of two strings that are known to share their first bytes."""
    n = min(len(a), len(b))
    apart = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (apart.bit_length() + 7) // 8 if apart else n


def front_code(ordered: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(bytes shared with the string before, the rest) of each string."""
    shared, rest, past = [], [], b""
    for s in ordered:
        k = common_prefix(past, s, 0)
        shared.append(k)
        rest.append(s[k:])
        past = s
    return shared, rest


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, place in it, bytes shared with the string before, string) of all strings of front-coded sorted runs, in order."""
    k = len(runs)
    size = 1
    while size < max(2, k):
        size *= 2
    place, current, shared = [0] * size, [None] * size, [0] * size
    for i, (_, rest) in enumerate(runs):
        if rest:
            current[i] = rest[0]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        x, y = current[a], current[b]
        if x is None:
            return b, a
        if y is None or shared[a] > shared[b]:
            return a, b
        if shared[b] > shared[a]:
            return b, a
        h = common_prefix(x, y, shared[a])
        if h == len(x) or h < len(y) and x[h] < y[h]:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while (out := current[top]) is not None:
        i = place[top]
        yield top, i, shared[top], out
        lcps, rest = runs[top]
        place[top] = i = i + 1
        if i < len(rest):
            current[top], shared[top] = out[: lcps[i]] + rest[i], lcps[i]
        else:
            current[top] = None
        node = (size + top) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated_windows(shared: np.ndarray, rights: np.ndarray, lefts: list[bytes], often: np.ndarray, p: SuffixParams) -> np.ndarray:
    """Which windows of sorted entries occur again: a row an entry, a column for each distance of a window's start before the anchor.

    shared: common prefix with the entry before; rights: lengths of the suffixes; lefts: bytes before the anchor, backwards;
    often: how many copies an entry stands for.
    """
    m, most = len(shared), p.length - p.core
    left_sizes = np.array([len(x) for x in lefts])
    windows = np.arange(most + 1)
    own = (windows >= (p.length - rights)[:, None]) & (windows <= left_sizes[:, None])
    out = own & (often > 1)[:, None]
    group = np.cumsum(shared < p.core)
    alone = np.bincount(group)[group] == 1
    live = np.flatnonzero(~alone)
    if not len(live):
        return out
    grid = np.zeros((len(live), most), np.uint8)
    flat = np.frombuffer(b"".join(lefts[i] for i in live), np.uint8)
    sizes = left_sizes[live]
    row = np.repeat(np.arange(len(live)), sizes)
    grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    left = np.zeros(len(live), np.uint64)
    with np.errstate(over="ignore"):
        for before in range(most + 1):
            if before:
                left = mix(left * np.uint64(_BASE) + grid[:, before - 1] + np.uint64(1))
            here = np.flatnonzero(own[live, before])
            if not len(here):
                continue
            right = np.cumsum(shared < p.length - before)[live[here]].astype(np.uint64)
            _, back, counts = np.unique(mix(left[here] ^ mix(right * np.uint64(_SECOND))), return_inverse=True, return_counts=True)
            out[live[here], before] |= counts[back] > 1
    return out


def _spans(repeated: np.ndarray, left_sizes: np.ndarray, p: SuffixParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, start, end) of the runs of repeated windows, in bytes from the entry's first window."""
    padded = np.pad(repeated.astype(np.int8), ((0, 0), (1, 1)))
    edge = np.diff(padded, axis=1)
    entry, near = np.nonzero(edge == 1)
    _, far = np.nonzero(edge == -1)
    return entry, left_sizes[entry] - (far - 1), left_sizes[entry] - near + p.length


# stages


def _texts(docs: DataFrame, p: SuffixParams) -> tuple[DataFrame, str, str]:
    """(k1, k2, text, copies) of distinct texts of a window or more, bucketed by their key so that later joins don't move texts; table, folder."""
    spark = docs.sparkSession
    keyed = docs.where(F.octet_length("text") >= p.length).select(*_key(), "text")
    distinct = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    folder, name = f"{checkpoint_root(spark)}/texts-{uuid.uuid4().hex}", f"lumenqa_texts_{uuid.uuid4().hex}"
    distinct.write.option("path", folder).bucketBy(partitions(spark), "k1", "k2").saveAsTable(name)
    return spark.table(name), name, folder


def _key() -> list:
    """Two columns of 60 bits each of the text's SHA-256."""
    digest = F.sha2("text", 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "k1"), (16, "k2"))]


def _cores(texts: DataFrame, p: SuffixParams) -> DataFrame:
    """(core, k1, k2, number) of every entry of every text, numbered in its text."""

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for first, raw, offsets in text_chunks(batch.column(2)):
                past = 0  # entries of earlier pieces; only a text alone in its chunk has several
                for at, *_, core in anchors(raw, offsets, p):
                    row = np.searchsorted(offsets, at, side="right") - 1
                    number = np.arange(len(at)) - np.searchsorted(row, row) + past
                    past += len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(k1[first + row]), pa.array(k2[first + row]), pa.array(number.astype(np.int32))], ["core", "k1", "k2", "number"])

    return map_batches(texts.select("k1", "k2", "text"), run, "core long, k1 long, k2 long, number int")


def _chosen(batch: pa.RecordBatch, p: SuffixParams) -> Iterator[tuple[bytes, int, int, np.ndarray, ...]]:
    """(bytes, k1, k2, anchor, first window, last window, core, hot) of the wanted entries of each row (k1, k2, text, wanted)."""
    k1, k2 = (batch.column(i).to_pylist() for i in (0, 1))
    wanted = batch.column(3)
    for i in range(batch.num_rows):
        raw = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
        cols = [np.concatenate(x) for x in zip(*anchors(raw, np.array([0, len(raw)]), p))]
        chosen = wanted[i].values
        number, hot = chosen.field(0).to_numpy(), chosen.field(1).to_numpy(zero_copy_only=False)
        yield raw.tobytes(), k1[i], k2[i], *(c[number] for c in cols), hot


_RUN = pa.schema([("shared", pa.int32()), ("rest", pa.binary()), ("left", pa.binary()), ("copies", pa.int32()), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), ("first", pa.list_(pa.int32()))])


def _coded(entries: list[tuple]) -> bytes:
    """A sorted run as bytes: front-coded suffixes, the bytes before each anchor, and the places of all copies of an entry."""
    entries.sort(key=itemgetter(0, 1))
    kinds, owners = [], []
    for right, left, *owner in entries:
        if not kinds or kinds[-1] != (right, left):
            kinds.append((right, left))
            owners.append([])
        owners[-1].append(owner)
    shared, rest = front_code([right for right, _ in kinds])
    cols = [shared, rest, [left for _, left in kinds], [len(o) for o in owners], *([[x[i] for x in o] for o in owners] for i in range(3))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RUN)], schema=_RUN)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _RUN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _runs(wanted: DataFrame, tasks: int, p: SuffixParams) -> DataFrame:
    """(dest, run) of rows (k1, k2, text, wanted): sorted front-coded runs of the entries that aren't hot, dealt by core."""

    def flush(held):
        rows = [(dest, _coded(entries)) for dest, entries in held.items()]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], ["dest", "run"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for data, k1, k2, at, first, last, core, hot in _chosen(batch, p):
                dest = (core.view(np.uint64) % np.uint64(tasks)).astype(np.int64)
                for a, lo, hi, d, h in zip(at.tolist(), first.tolist(), last.tolist(), dest.tolist(), hot.tolist()):
                    if h:
                        continue
                    right, left = data[a : hi + p.length], data[lo:a][::-1]
                    held.setdefault(d, []).append((right, left, k1, k2, lo))
                    size += len(right) + len(left)
                    if size >= RUN_BYTES:
                        yield flush(held)
                        held, size = {}, 0
        if held:
            yield flush(held)

    return map_batches(wanted, run, "dest int, run binary")


SPANS = "k1 long, k2 long, start int, end int"


def _merged(runs: DataFrame, p: SuffixParams) -> DataFrame:
    """(k1, k2, start, end) of repeated stretches, from rows (dest, run) that come sorted by dest."""

    def told(block):
        shared, rights, lefts, tables, at = zip(*block)
        often = np.array([t["copies"][i] for t, i in zip(tables, at)])
        found = repeated_windows(np.array(shared), np.array(rights), list(lefts), often, p)
        entry, start, end = _spans(found, np.array([len(x) for x in lefts]), p)
        k1, k2, first, n = [], [], [], []
        for e in entry.tolist():
            t, a, b = tables[e], *tables[e]["bounds"][at[e] : at[e] + 2]
            k1.append(t["k1"][a:b])
            k2.append(t["k2"][a:b])
            first.append(t["first"][a:b])
            n.append(b - a)
        if not n:
            return None
        first = np.concatenate(first).astype(np.int64)
        cols = [np.concatenate(k1), np.concatenate(k2), first + np.repeat(start, n), first + np.repeat(end, n)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))], ["k1", "k2", "start", "end"])

    def merge(held):
        tables = []
        for one in held:
            batch = pa.ipc.open_stream(one).read_next_batch()
            copies = batch.column(3).to_numpy()
            tables.append({"shared": batch.column(0).to_pylist(), "rest": batch.column(1).to_pylist(), "left": batch.column(2).to_pylist(), "copies": copies, "bounds": np.concatenate(([0], np.cumsum(copies))), **{n: batch.column(i).flatten().to_numpy() for i, n in ((4, "k1"), (5, "k2"), (6, "first"))}})
        block = []
        for r, i, shared, right in merge_runs([(t["shared"], t["rest"]) for t in tables]):
            if shared < p.core and len(block) >= BLOCK:
                if (out := told(block)) is not None:
                    yield out
                block = []
            block.append((shared, len(right), tables[r]["left"][i], tables[r], i))
        if block and (out := told(block)) is not None:
            yield out

    def run(batches):
        dest, held = None, []
        for batch in batches:
            for d, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                if d != dest and held:
                    yield from merge(held)
                    held = []
                dest = d
                held.append(one.as_py())
        if held:
            yield from merge(held)

    return map_batches(runs, run, SPANS)


def _hot_windows(wanted: DataFrame, p: SuffixParams) -> DataFrame:
    """(w, k1, k2, start) of every window of the hot entries; w is its 128-bit fingerprint."""

    def run(batches):
        for batch in batches:
            for data, k1, k2, at, first, last, _, hot in _chosen(batch, p):
                first, last = first[hot], last[hot]
                if not len(first):
                    continue
                sizes = last - first + 1
                start = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                w = [hashlib.md5(data[i : i + p.length], usedforsecurity=False).digest() for i in start.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(np.full(len(w), k1)), pa.array(np.full(len(w), k2)), pa.array(start.astype(np.int32))], ["w", "k1", "k2", "start"])

    return map_batches(wanted, run, "w binary, k1 long, k2 long, start int")


def _kept(texts: DataFrame) -> DataFrame:
    """(k1, k2, copies, n_removed, n_spans, kept_sha256) of rows (k1, k2, copies, text, spans); spans are (start, end)."""

    def run(batches):
        for batch in batches:
            removed, runs, digests = [], [], []
            for i in range(batch.num_rows):
                data = memoryview(batch.column(3)[i].as_buffer())
                n, digest = len(data), hashlib.sha256()
                gone = np.zeros(n + 1, bool)
                if batch.column(2)[i].as_py() > 1:
                    gone[:n] = True
                elif (spans := batch.column(4)[i].values) is not None:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, spans.field(0).to_numpy(), 1)
                    np.add.at(step, spans.field(1).to_numpy(), -1)
                    gone = np.cumsum(step) > 0
                edge = np.diff(gone.astype(np.int8), prepend=np.int8(0))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                at = 0
                for a, b in zip(starts.tolist(), ends.tolist()):
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                removed.append(int((ends - starts).sum()))
                runs.append(len(starts))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], ["k1", "k2", "copies", "n_removed", "n_spans", "kept_sha256"])

    return map_batches(texts, run, "k1 long, k2 long, copies long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, p: SuffixParams = SuffixParams()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs(doc_id, text, ...).

    Bytes are the text's UTF-8 bytes; a null text counts as empty. Texts shorter than a window keep everything; texts that occur twice
    or more lose everything. Rows count by themselves, whatever their id: a null or repeated doc_id stays as it is. Texts of
    any length are taken whole, up to 2**31 bytes; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts, name, texts_at = _texts(rows, p)
    release(spark)
    cores, cores_at = write_out(_cores(texts, p))
    counts, counts_at = write_out(cores.groupBy("core").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("hot", F.col("size") > p.hot))
    often, total = cores.count(), counts.agg(F.sum("size")).first()[0] or 0
    release(spark)
    met = join_hot(cores, counts, "core", often).where(F.col("hot").isNotNull())
    wanted = met.groupBy("k1", "k2").agg(F.collect_list(F.struct("number", "hot")).alias("wanted"))
    wanted, wanted_at = write_out(wanted)
    remove(spark, cores_at)
    release(spark)
    chosen = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted")
    tasks = max(partitions(spark), -(-total * 3 * p.length // 2 // MERGE_BYTES))
    runs = _runs(chosen, tasks, p).repartition(tasks, "dest").sortWithinPartitions("dest")
    spans, spans_at = write_out(_merged(runs, p))
    release(spark)
    folders = [counts_at, wanted_at, spans_at]
    if counts.where("hot").limit(1).count():
        windows, windows_at = write_out(_hot_windows(chosen.where(F.exists("wanted", lambda x: x["hot"])), p))
        again = windows.groupBy("w").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("again", F.lit(True))
        found = join_hot(windows, again, "w", windows.count()).where("again")
        spans = spans.union(found.select("k1", "k2", "start", (F.col("start") + p.length).alias("end")))
        folders.append(windows_at)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kept, kept_at = write_out(_kept(texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "copies", "text", "spans")))
    for folder in folders:
        remove(spark, folder)
    spark.sql(f"drop table {name}")
    remove(spark, texts_at)
    release(spark)
    long = F.octet_length("text") >= p.length
    short = rows.where(~long).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    keyed = rows.where(long).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.struct(*_key()).alias("k"))
    table = kept.select(F.struct("k1", "k2").alias("k"), F.col("copies").alias("size"), "n_removed", "n_spans", "kept_sha256")
    out, _ = write_out(short.unionByName(join_hot(keyed, table, "k", rows.count()).drop("k")))
    remove(spark, kept_at)
    return out
