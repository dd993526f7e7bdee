"""All-pairs scores in blocks: rows are packed into blocks of bounded size, and each pair of blocks is one matrix computation.

Exact searches over all rows need every pair scored; here no pair becomes a row unless it is kept. Blocks meet in the cells of a
grid by an equi-join, and a task holds two blocks at a time, whatever the tables' size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import cut

ROWS = 1024


def flat(column: pa.Array, i: int) -> dict[str, np.ndarray]:
    """The fields of the i-th block: numbers as arrays, lists of numbers as matrices, structs as they are."""
    one = column.slice(i, 1).flatten()
    out = {}
    for field in one.type:
        values = one.field(field.name)
        if pa.types.is_list(field.type):
            out[field.name] = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1) if len(values) else np.zeros((0, 0))
        else:
            out[field.name] = values if pa.types.is_struct(field.type) else values.to_numpy(zero_copy_only=False)
    return out


def blocks(rows: DataFrame, size: int = ROWS) -> tuple[DataFrame, int]:
    """(block, rows array<struct>) of about size rows each, dealt by the hash of the whole row and its place in the input; and their number."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.select(F.struct(*rows.columns).alias("r")).withColumn("block", F.pmod(F.xxhash64("r", F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    return dealt.groupBy("block").agg(F.collect_list("r").alias("rows")), n


#: Blocks of one side that a cell of the grid holds at most.
SIDE = 64

#: Tasks of own_pairs() for each shuffle partition: cells are dealt by hash, so that few large tasks would be uneven ones.
CELLS = 4


def _strips(n: int, tasks: int) -> int:
    """Strips that n blocks are dealt into: few, as every row is sent once for each strip of the other side, but enough for all tasks to have a cell."""
    return min(n, max(-(-n // SIDE), int((4 * tasks) ** 0.5) + 1))


def pairs(left: DataFrame, right: DataFrame, score: Callable[[dict, dict], Iterator[tuple[np.ndarray, ...]]], schema: str, size: int = ROWS) -> DataFrame:
    """What score(left block, right block) yields for all pairs of blocks, as rows of the schema.

    A block is a dict of its columns: numpy arrays, or matrices for array columns. Columns must not be null. Both sides are cut into strips of
    blocks, and a cell of the grid meets one strip of each: a row is sent to as many cells as the other side has strips, which is
    the rows over SIDE * size.
    """
    a, na = blocks(left, size)
    b, nb = blocks(right, size)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ga, gb = _strips(na, tasks), _strips(nb, tasks)
    over = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    rows = a.select((F.col("block") % ga).alias("i"), over(gb).alias("j"), F.col("rows").alias("a")).hint("merge")  # no side goes by the driver
    columns = b.select((F.col("block") % gb).alias("j"), over(ga).alias("i"), F.col("rows").alias("b"))
    names = [c.strip().rsplit(" ", 1)[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cols = score(flat(batch.column(0), i), flat(batch.column(1), i))
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return rows.join(columns, ["i", "j"]).select("a", "b").mapInArrow(run, schema)


#: Bytes of vectors, as doubles, that a cell of best_pairs() holds of one side at most.
CELL_BYTES = 1 << 26


def best_pairs(left: DataFrame, right: DataFrame, k: int, apart: bool = False, size: int = ROWS) -> DataFrame:
    """(a, b, score): of left(id, vector) with right(id, vector) by cosine, or by 1 - cosine if apart, at least the k best of each left row; an id is no partner of itself.

    Scores are compared to 9 digits, ties go to the smaller id. Strips of blocks meet in the cells of a grid, and a cell gives k rows for each of its left ones. It
    multiplies in single precision: what that leaves behind the k-th so far by more than its error is settled, and only the others are scored in double.
    """
    spark, names = left.sparkSession, ("id", "vector")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = right.select(F.size(right.columns[1])).first()
    width = max(1, first[0] if first else 1)
    rows = max(1, min(size, CELL_BYTES // (8 * width)))
    side = max(1, min(SIDE, CELL_BYTES // (8 * width * rows)))

    def pack(batches):
        for batch in batches:
            values = pa.array([_bytes(batch.column(1).slice(i, 1).flatten(), None) for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["block", "rows"])

    def packed(table):
        dealt, n = blocks(table.toDF(*names), rows)
        return dealt.mapInArrow(pack, "block int, rows binary"), min(n, max(-(-n // side), _strips(n, tasks)))

    (x, ga), (y, gb) = packed(left), packed(right)
    over = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    a = x.select((F.col("block") % ga).alias("i"), over(gb).alias("j"), "rows")
    b = y.select((F.col("block") % gb).alias("j"), over(ga).alias("i"), "rows").select("i", "j", "rows")

    def unpacked(table):
        out = []
        for value in table.column("rows"):
            batch = pa.ipc.open_stream(value.as_buffer()).read_next_batch()
            if batch.num_rows:
                vectors = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                out.append((batch.column(0).to_numpy(), vectors, vectors.astype(np.float32)))
        return out

    def run(mine, yours):
        yours, found = unpacked(yours), []
        for one in unpacked(mine):
            found.append(_best_of(one, yours, k, apart))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.Table.from_arrays([pa.array(c) for c in cols], ["a", "b", "score"])

    # Blocks are few bytes for what their pairs cost, so partitions are not to be merged by size.
    a, b = (x.repartition(CELLS * tasks, "i", "j").groupBy("i", "j") for x in (a, b))
    return a.cogroup(b).applyInArrow(run, "a long, b long, score double")


def _best_of(mine: tuple, yours: list[tuple], k: int, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, score) of the k best of each row of one block among the rows of others: blocks are ids, unit vectors in double and in single precision."""
    ids, double, single = mine
    if apart:
        single = -single
    error = max(1e-5, 4e-7 * single.shape[1])
    least = np.full(len(ids), -np.inf)  # a bound of the k-th best so far
    row, other, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at, (their, vectors, short) in enumerate(yours):
        near = single @ short.T
        if not at and len(their) > k:
            masked = np.where((ids[:, None] != their[None, :]) & (near == near), near, -np.inf)
            least = np.partition(masked, len(their) - k, axis=1)[:, len(their) - k] - 2 * error
        r, c = np.divmod(np.flatnonzero(near >= least[:, None].astype(np.float32)), len(their))
        r, c = (x[ids[r] != their[c]] for x in (r, c))
        if len(r) * 16 > near.size:
            exact = (double @ vectors.T)[r, c]
        else:
            step = max(1, (1 << 21) // double.shape[1])
            exact = np.concatenate([np.einsum("ij,ij->i", double[r[i : i + step]], vectors[c[i : i + step]]) for i in range(0, len(r), step)] or [np.zeros(0)])
        row, other, score = np.concatenate([row, r]), np.concatenate([other, their[c]]), np.concatenate([score, 1 - exact if apart else exact])
        if len(row) > 3 * k * len(ids) or at == len(yours) - 1:
            rounded = np.round(score, 9)
            by = np.lexsort((other, -rounded, row))
            place = np.arange(len(by)) - np.searchsorted(row[by], row[by])
            last = by[place == k - 1]
            least[row[last]] = np.maximum(least[row[last]], rounded[last] - (1 if apart else 0) - 2 * error)
            by = by[place < k]
            row, other, score = row[by], other[by], score[by]
    return ids[row], other, score


#: Rows that a task holds of what its blocks made before they are merged.
HELD = 1 << 19


def own_pairs(rows: DataFrame, score: Callable[[dict, dict, bool], tuple[np.ndarray, ...]], schema: str, merge: Callable[[tuple[np.ndarray, ...]], tuple[np.ndarray, ...]] | None = None, size: int = ROWS) -> DataFrame:
    """What score(block, block, the same) yields for each pair of blocks of one table once, in either order, and for each block with itself.

    merge makes fewer rows of what the blocks of a task yielded, which then goes on as a whole: once HELD rows are together, and at the end.
    Without it score may also give a list of such parts, each of which goes on by itself.
    """
    dealt, n = blocks(rows, size)
    dealt = cut(dealt)  # dealt once, as both sides must see the same blocks
    tasks = CELLS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strips = _strips(n, tasks)
    strip = (F.col("block") % strips).alias("i")
    a = dealt.select(strip, F.explode(F.sequence(strip, F.lit(strips - 1))).alias("j"), F.col("block").alias("p"), F.col("rows").alias("a"))
    b = dealt.select(strip.alias("j"), F.explode(F.sequence(F.lit(0), strip)).alias("i"), F.col("block").alias("q"), F.col("rows").alias("b"))
    names, held_most = [c.strip().split(" ", 1)[0] for c in schema.split(",")], HELD

    def run(batches):
        held, total = [], 0

        def merged():
            return merge(tuple(np.concatenate(c) for c in zip(*held)))

        for batch in batches:
            same = batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                cols = score(flat(batch.column(0), i), flat(batch.column(1), i), same[i])
                if not merge:
                    for part in cols if isinstance(cols, list) else [cols]:
                        if len(part[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], names)
                    continue
                if not len(cols[0]):
                    continue
                held.append(cols)
                total += len(cols[0])
                if total >= held_most:
                    cols = merged()
                    held, total = [cols], len(cols[0])
                    if total > held_most // 2:
                        held, total = [], 0
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], names)

    # Blocks are few bytes for what their pairs cost, so partitions are not to be merged by size.
    met = a.repartition(tasks, "i", "j").hint("merge").join(b.repartition(tasks, "i", "j"), ["i", "j"]).where("i < j or p <= q")
    return met.select("a", "b", (F.col("p") == F.col("q")).alias("same")).mapInArrow(run, schema)


def grouped_pairs(rows: DataFrame, group: str, score: Callable[[dict, dict], tuple[np.ndarray, ...]], schema: str, size: int = ROWS, left: DataFrame | None = None) -> DataFrame:
    """What score(left block, right block) yields for all pairs of blocks within each group, both ways and each with itself; left rows are all rows unless given.

    A group of any size is many blocks of about ``size`` rows, so a task holds two blocks at a time.
    """

    def packed(rows: DataFrame, name: str) -> DataFrame:
        fields = [c for c in rows.columns if c != group]
        sizes = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
        dealt = rows.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64(*fields, F.monotonically_increasing_id()), F.col("_n")))
        return dealt.groupBy(group, "_block").agg(F.collect_list(F.struct(*fields)).alias(name)).drop("_block")

    names = [c.strip().rsplit(" ", 1)[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cols = score(flat(batch.column(0), i), flat(batch.column(1), i))
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    # Blocks are few bytes for what their pairs cost, so partitions are not to be merged by size.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (x.repartition(tasks, group) for x in (packed(rows if left is None else left, "a"), packed(rows, "b")))
    return a.hint("merge").join(b, group).select("a", "b").mapInArrow(run, schema)


def _bytes(one: pa.StructArray, compression: str | None = "zstd") -> bytes:
    """A block as one value, compressed: copies of it are sent to many cells, and its columns may hold the same values again and again."""
    columns = {f.name: one.field(f.name) for f in one.type}
    batch, out = pa.RecordBatch.from_pydict({name: c.dictionary_encode() if pa.types.is_string(c.type) else c for name, c in columns.items()}), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as to:
        to.write_batch(batch)
    return out.getvalue().to_pybytes()


def _block(value: pa.BinaryScalar) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(value.as_buffer()).read_next_batch()
    return {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}


#: Packed blocks of one side that a cell holds at most, of some tens of KB each.
PACKED_SIDE = 512


def _side(pairs: float, tasks: int) -> int:
    """Blocks of one side of a cell: many, as every row is sent once for each strip of the other side, but few enough for all tasks to have some cells."""
    return max(1, min(PACKED_SIDE, int((pairs / (4 * tasks)) ** 0.5)))


def own_grouped_pairs(rows: DataFrame, sizes: DataFrame, group: str, score: Callable[[dict, dict, bool], tuple[np.ndarray, ...]], schema: str, size: int = ROWS) -> DataFrame:
    """What score(block, block, the same) yields for each pair of blocks within each group once, in either order, and for each block with itself.

    sizes is (group, _count) of the groups that are to be scored. The blocks of a group are cut into strips that meet in the cells of a grid, so
    many tasks score one group, and a task holds PACKED_SIDE blocks of a strip at most, whatever the group's size. Columns are numbers and texts.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = cut(sizes.select(group, F.ceil(F.col("_count") / size).cast("int").alias("_n")))
    side = _side(sizes.agg(F.sum(F.col("_n").cast("double") * (F.col("_n") + 1) / 2)).first()[0] or 0, tasks)
    fields = [c for c in rows.columns if c != group]
    dealt = rows.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64(*fields, F.monotonically_increasing_id()), F.col("_n")).cast("int"))
    packed = dealt.groupBy(group, "_n", "_block").agg(F.collect_list(F.struct(*fields)).alias("_rows"))
    kept, names = [group, "_n", "_block"], [c.strip().rsplit(" ", 1)[0] for c in schema.split(",")]

    def pack(batches):
        for batch in batches:
            values = pa.array([_bytes(batch.column(3).slice(i, 1).flatten()) for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], values], [*kept, "_rows"])

    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(kept).schema) + ", _rows binary"
    packed = cut(packed.select(*kept, "_rows").mapInArrow(pack, whole))  # dealt once, as both sides must see the same blocks
    strips = F.ceil(F.col("_n") / side).cast("int")
    strip = F.col("_block") % strips
    a = packed.select(group, strip.alias("i"), F.explode(F.sequence(strip, strips - 1)).alias("j"), F.col("_block").alias("p"), F.col("_rows").alias("a"))
    b = packed.select(group, strip.alias("j"), F.explode(F.sequence(F.lit(0), strip)).alias("i"), F.col("_block").alias("q"), F.col("_rows").alias("b"))

    def run(batches):
        for batch in batches:
            same = batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                cols = score(_block(batch.column(0)[i]), _block(batch.column(1)[i]), same[i])
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    # Blocks are few bytes for what their pairs cost, so partitions are not to be merged by size.
    met = a.repartition(tasks, group, "i", "j").hint("merge").join(b.repartition(tasks, group, "i", "j"), [group, "i", "j"]).where("i < j or p <= q")
    return met.select("a", "b", (F.col("p") == F.col("q")).alias("same")).mapInArrow(run, schema)


def unit(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def best_columns(scores: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of every row, compared to 9 digits, ties to the smaller id; only allowed cells."""
    rounded = np.round(scores, 9)
    order = np.argsort(ids, kind="stable")
    rounded = rounded[:, order]
    if allowed is not None:
        rounded = np.where(allowed[:, order], rounded, -np.inf)
    if 4 * k < rounded.shape[1]:
        return _few_best(rounded, order, k)
    take = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(scores)), take.shape[1])
    column = take.ravel()
    keep = np.isfinite(rounded[row, column])
    return row[keep], order[column[keep]]


def _few_best(rounded: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """best_columns for k well below the columns: only cells from each row's k-th largest on are sorted."""
    rounded = np.where(np.isfinite(rounded), rounded, -np.inf)
    least = np.partition(rounded, rounded.shape[1] - k, axis=1)[:, rounded.shape[1] - k]
    row, column = np.nonzero((rounded >= least[:, None]) & (rounded > -np.inf))
    by = np.lexsort((column, -rounded[row, column], row))
    row, column = row[by], column[by]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], order[column[keep]]
