"""Operator 4: chat formatting by columnar byte assembly.

A turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. In roles and texts every ``<`` and ``[`` gets a backslash after it, so no control
string of this or other templates is left in them, and taking away one backslash after each ``<`` and ``[`` restores them; a line
feed in a role is written ``[n``. The loss mask covers assistant texts.

Turns come in the order of (conv_id, turn, role, text) and are assembled batch by batch: segment lengths give offsets, offsets
give scatter indices, and headers and contents are copied into one preallocated buffer that becomes the Arrow column. A
conversation is a sequence of pieces, so one of any length needs the memory of a batch only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, partitions

START, END = b"<|im_start|>", b"<|im_end|>\n"
PIECES = "conv_id long, piece long, formatted string, mask_start array<long>, mask_end array<long>, last boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_MARKED = np.zeros(256, bool)
_MARKED[[ord("<"), ord("[")]] = True


def _column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = values.cast(pa.large_string()).fill_null("")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def escape_column(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a backslash after each marked byte; neither byte is part of a longer UTF-8 sequence."""
    marked = _MARKED[raw]
    before = np.concatenate(([0], np.cumsum(marked)))
    out = np.full(len(raw) + before[-1], ord("\\"), np.uint8)
    out[np.arange(len(raw)) + before[:-1]] = raw
    return out, offsets + before[offsets]


def _copy(out: np.ndarray, to: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
    """Scatter the segments of raw to the places ``to`` in out."""
    out[np.arange(len(raw)) + np.repeat(to - offsets[:-1], np.diff(offsets))] = raw


def escape(text: str) -> str:
    return text.replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return text.replace("<\\", "<").replace("[\\", "[")


def assemble(role: pa.Array, text: pa.Array, bounds: np.ndarray) -> tuple[pa.Array, list[list[int]], list[list[int]]]:
    """(formatted column, mask starts, mask ends in code points), one value for each run bounds[i]:bounds[i+1] of turns."""
    raw_role, at_role = escape_column(*_column(role))
    if (raw_role == 10).any():  # rare: a line feed becomes two bytes
        names = [escape(x or "").replace("\n", "[n").encode() for x in role.to_pylist()]
        raw_role, at_role = np.frombuffer(b"".join(names), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in names])))
    raw_text, at_text = escape_column(*_column(text))
    lengths = np.stack([np.full(len(role), len(START)), np.diff(at_role), np.ones(len(role), np.int64), np.diff(at_text), np.full(len(role), len(END))], 1)
    places = np.concatenate(([0], np.cumsum(lengths.ravel())))
    out = np.empty(places[-1], np.uint8)
    begin = places[:-1].reshape(-1, 5)
    fixed = lambda s: np.frombuffer(s, np.uint8)
    out[begin[:, :1] + np.arange(len(START))] = fixed(START)
    _copy(out, begin[:, 1], raw_role, at_role)
    out[begin[:, 2]] = 10
    _copy(out, begin[:, 3], raw_text, at_text)
    out[begin[:, 4:] + np.arange(len(END))] = fixed(END)
    cuts = np.concatenate((begin[:, 0], places[-1:]))[bounds]
    column = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(out))
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))  # code points before each byte
    told = pc.equal(role, "assistant").fill_null(False).to_numpy(zero_copy_only=False)
    run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts, ends = (points[begin[:, i]] - points[cuts[run]] for i in (3, 4))
    per = lambda x: [x[a:b][told[a:b]].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return column, per(starts), per(ends)


def format_chats(turns: DataFrame) -> DataFrame:
    """Pieces (conv_id, piece, formatted, mask_start, mask_end, last) of turns(conv_id, turn, role, text, ...), in order within partitions.

    A conversation is the pieces of its conv_id joined in order (null ids are one conversation). A null role or text counts as
    empty; equal turns are ordered by role, then text; repeated rows are repeated turns. Mask positions count code points of the piece. An empty table gives no
    pieces; other columns are not read.
    """

    def run(batches):
        held = None  # the last piece, kept back until its conversation is known to go on or to end
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.concatenate(([True], (plain[1:] != plain[:-1]) | (null[1:] != null[:-1]))))
            bounds = np.concatenate((new, [len(plain)]))
            texts, starts, ends = assemble(batch.column(1), batch.column(2), bounds)
            rows = [[ids[int(i)].as_py(), 0, texts[k].as_py(), starts[k], ends[k], True] for k, i in enumerate(new)]
            if held:
                if held[0] == rows[0][0]:
                    held[5], rows[0][1] = False, held[1] + 1
                rows.insert(0, held)
            held = rows.pop()
            yield _rows(rows)
        if held:
            yield _rows([held])

    dealt = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition(partitions(turns.sparkSession), "conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return map_batches(ordered, run, PIECES)


def _rows(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
    cols = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "piece", "formatted", "mask_start", "mask_end", "last"])


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a piece: the inverse of formatting."""
    out = []
    for turn in formatted.split(START.decode())[1:]:
        role, _, text = turn.removesuffix(END.decode()).partition("\n")
        out.append((unescape(role.replace("[n", "\n")), unescape(text)))
    return out


def digest_chats(pieces: DataFrame) -> DataFrame:
    """One row a conversation, read back from its pieces as format_chats left them: turns, digests of turns and of what the mask covers, lengths.

    A conversation of empty turns has the digests of what they hold; no pieces give no rows.
    """

    def run(batches):
        state = None
        for batch in batches:
            rows = []
            for piece in batch.to_pylist():
                if piece["piece"] == 0:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_turns(piece["formatted"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for a, b in zip(piece["mask_start"], piece["mask_end"]):
                    text = unescape(piece["formatted"][a:b])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(piece["formatted"])
                if piece["last"]:
                    rows.append((piece["conv_id"], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_batches(pieces, run, DIGEST)
