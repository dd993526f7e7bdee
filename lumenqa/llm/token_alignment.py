"""Operator 11: alignment of two tokenizers' tokens by the bytes they cover.

Inside mapInPandas, a two-pointer merge of both sides' cumulative token ends emits links (tokens whose byte ranges overlap) and
groups (cut where both sides end). Spark then counts in how many documents a pair of ids is linked, finds each left id's
highest count, and joins both back to every document's links.

Texts are cut at single spaces between other characters. The left pattern starts a new run there, and no piece of the right
vocabulary has its space mark after another character, so neither side's tokens cross such a cut and segments can be
encoded and merged on their own; a task remembers those it has seen.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, map_frames, remove, write_out

LEFT = "/opt/tokenizers/byte_bpe_50k.json"
RIGHT = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the runs of text within which the byte-level vocabulary's merges stay.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Right ids are below this; a pair is left * WIDTH + right.
WIDTH = 1 << 15
#: Segments whose merges a task remembers; all are forgotten at once beyond it.
REMEMBERED = 400_000
#: Characters of unseen segments that are encoded as one text.
RUN = 20_000
#: Characters of a text that are merged at once, up to the next cut.
SLICE = 1 << 20
#: Pair counts that are broadcast; beyond it, they are joined by a shuffle.
MAX_SENT_PAIRS = 2_000_000
ALIGNED = "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
_CUT = re.compile(r"(?<=[^\s\x00-\x1f\x7f-\x9f]) (?=[^\s\x00-\x1f\x7f-\x9f])")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def left_vocabulary(path: str = LEFT) -> dict[bytes, int]:
    """Bytes of each entry of a byte-level BPE file whose ids are in the order of its merges, without special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, alphabet = {t["content"] for t in spec["added_tokens"]}, byte_alphabet()
    return {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}


def right_pieces(model) -> list[bytes]:
    """Bytes of each piece: the space mark as a space, byte pieces as their byte."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


def merge(a: list[int], b: list[int], len_a: dict, len_b: list, ends: list[int]) -> list[tuple[list[int], int, int, list[str]]]:
    """(pairs of all links, left tokens, right tokens, groups) of each stretch up to the given byte ends, from two token lists that cover the same bytes.

    The side that ends first moves on; where both end, a group is complete, and a stretch if it ends there too.
    """
    out, links, groups, i, j, from_a, from_b, low_a, low_b, k = [], [], [], 0, 0, 0, 0, 0, 0, 0
    said_a, said_b = list(map(str, a)), list(map(str, b))
    end_a, end_b, end, n = len_a[a[0]], len_b[b[0]], ends[0], len(a)
    while True:
        links.append(a[i] * WIDTH + b[j])
        if end_a == end_b:
            i += 1
            j += 1
            groups.append(f"{','.join(said_a[from_a:i])}|{','.join(said_b[from_b:j])}")
            if end_a == end:
                out.append((links, i - low_a, j - low_b, groups))
                if i == n:
                    return out
                links, groups, low_a, low_b, k = [], [], i, j, k + 1
                end = ends[k]
            from_a, from_b = i, j
            end_a += len_a[a[i]]
            end_b += len_b[b[j]]
        elif end_a < end_b:
            i += 1
            end_a += len_a[a[i]]
        else:
            j += 1
            end_b += len_b[b[j]]


class Aligner:
    """Encodes segments on both sides and merges them; remembers each segment's links, counts and groups."""

    def __init__(self, left: str = LEFT, right: str = RIGHT, remembered: int = REMEMBERED):
        import sentencepiece
        import tiktoken

        vocabulary = left_vocabulary(left)
        self.left = tiktoken.Encoding("left", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        self.bytes_a, self.bytes_b = {i: x for x, i in vocabulary.items()}, right_pieces(self.right)
        if len(self.bytes_b) > WIDTH or max(vocabulary.values()) >= (1 << 31) // WIDTH:
            raise ValueError("ids too large for a pair to be a 32-bit number")
        if any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.bytes_b):
            raise ValueError("a right piece holds a space after another character")
        self.len_a, self.len_b = {i: len(x) for i, x in self.bytes_a.items()}, [len(x) for x in self.bytes_b]
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.said: list[str] = []
        self.counts = np.zeros((0, 4), np.int32)  # tokens left, right, groups, links; -1 where the sides differ
        self.start = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int32)

    def _merged(self, segments: list[str]) -> list | None:
        """merge() of segments that a single space parts, encoded as one text; None if a side doesn't give back its bytes."""
        text = " ".join(segments)
        whole = (" " + text).encode()
        a, b = self.left.encode_ordinary(" " + text), self.right.encode(text)
        if not b or b"".join(map(self.bytes_b.__getitem__, b)) != whole or b"".join(map(self.bytes_a.__getitem__, a)) != whole:
            return None
        ends = np.cumsum([len(s.encode()) + 1 for s in segments]).tolist()
        return merge(a, b, self.len_a, self.len_b, ends)

    def _learn(self, segments: list[str]) -> None:
        """Merge unseen segments, RUN characters at once where both ends are such that a cut can stand there, and one by one else."""
        plain = [bool(s) and s[0] != " " and s[-1] != " " and s[0].isprintable() and s[-1].isprintable() for s in segments]
        joined, run, size = [], [], 0
        for s, fits in zip(segments, plain):
            if fits:
                run.append(s)
                size += len(s)
            if size >= RUN:
                joined.append(run)
                run, size = [], 0
        joined += [run] if run else []
        joined += [[s] for s, fits in zip(segments, plain) if not fits]
        order, counts, links = [], [], []
        for run in joined:
            found = self._merged(run)
            if found is None:
                found = [((x := self._merged([s])) and x[0]) or None for s in run]
            order += run
            for one in found:
                if one is None:
                    counts.append((-1, -1, -1, 0))
                    self.said.append("")
                else:
                    pairs, n_a, n_b, groups = one
                    counts.append((n_a, n_b, len(groups), len(pairs)))
                    links += pairs
                    self.said.append(";".join(groups))
        n = len(self.place)
        self.place.update(zip(order, range(n, n + len(order))))
        fresh = np.array(counts, np.int32).reshape(-1, 4)
        self.counts = np.concatenate((self.counts, fresh))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(fresh[:, 3], dtype=np.int64)))
        self.links = np.concatenate((self.links, np.array(links, np.int32)))

    def align_all(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """align() of each text in order; unseen segments of many texts are merged together."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= SLICE:
                yield from self._told(held)
                held, size = [], 0
        yield from self._told(held)

    def _told(self, texts: list[str]) -> Iterator[tuple]:
        short = [_CUT.split(t) if 0 < len(t) <= SLICE else [] for t in texts]
        self._know(itertools.chain.from_iterable(short))
        for text, segments in zip(texts, short):
            yield self.align(text, segments)

    def _know(self, segments: Iterable[str]) -> None:
        every = dict.fromkeys(segments)
        unseen = [s for s in every if s not in self.place]
        if unseen and len(self.said) + len(unseen) > self.remembered:
            self._forget()
            unseen = list(every)
        if unseen:
            self._learn(unseen)

    def align(self, text: str | None, segments: list[str] | None = None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """(tokens left, right, groups, links, digest of the groups, distinct pairs, their links); zeros and '' without tokens.

        segments: those of the whole text, if they are known already; else the text is taken slice by slice.
        """
        counts, digest, pairs, times = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for i, own in enumerate([segments] if segments else map(_CUT.split, slices(text or ""))):
            if not segments:
                self._know(own)
            at = np.array([self.place[s] for s in own], np.int64)
            if (self.counts[at, 0] < 0).any():
                counts[:] = 0
                break
            counts += self.counts[at].sum(0)
            said = self.said
            digest.update((b";" if i else b"") + ";".join([said[n] for n in at.tolist()]).encode())
            kinds, often = np.unique(at, return_counts=True)
            sizes = self.counts[kinds, 3].astype(np.int64)
            flat = np.repeat(self.start[kinds] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            values, back = np.unique(np.concatenate((pairs, self.links[flat])), return_inverse=True)
            times = np.bincount(back, weights=np.concatenate((times, np.repeat(often, sizes))), minlength=len(values)).astype(np.int64)
            pairs = values
        if not counts[0]:
            return 0, 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int32)
        return *counts.tolist(), digest.hexdigest(), pairs, times.astype(np.int32)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices of about ``size`` characters, cut where neither side's tokens cross; the space of a cut belongs to no slice."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.end()
    if start < len(text):
        yield text[start:]


def _aligned(docs: DataFrame, left: str, right: str) -> DataFrame:
    def run(frames):
        aligner = Aligner(left, right)
        for frame in frames:
            rows = list(aligner.align_all(t if isinstance(t, str) else None for t in frame["text"]))
            out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            out.insert(0, "row", frame["row"].to_numpy())
            out.insert(1, "doc_id", frame["doc_id"])
            yield out

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")  # a null in a whole column of pandas would make floats
    return map_frames(rows, run, ALIGNED)


def align_tokens(docs: DataFrame, left: str = LEFT, right: str = RIGHT, sent_pairs: int = MAX_SENT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs(doc_id, text, ...).

    left: a byte-level BPE file; right: a sentencepiece model that puts a space before the text. Null and empty texts, and
    those whose pieces don't give back the text's bytes on both sides, have zeros and an empty digest. Rows are counted as documents, whatever their
    id: a null or repeated doc_id stays as it is, repeated rows are counted as often as they occur. Texts of any length are merged whole, in slices; ties for the
    highest count are all best; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    aligned, aligned_at = write_out(_aligned(docs, left, right))
    counts, counts_at = write_out(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("size")))
    best = counts.groupBy(F.floor(F.col("pair") / WIDTH).alias("a")).agg(F.max("size").alias("most"))
    judged = counts.withColumn("a", F.floor(F.col("pair") / WIDTH)).join(best, "a")
    judged = judged.select("pair", "size", F.col("size").alias("docs"), (F.col("size") == F.col("most")).cast("long").alias("best"))
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").cast("long").alias("times"))
    if counts.count() <= sent_pairs:
        told = links.join(F.broadcast(judged), "pair")
    else:
        total = counts.agg(F.sum("size")).first()[0]
        told = join_hot(links, judged, "pair", total)
    sums = told.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    whole = aligned.drop("pairs", "times").join(sums, "row", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out, _ = write_out(whole.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256"))
    for folder in (aligned_at, counts_at):
        remove(spark, folder)
    return out
