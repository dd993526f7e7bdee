"""Operator 3: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds its letters' vectors, each rotated by its place, by
multiplication; a text bundles (adds) the vectors of its n-grams; a language's prototype bundles its training texts.
A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, map_batches
from .words import mix

UNKNOWN = "und"
#: Distinct n-grams whose vectors are made at once, and characters of a long text that are counted at once.
GRAMS = 2048
PART = 200_000
#: Labels whose shares are broadcast; beyond it, they are joined by a shuffle.
MAX_SENT_LABELS = 100_000


@dataclass(frozen=True)
class LanguageParams:
    """max_train_rows bounds the labelled rows of each language that are learned from (a sample by hash of doc_id)."""

    dims: int = 1024
    gram: int = 3
    seed: int = 20
    max_train_rows: int = 10_000


def letter_vectors(points: np.ndarray, p: LanguageParams) -> np.ndarray:
    """One row of +1 and -1 for each code point, from its number and the seed alone."""
    with np.errstate(over="ignore"):
        words = mix((points.astype(np.uint64)[:, None] << np.uint64(16)) + np.arange(p.dims // 64, dtype=np.uint64) + (np.uint64(p.seed) << np.uint64(48)))
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return (bits.astype(np.int8) * 2 - 1).reshape(len(points), p.dims)


def _distinct(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with its inverse, by a table over the code points."""
    present = np.zeros(int(points.max()) + 1 if len(points) else 0, bool)
    present[points] = True
    return np.flatnonzero(present).astype(np.uint32), (np.cumsum(present, dtype=np.int32) - 1)[points]


def _codes(texts: list[str | None], at_start: bool = True, was_letter: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(code points, the text of each, has a letter, whether the last one was a letter) of lower-case texts.

    Whatever is no letter becomes one blank between runs of letters. A text that is one part of a longer one starts after
    a letter or not, as the part before it ended.
    """
    parts = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    points, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    kinds, code = _distinct(points)
    solid = np.array([chr(c).isalpha() for c in kinds], bool)[code]
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first blank after a run
    firsts = np.concatenate(([0], np.cumsum([len(x) for x in parts])[:-1]))
    firsts = firsts[firsts < len(keep)]
    keep[firsts] = True if at_start else solid[firsts] | was_letter
    has = np.zeros(len(parts), bool)
    has[np.unique(owner[solid])] = True
    return np.where(solid, points, 32)[keep].astype(np.uint32), owner[keep], has, bool(solid[-1]) if len(solid) else was_letter


def _bundle(points: np.ndarray, owner: np.ndarray, texts: int, p: LanguageParams) -> np.ndarray:
    """The sums of the vectors of all n-grams of points that lie within one text, GRAMS distinct n-grams at a time: exact integers as float64."""
    out = np.zeros((texts, p.dims), np.float64)
    alphabet, code = _distinct(points)
    n = max(0, len(code) - p.gram + 1)
    key, size = np.zeros(n, np.int64), len(alphabet)
    for i in range(p.gram):
        key = key * size + code[i : i + n]
    inside = owner[:n] == owner[p.gram - 1 : p.gram - 1 + n]
    key, own = key[inside], owner[:n][inside]
    if not len(key):
        return out
    if size**p.gram <= 1 << 22:
        present = np.zeros(size**p.gram, bool)
        present[key] = True
        grams = np.flatnonzero(present)
        column = np.cumsum(present, dtype=np.int32)[key] - 1
    else:
        grams, column = np.unique(key, return_inverse=True)
    if len(grams) > GRAMS:
        order = np.argsort(column, kind="stable")
        column, own = column[order], own[order]
    ends = np.searchsorted(column, np.arange(GRAMS, len(grams) + GRAMS, GRAMS)) if len(grams) > GRAMS else [len(column)]
    start = 0
    for low, end in zip(range(0, len(grams), GRAMS), ends):
        some = grams[low : low + GRAMS]
        counts = np.bincount(own[start:end] * len(some) + (column[start:end] - low), minlength=texts * len(some)).reshape(texts, -1)
        places = np.stack([some // size ** (p.gram - 1 - i) % size for i in range(p.gram)], 1)
        letters, at = np.unique(places, return_inverse=True)
        at, table = at.reshape(places.shape), letter_vectors(alphabet[letters], p)
        bound = np.ones((len(some), p.dims), np.int8)
        for i in range(p.gram):
            bound *= np.roll(table, p.gram - 1 - i, axis=1)[at[:, i]]
        # float32 sums are exact up to 2**24; longer texts are added in float64
        kind = np.float32 if counts.sum(1).max() < 1 << 24 else np.float64
        out += counts.astype(kind) @ bound.astype(kind)
        start = end
    return out


def bundles(texts: list[str | None], p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """(has a letter, vectors): exact integers as float64, one row a text; a text starts and ends with a blank.

    A text of over PART characters is added up part by part, each with the last gram - 1 characters of the one before.
    """
    lower = [" " + (t or "").lower() + " " for t in texts]
    has, out = np.zeros(len(texts), bool), np.zeros((len(texts), p.dims), np.float64)
    short = [i for i, t in enumerate(lower) if len(t) <= PART]
    if short:
        points, owner, has[short], _ = _codes([lower[i] for i in short])
        out[short] = _bundle(points, owner, len(short), p)
    for i in (i for i, t in enumerate(lower) if len(t) > PART):
        carried, letter = np.zeros(0, np.uint32), False
        for start in range(0, len(lower[i]), PART):
            points, _, some, letter = _codes([lower[i][start : start + PART]], start == 0, letter)
            points = np.concatenate((carried, points))
            has[i] |= some[0]
            out[i] += _bundle(points, np.zeros(len(points), np.int64), 1, p)[0]
            carried = points[-(p.gram - 1) :] if p.gram > 1 else carried
    return has, out


def _pieces(column: pa.Array, budget: int = 200_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows of about as many characters in all, so that a batch of long texts stays small."""
    start, held, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py()
        held.append(text)
        size += len(text or "")
        if size >= budget or len(held) >= 256:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


@dataclass(frozen=True)
class LanguageModel:
    params: LanguageParams
    labels: list[str] = field(default_factory=list)
    prototypes: np.ndarray | None = None  # unit rows, one a label

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A text that is null or has no letter, and any text when nothing was learned, gets UNKNOWN and 0."""
        has, vectors = bundles(texts, self.params)
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        norms = np.linalg.norm(vectors, axis=1)
        cosines = vectors @ self.prototypes.T / np.where(norms > 0, norms, 1)[:, None]
        best = cosines.argmax(1)
        score = np.where(has, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.labels[b] if h else UNKNOWN for b, h in zip(best, has)], score


def train(labelled: DataFrame, p: LanguageParams = LanguageParams(), key: str = "doc_id") -> LanguageModel:
    """Prototypes from labelled(key, text, lang), null labels left out; sums are exact, so any partitioning gives the same.

    A null key is drawn by its text instead, null texts add nothing, repeated rows count as often as they occur, and an empty
    table gives a model without labels. The model holds dims numbers a label, whatever the number of rows.
    """
    rows = labelled.where("lang is not null")
    shares = rows.groupBy("lang").agg((F.lit(float(p.max_train_rows)) / F.count(F.lit(1))).alias("_share")).withColumnRenamed("lang", "_lang")
    shares = cut(shares)
    labels = shares.count()
    if not labels:
        return LanguageModel(p)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), "text"), F.lit(p.seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.select(F.col("text"), F.col("lang"), draw.alias("_draw")).join(F.broadcast(shares) if labels <= MAX_SENT_LABELS else shares, F.col("lang") == F.col("_lang"))
    rows = rows.where("_draw < _share")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for start, texts in _pieces(batch.column(0)):
                vectors = bundles(texts, p)[1]
                for name in set(names[start : start + len(texts)]):
                    mine = [i for i in range(len(texts)) if names[start + i] == name]
                    sums[name] = sums.get(name, 0) + vectors[mine].sum(0)
        if sums:
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(sums), p.dims).tolist()), pa.array(np.tile(np.arange(p.dims), n)), pa.array(np.concatenate(list(sums.values())).astype(np.int64))], ["lang", "dim", "total"])

    totals = map_batches(rows.select("text", "lang"), run, "lang string, dim long, total long").groupBy("lang", "dim").agg(F.sum("total").alias("total"))
    table = totals.toArrow()
    labels = sorted(set(table["lang"].to_pylist()))
    matrix = np.zeros((len(labels), p.dims))
    row = np.searchsorted(labels, table["lang"].to_pylist())
    matrix[row, table["dim"].to_numpy()] = table["total"].to_numpy()
    norms = np.linalg.norm(matrix, axis=1)
    learned = norms > 0
    return LanguageModel(p, [x for x, ok in zip(labels, learned) if ok], matrix[learned] / norms[learned][:, None])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score added; columns that have these names, in any case, are replaced.

    Reads nothing of a row but its text. A null, empty or letterless text gets UNKNOWN and 0, as does every text if
    nothing was learned; of languages that are equally near the first by name wins. Texts of any length are taken whole,
    repeated rows are alike, an empty table gives no rows.
    """
    clash = [c for c in docs.columns if c.lower() in ("lang_pred", "lang_score")]
    docs = docs.drop(*clash)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.prototypes))
    at, p = docs.columns.index(text), model.params

    def run(batches):
        known = LanguageModel(p, *sent.value)
        for batch in batches:
            labels, scores = [], []
            for _, texts in _pieces(batch.column(at)):
                a, b = known.predict(texts)
                labels += a
                scores.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names)

    names = schema.names
    return map_batches(docs, run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, p: LanguageParams = LanguageParams()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text, lang, ...), repeated rows included.

    Learns from rows that aren't held out. A null doc_id counts as not held out; null and letterless texts get ``und`` and
    0; texts of any length are taken whole; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(rows.where("not held_out"), p)
    out = predict(rows.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
