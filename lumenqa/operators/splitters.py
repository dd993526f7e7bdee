"""Splitters of texts into pieces: by sentences, by a hierarchy of separators, by sentence windows and by blocks of pages.

A small helper finds the pieces' places in each text, Arrow batch by batch; Spark cuts them out. Pieces without overlap, put together, are the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A sentence: up to its closing marks and the white space behind them, or a line's end.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+[\"')\]]*(?=\s|$)\s*|\n\s*|[.!?]+)|[^.!?\n]+$")
SEPARATORS = ("\n\n", "\n", ". ", " ")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; together they are the whole text."""
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def _words(text: str) -> int:
    return len(text.split())


def _cut_words(text: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """A stretch in pieces of ``size`` words, each with the white space behind its last word."""
    ends = [start + m.end() for m in re.finditer(r"\s*\S+\s*", text[start:end])]
    marks = [start, *ends[size - 1 : -1 : size], end]
    yield from zip(marks, marks[1:])


def pack_sentences(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of whole sentences with up to ``size`` words; a longer sentence is cut between words.

    A piece starts with as many of the last sentences of the one before as have up to ``overlap`` words, if they leave room for the next sentence.
    """
    units = [u for a, b in sentences(text) for u in (_cut_words(text, a, b, size) if _words(text[a:b]) > size else [(a, b)])]
    sizes = [_words(text[a:b]) for a, b in units]
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > size:
            out.append((units[first][0], units[i - 1][1]))
            first, total = i, 0
            while first and total + sizes[first - 1] <= overlap and total + sizes[first - 1] + n <= size and units[first - 1][0] > out[-1][0]:
                first -= 1
                total += sizes[first]
        total += n
    if units:
        out.append((units[first][0], units[-1][1]))
    return out


def split_recursively(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of pieces of up to ``size`` characters: cut at the first separator of the list that the text has, what is still too long at the next ones, and neighbours joined again up to the size; without separators after ``size`` characters."""

    def parts(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        if b - a <= size:
            yield a, b
            return
        while level < len(separators) and text.find(separators[level], a, b) < 0:
            level += 1
        if level == len(separators):
            for s in range(a, b, size):
                yield s, min(b, s + size)
            return
        sep, start = separators[level], a
        run: tuple[int, int] | None = None
        while start < b:
            at = text.find(sep, start, b)
            end = b if at < 0 else at + len(sep)
            if run and end - run[0] <= size:
                run = (run[0], end)
            else:
                if run:
                    yield run
                run = None
                if end - start <= size:
                    run = (start, end)
                else:
                    yield from parts(start, end, level + 1)
            start = end
        if run:
            yield run

    return list(parts(0, len(text), 0)) if text else []


_BLOCK_TAG = re.compile(r"</?(?:address|article|aside|blockquote|body|br|div|dd|dl|dt|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]{0,2000}>", re.I)


def split_page(html: str, size: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of a page of up to ``size`` characters, cut before block tags where there are any near enough, never inside one that fits."""
    marks = sorted({0, len(html), *(m.start() for m in _BLOCK_TAG.finditer(html))})
    out: list[tuple[int, int]] = []
    for a, b in zip(marks, marks[1:]):
        if out and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b)
        elif b - a <= size:
            out.append((a, b))
        else:
            out += [(a + s, a + e) for s, e in split_recursively(html[a:b], size, (">", " "))]
    return out


#: Characters of pieces that a task holds before they go on.
HELD = 1 << 20


def _pieces(docs: DataFrame, place: Callable[[str], list[tuple[int, int]]], key: str, text: str) -> DataFrame:
    """(key, chunk, start, text): chunk from 0 and the piece's first character; null and empty texts have none."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(c, t) for c, t in (("chunk", T.IntegerType()), ("start", T.LongType()), ("text", T.StringType())))])

    most = HELD

    def run(batches):
        for batch in batches:
            rows, chunk, start, piece, held = [], [], [], [], 0

            def made():
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(chunk, pa.int32()), pa.array(start, pa.int64()), pa.array(piece, pa.string())], [key, "chunk", "start", "text"])

            for i, value in enumerate(batch.column(1)):
                whole = value.as_py() or ""
                for k, (a, b) in enumerate(place(whole)):
                    rows.append(i)
                    chunk.append(k)
                    start.append(a)
                    piece.append(whole[a:b])
                held += len(whole)
                if held >= most:
                    yield made()
                    rows, chunk, start, piece, held = [], [], [], [], 0
            if rows:
                yield made()

    return docs.select(key, text).mapInArrow(run, schema)


def chunk_sentences(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, start, text) of pack_sentences()."""
    return _pieces(docs, lambda t: pack_sentences(t, size, overlap), key, text)


def chunk_recursively(docs: DataFrame, size: int, separators: tuple[str, ...] = SEPARATORS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, start, text) of split_recursively()."""
    return _pieces(docs, lambda t: split_recursively(t, size, separators), key, text)


def chunk_pages(pages: DataFrame, size: int, key: str = "page_id", text: str = "html") -> DataFrame:
    """(key, chunk, start, text) of split_page()."""
    return _pieces(pages, lambda t: split_page(t, size), key, text)


def sentence_windows(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, start, text, window): each sentence, and the text of it with those up to k before and after."""
    rows = _pieces(docs, sentences, key, text)
    around = Window.partitionBy(key).orderBy("start").rowsBetween(-k, k)
    return rows.withColumn("window", F.array_join(F.collect_list("text").over(around), ""))
