"""Parsing and formatting expressions: ids, insights, labels, templates, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the definition, tried in order.
_ID_MARKS = (r"(?i)doc_id:\s*(\S+)", r"(?i)id:\s*(\S+)", r"(?i)source:\s*(\S+)", r"(?i)document:\s*(\S+)")
_NUMBERED = (r"(?i)^\d+\.\s*(.+)", r"(?i)^\d+\)\s*(.+)", r"(?i)^\(\d+\)\s*(.+)", r"(?i)^\d+\s*-\s*(.+)", r"(?i)^\d+:\s*(.+)", r"(?i)^\[\w+.*?\]\s*(.+)")
_QUESTION_WORDS = ("what", "how", "why", "when", "where")
_ACTIONS = ("recommend", "suggest", "should", "improve", "optimize", "consider")
_NO_ADVICE = "Continue monitoring performance and consider parameter fine-tuning based on query patterns."
_NO_TITLE = "RAG Configuration Analysis"


def document_id(context: Column) -> Column:
    """The id that a context names after one of four marks, or its first line if that is a path of a pdf or txt file; else empty."""
    first = F.trim(F.split(context, "\n")[0])
    path = F.contains(first, F.lit("/")) & (F.contains(first, F.lit("pdf")) | F.contains(first, F.lit("txt")))
    out = F.when(path, first).otherwise("")
    for mark in reversed(_ID_MARKS):
        out = F.when(context.rlike(mark), F.regexp_extract(context, mark, 1)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def sub_queries(text: Column) -> Column:
    """Entries of a list numbered in one of six ways, and lines of over ten characters that look like a question; those of over five characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def entry(line: Column) -> Column:
        low = F.lower(line)
        asks = F.contains(line, F.lit("?")) | F.endswith(line, F.lit("."))
        for w in _QUESTION_WORDS:
            asks = asks | F.contains(low, F.lit(w))
        out = F.when((F.char_length(line) > 10) & asks, line)
        for pattern in reversed(_NUMBERED):
            out = F.when(line.rlike(pattern), F.trim(F.regexp_extract(line, pattern, 1))).otherwise(out)
        return out

    return F.filter(F.transform(lines, entry), lambda x: x.isNotNull() & (F.char_length(x) > 5))


def insight_confidence(text: Column) -> Column:
    """0.9, 0.6 or 0.75 for the first of High, Low and Medium that the text has, else 0.8."""
    has = lambda w: F.contains(text, F.lit(w))
    return F.when(has("High"), 0.9).when(has("Low"), 0.6).when(has("Medium"), 0.75).otherwise(0.8)


def insight_title(text: Column) -> Column:
    """From the first of the first five lines that starts with **Title (what follows its colon) or has the word and under 100 characters."""
    lines = F.slice(F.split(F.trim(text), "\n"), 1, 5)
    marked = lambda x: F.startswith(F.trim(x), F.lit("**Title")) & (F.size(F.split(x, ":")) > 1)
    plain = lambda x: ~F.startswith(F.trim(x), F.lit("**Title")) & F.contains(F.lower(x), F.lit("title")) & (F.char_length(F.trim(x)) < 100)
    found = F.try_element_at(F.filter(lines, lambda x: marked(x) | plain(x)), F.lit(1))
    bare = F.trim(F.regexp_replace(F.trim(F.try_element_at(F.split(found, ":"), F.lit(2))), r"^\*+|\*+$", ""))
    return F.when(found.isNull(), _NO_TITLE).when(marked(found), bare).otherwise(F.trim(found))


def recommendations(text: Column) -> Column:
    """At most three bullets that follow a line with "recommendation" and a colon, else the first line with a word of advice (200 characters), else a fixed sentence."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    starts = lambda x: F.contains(F.lower(x), F.lit("recommendation")) & F.contains(x, F.lit(":"))
    state = F.struct(F.lit(0).alias("inside"), F.array().cast("array<string>").alias("out"))  # 0 before, 1 in the section, 2 after it

    def step(s: Column, x: Column) -> Column:
        bullet = (s["inside"] == 1) & F.startswith(x, F.lit("-"))
        ends = (s["inside"] == 1) & (x != "") & ~F.startswith(x, F.lit("-"))
        inside = F.when(s["inside"] == 2, 2).when(starts(x), 1).when(ends, 2).otherwise(s["inside"])
        out = F.when((s["inside"] != 2) & ~starts(x) & bullet, F.concat(s["out"], F.array(F.trim(F.substring(x, 2, 1_000_000))))).otherwise(s["out"])
        return F.struct(inside.alias("inside"), out.alias("out"))

    bullets = F.aggregate(lines, state, step)["out"]
    advice = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike("|".join(_ACTIONS)))
    other = F.when(F.size(advice) > 0, F.substring(F.trim(F.try_element_at(advice, F.lit(1))), 1, 200)).otherwise(_NO_ADVICE)
    return F.when(F.size(bullets) > 0, F.array_join(F.slice(bullets, 1, 3), "; ")).otherwise(other)


def truncate_label(label: Column, limit: int = 30) -> Column:
    """Over the limit: the last part of a path, then both ends around an ellipsis."""
    last = F.when((F.char_length(label) > limit) & F.contains(label, F.lit("/")), F.substring_index(label, "/", -1)).otherwise(label)
    part = (limit - 3) // 2
    return F.when(F.char_length(last) > limit, F.concat(F.substring(last, 1, part), F.lit("..."), F.right(last, F.lit(part)))).otherwise(last)


def short_id(canonical: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of the md5 of a canonical text."""
    return F.substring(F.md5(canonical.cast("binary")), 1, digits)


def canonical_json(fields: dict[str, Column]) -> Column:
    """The JSON text of string fields in the order of their names, a blank after each comma and colon."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    parts = [F.concat(F.lit(f'"{k}": '), quoted(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} replaced by each value; what a value holds is not replaced again if names come in order."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
