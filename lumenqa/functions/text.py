"""Text and answer-metric expressions: built-in functions only, so they stay inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .lambdas import let

_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def normalize(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, then articles blanked, then white space collapsed."""
    bare = F.regexp_replace(F.lower(text), _PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Words of the normalised text; none for null and empty ones."""
    return F.filter(F.split(F.coalesce(normalize(text), F.lit("")), " "), lambda x: x != "")


def clean_answer(text: Column) -> Column:
    """Cut what follows a blank line, a rule or an explanation; strip blanks, full stops and one pair of quotes."""
    cut = F.regexp_replace(text, r"(?is)(\n\n|\n-|\n(Explanation|Reasoning|Context|Question):).*$", "")
    blank = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    stripped = F.regexp_replace(blank(cut), r"\.+$", "")
    return blank(F.regexp_replace(stripped, "(?s)^([\"'])(.*)\\1$", "$2"))


# Answer marks, tried in order.
_MARKS = ("Answer:", "答案:", "A:", "回答:")


def _after_mark(text: Column, found: str, other: Column, flags: str = "") -> Column:
    """What the pattern ``found`` takes after the first mark that text has, or another value."""
    out = other
    for mark in reversed(_MARKS):
        pattern = f"(?i{flags}){mark}{found}"
        out = F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1))).otherwise(out)
    return F.when(text.rlike(f"(?i){'|'.join(_MARKS)}"), out).otherwise(other)  # most texts have none


def extract_answer(text: Column) -> Column:
    """What follows the first answer mark (marks tried in order), cleaned; the whole text if there is none; null stays null.

    Of a completion object, the answer is the rest of a sentence in its text field.
    """
    field, quoted = r"(?s)text=[\"']([^\"']*)[\"']", r'(?s)text="((?:[^"\\]|\\.)*)"'
    inner = F.regexp_extract(text, field, 1)
    sentence = clean_answer(_after_mark(inner, r"\s*(.*?)(?=\.|$)", inner).cast("string"))
    whole = _after_mark(text, r"\s*(.*)", F.when(F.contains(text, F.lit('text="')) & text.rlike(quoted), F.trim(F.regexp_extract(text, quoted, 1))).otherwise(F.trim(text)), "s")
    whole = clean_answer(F.trim(F.regexp_replace(whole, r"(?s), additional_kwargs=.*$", "")))
    return F.when(F.contains(text, F.lit("CompletionResponse")) & text.rlike(field), sentence).otherwise(whole)


def exact_match(prediction: Column, gold: Column) -> Column:
    """1 if the answer extracted from the prediction equals the gold one, both normalised."""
    return (normalize(extract_answer(prediction)) == normalize(gold)).cast("double")


def overlap_size(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays: both sorted together, so equal words are neighbours and are counted in one pass."""
    one = lambda xs, p: F.transform(xs, lambda x: F.struct(x.alias("w"), F.lit(p).alias("p"), F.lit(1 - p).alias("g")))
    merged = F.array_sort(F.concat(one(a, 1), one(b, 0)))
    state = lambda w, p, g, n: F.struct(w.alias("w"), p.alias("p"), g.alias("g"), n.alias("n"))

    def step(s: Column, x: Column) -> Column:
        same = s["w"] == x["w"]
        kept = lambda c: F.when(same, s[c]).otherwise(0) + x[c]
        return state(x["w"], kept("p"), kept("g"), s["n"] + F.when(same, 0).otherwise(F.least(s["p"], s["g"])))

    return F.aggregate(merged, state(F.lit(""), F.lit(0), F.lit(0), F.lit(0)), step, lambda s: s["n"] + F.least(s["p"], s["g"]))


def token_f1(prediction: Column, gold: Column) -> Column:
    """Harmonic mean of multiset precision and recall of the answer extracted from the prediction; both empty: 1, one empty: 0."""

    def f1(p: Column, g: Column) -> Column:
        whole = F.size(p) + F.size(g)
        return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * overlap_size(p, g) / whole)

    return let(tokens(extract_answer(prediction)), lambda p: let(tokens(gold), lambda g: f1(p, g)))


def coverage(prediction: Column, gold: Column) -> Column:
    """1 if all gold words occur in the prediction; 0 for an empty gold."""
    g = tokens(gold)
    return F.when(F.size(g) == 0, 0.0).otherwise((F.size(F.array_except(g, tokens(prediction))) == 0).cast("double"))


def faithfulness(prediction: Column, context: Column) -> Column:
    """Share of the prediction's distinct words that the context holds; 0 without words."""
    p = F.array_distinct(tokens(prediction))
    return F.when(F.size(p) == 0, 0.0).otherwise(F.size(F.array_intersect(p, tokens(context))) / F.size(p))


def jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def text_likeness(a: Column, b: Column) -> Column:
    """Jaccard of normalised word sets; 0 if a raw text is empty."""
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(jaccard(a, b))


def reciprocal_rank(contexts: Column, gold: Column, gold_texts: Column) -> Column:
    """1 over the rank of the first context that names a gold id, is over 0.8 like a gold text, or holds a gold entry; else 0."""
    from .parsing import document_id

    def hit(c: Column) -> Column:
        by_id = (document_id(c) != "") & F.array_contains(gold, document_id(c))
        return by_id | F.exists(gold_texts, lambda g: text_likeness(c, g) > 0.8) | F.exists(gold, lambda g: F.contains(c, g))

    first = F.array_position(F.transform(contexts, hit), F.lit(True))
    return F.when(first > 0, 1.0 / first).otherwise(0.0)


def _longest_common(p: list[str], g: list[str]) -> int:
    """Length of the longest common subsequence, one big-integer step a word (Hyyro's bit-vector recurrence)."""
    places: dict[str, int] = {}
    for i, w in enumerate(g):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << len(g)) - 1
    state = whole
    for w in p:
        hit = state & places.get(w, 0)
        state = ((state + hit) | (state - hit)) & whole
    return len(g) - state.bit_count()


@F.pandas_udf(IntegerType())
def _lcs(p: pd.Series, g: pd.Series) -> pd.Series:
    return pd.Series([_longest_common(list(a), list(b)) for a, b in zip(p, g)], dtype="int32")


def rouge_l(prediction: Column, gold: Column) -> Column:
    """F1 of the longest common word subsequence; 0 if either is empty. The one metric that needs Python: the recurrence has no built-in form."""
    p, g = tokens(prediction), tokens(gold)
    return F.when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2.0 * _lcs(p, g) / (F.size(p) + F.size(g)))


def set_scores(predicted: Column, gold: Column) -> tuple[Column, Column]:
    """(exact match, F1) of two arrays as sets; both empty: (1, 1), one empty: (0, 0)."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    same, empty = F.size(F.array_intersect(p, g)), (F.size(p) == 0) | (F.size(g) == 0)
    both = (F.size(p) == F.size(g)).cast("double")
    return F.when(empty, both).otherwise(((same == F.size(p)) & (same == F.size(g))).cast("double")), F.when(empty, both).otherwise(2.0 * same / (F.size(p) + F.size(g)))


def question_type(question: Column) -> Column:
    """The first rule that holds decides."""
    q = F.lower(question)
    has = lambda w: F.contains(q, F.lit(w))
    return (
        F.when(has("when") & (has("die") | has("death")), "temporal_death").when(has("who") & (has("mother") | has("father")), "family_relation")
        .when(has("where"), "location").when(has("what"), "factual").when(has("are") & has("both"), "comparison").otherwise("other")
    )


def numbered_items(text: Column) -> Column:
    """Entries of a numbered or bulleted list that are over 5 characters; blanks of any script around a line are cut."""
    mark = r"^([0-9]+[.)]|[-*])[ \t\n\f\r]*"
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+\z", ""))
    listed = F.filter(lines, lambda x: x.rlike(mark + r"[^ \t\n\f\r]"))
    return F.filter(F.transform(listed, lambda x: F.regexp_replace(x, mark, "")), lambda x: F.char_length(x) > 5)


def ranking(text: Column, n: Column) -> Column:
    """0-based places from all integers in 1..n, in order; the identity if there is none."""
    found = F.transform(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int")), lambda x: (x >= 1) & (x <= n)), lambda x: x - 1)
    return F.when(F.size(found) > 0, found).otherwise(F.sequence(F.lit(0), n - 1))


def predicted_score(text: Column) -> Column:
    """The last ``Predict_Score: x``; over 1 counts as per cent, missing as 0.5; held to 0..1."""
    found = F.try_element_at(F.regexp_extract_all(text, F.lit(r"Predict_Score:\s*([0-9.]+)"), F.lit(1)), F.lit(-1)).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(found > 1, found / 100).otherwise(found), F.lit(0.5))))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .when(seconds < 86400, F.format_string("%.1fh", seconds / 3600)).otherwise(F.format_string("%.1fd", seconds / 86400))
    )
