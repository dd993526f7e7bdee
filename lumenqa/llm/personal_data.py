"""Operator 9: personal data by bootstrapped contextual extraction.

Base patterns give the seeds of four kinds, and literals that a text assigns to a key word (``token = "..."``) seeds of a
fifth. Lexical patterns are the words around a span (two before it, one on each side, two after it) and one word beside it
together with the span's surface shape; a shape alone is no pattern. Identifier-like strings that no base pattern takes are the
other instances; those that look like a base kind but fail its check (a card number's check digit, a part over 255, too few
digits) are negative: they score 0 for good. Spark scores the graph of patterns and instances in rounds: a pattern's
confidence is the mean score of its distinct instances (seeds 1), an instance's score the chance that not all its trusted
patterns are wrong. Trusted patterns need several distinct accepted instances in several documents, counted anew in every
round. What the trusted patterns accept is added as ``id`` spans: a key word alone adds nothing, its literal has to stand in a
learned context. A base identifier is one wherever it stands.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, join_hot, map_batches

# The kinds and their base patterns. The look-behinds and possessive repeats only keep them linear: a run that fails from its start fails from within.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Key words of the secrets that are seeds.
_KEY = re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s*[=:]\s*[\"']?\Z")
_KEY_CHARS = 24
_TOKEN = re.compile(r"[^\s]+")
_EDGE = "\"'`()[]{}<>,;:!?.#$%&*|=\\"
_DIGIT = re.compile(r"[0-9]")
_NEAR = re.compile(r"\w+")
_HEX = re.compile(r"[0-9a-f]+\Z")
_RUN = re.compile(r"([0-9]+)|([^\W\d_]+)")
SHAPE_CHARS = 64


@dataclass(frozen=True)
class BootstrapParams:
    rounds: int = 3
    least_seeds: int = 3
    least_docs: int = 3
    trust: float = 0.8
    accept: float = 0.9
    least_length: int = 8
    least_digits: int = 4
    context_chars: int = 60


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def shape(surface: str) -> str:
    """The surface form: digits or lower-case hexadecimal digits with their number, of anything else its runs of letters, digits and marks."""
    if surface.isascii() and surface.isdigit():
        return f"d{len(surface)}"
    if _HEX.match(surface) and _DIGIT.search(surface):
        return f"x{len(surface)}"
    return _RUN.sub(lambda m: "d" if m[1] else "a", surface[:SHAPE_CHARS])


def rejected_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of matches that have the form of a base kind and fail its check: card numbers of 16 to 19 digits, addresses of four parts, numbers after a plus."""
    if not _DIGIT.search(text):
        return []
    out = [m.span() for m in _IP.finditer(text) if not all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and not _luhn(digits):
            out.append(m.span())
    return out + [m.span() for m in _PHONE.finditer(text) if not 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def _patterns(text: str, a: int, b: int, p: BootstrapParams) -> list[str]:
    """Patterns of a span: words around it, one word beside it with its shape."""
    left = _NEAR.findall(text[max(0, a - p.context_chars) : a].lower())[-2:]
    right = _NEAR.findall(text[b : b + p.context_chars].lower())[:2]
    form = shape(text[a:b])
    out = []
    if left:
        out.append(f"{left[-1]} [{form}]")
    if right:
        out.append(f"[{form}] {right[0]}")
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if len(right) == 2:
        out.append(f"_ {right[0]} {right[1]}")
    return out


def mentions(text: str, spans: list[tuple[str, int, int]], p: BootstrapParams) -> list[tuple[int, int, str, bool, bool, bool, list[str]]]:
    """(start, end, surface, is a seed, is a base span, is negative, patterns) of base spans and of other identifier-like strings."""
    out = [(a, b, text[a:b], True, True, False, _patterns(text, a, b, p)) for _, a, b in spans]
    if not _DIGIT.search(text):
        return out
    taken, refused = sorted((a, b) for _, a, b in spans), sorted(rejected_spans(text))
    at = no = 0
    for m in _TOKEN.finditer(text):
        word = m[0]
        if len(word) < p.least_length or not _DIGIT.search(word):
            continue
        core = word.strip(_EDGE)
        a = m.start() + len(word) - len(word.lstrip(_EDGE))
        b = a + len(core)
        assigned = max(core.rfind("="), core.rfind(":")) + 1  # key=value without blanks
        if assigned and _KEY.search(text[max(0, a + assigned - _KEY_CHARS) : a + assigned]):
            inner = core[assigned:].strip(_EDGE)
            a, core = a + core.index(inner, assigned), inner
        if len(core) < p.least_length or len(_DIGIT.findall(core)) < p.least_digits:
            continue
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if any(x < b and a < y for x, y in taken[at : at + 4]):
            continue
        while no < len(refused) and refused[no][1] <= a:
            no += 1
        negative = any(x < b and a < y for x, y in refused[no : no + 4])
        seed = not negative and bool(_KEY.search(text[max(0, a - _KEY_CHARS) : a]))
        out.append((a, b, core, seed, False, negative, _patterns(text, a, b, p)))
    return out


FOUND = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<string>, mentions array<struct<start:long,end:long,surface:string,seed:boolean,base:boolean,negative:boolean,patterns:array<string>>>"


def scan(docs: DataFrame, p: BootstrapParams) -> DataFrame:
    """One row for each row of docs(doc_id, text): counts and digest of base spans, and all mentions."""
    numbered = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string()), ("seed", pa.bool_()), ("base", pa.bool_()), ("negative", pa.bool_()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            counts, digests, bases, found = [], [], [], []
            for value in batch.column(2):
                text = value.as_py()
                spans = base_spans(text)
                base = [f"{k}:{a}:{b}" for k, a, b in spans]
                counts.append([sum(k == x for x, _, _ in spans) for k in KINDS])
                digests.append(hashlib.sha256(",".join(base).encode()).hexdigest())
                bases.append(base)
                found.append([dict(zip(("start", "end", "surface", "seed", "base", "negative", "patterns"), m)) for m in mentions(text, spans, p)])
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols, pa.array(digests, pa.string()), pa.array(bases, pa.list_(pa.string())), pa.array(found, kind)], [c.split()[0] for c in FOUND.split("array<struct")[0].split(", ")])

    return map_batches(numbered, run, FOUND)


def discover(edges: DataFrame, p: BootstrapParams) -> DataFrame:
    """(surface) of accepted instances, from edges(pattern, surface, seed, base, negative, doc_id).

    Every round: which patterns have enough accepted instances (seeds and those found) in enough documents, their
    confidence from the scores of all their distinct instances, then instances from their trusted patterns. Only patterns
    that could not have enough even if all their instances were accepted are left out beforehand. Base surfaces are accepted
    everywhere, other seeds only if trusted patterns accept them in the last round, negative ones never.
    """
    surfaces = edges.groupBy("surface").agg(F.max("seed").alias("seed"), F.max("base").alias("base"), F.max("negative").alias("negative"))
    surfaces = surfaces.select("surface", "base", (F.col("negative") & ~F.col("base")).alias("negative"), (F.col("seed") & (F.col("base") | ~F.col("negative"))).alias("seed"))
    most = edges.groupBy("pattern").agg(F.count_distinct("surface").alias("instances"), F.count_distinct("doc_id").alias("docs"))
    able = most.where((F.col("instances") >= p.least_seeds) & (F.col("docs") >= p.least_docs)).select("pattern")
    places = cut(edges.select("pattern", "surface", "doc_id").distinct().join(able, "pattern", "left_semi"))
    graph = cut(places.select("pattern", "surface").distinct().join(surfaces, "surface"))
    scores = cut(graph.select("surface", F.col("seed").cast("double").alias("score"), F.lit(0.0).alias("learned")).distinct())
    for _ in range(0 if graph.isEmpty() else p.rounds):
        accepted = scores.where(F.col("score") >= p.accept).select("surface")
        docs = places.join(accepted, "surface", "left_semi").groupBy("pattern").agg(F.count_distinct("doc_id").alias("docs"))
        patterns = graph.join(scores, "surface").groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count_if(F.col("score") >= p.accept).alias("instances"))
        patterns = patterns.where((F.col("confidence") >= p.trust) & (F.col("instances") >= p.least_seeds))
        patterns = patterns.join(docs.where(F.col("docs") >= p.least_docs), "pattern", "left_semi").select("pattern", "confidence")
        wrong = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.coalesce("confidence", F.lit(0.0))))))  # greatest() skips nulls
        found = graph.join(patterns, "pattern", "left").groupBy("surface").agg(F.max("seed").alias("seed"), F.max("negative").alias("negative"), (1 - wrong).alias("new"))
        new = F.when(F.col("negative"), 0.0).otherwise(F.col("new"))
        scores = cut(found.select("surface", F.when(F.col("seed"), 1.0).otherwise(new).alias("score"), new.alias("learned")))
    return surfaces.where("base").select("surface").union(scores.where(F.col("learned") >= p.accept).select("surface")).distinct()


def find_personal_data(docs: DataFrame, p: BootstrapParams = BootstrapParams()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id) of every row of docs(doc_id, text, ...).

    spans: base spans by kind as listed, then start; then ``id`` spans that the bootstrapping found, by start. Null and
    empty texts have none (the digest is that of the empty text). Texts of any length are scanned whole. Repeated rows
    are alike, a null doc_id stays null and counts as no document; an empty table gives no rows. Other columns are not read.
    """
    found = cut(scan(docs, p))
    each = found.select("row", "doc_id", F.explode("mentions").alias("m"))
    edges = each.select(F.explode("m.patterns").alias("pattern"), F.col("m.surface").alias("surface"), F.col("m.seed").alias("seed"), F.col("m.base").alias("base"), F.col("m.negative").alias("negative"), "doc_id")
    spans = each.where("not m.base").select("row", F.col("m.surface").alias("surface"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    sizes = spans.groupBy("surface").agg(F.count(F.lit(1)).alias("size"))  # one row a surface, for those that many documents repeat
    fresh = cut(discover(edges, p).join(sizes, "surface").withColumn("known", F.lit(True)))
    hits = join_hot(spans, fresh, "surface", spans.count()).where("known").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ids"))
    joined = found.drop("mentions").join(hits, "row", "left")
    named = F.transform(F.coalesce("ids", F.array()), lambda x: F.concat_ws(":", F.lit("id"), x["start"].cast("string"), x["end"].cast("string")))
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.array_join(F.concat("base", named), ",").alias("spans"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_id"))
