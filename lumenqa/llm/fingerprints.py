"""Operator 7: document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A paragraph is a run up to a line feed or the end of a sentence, without white space around it, or a run of marks that end
sentences alone; long runs are cut every 64 characters, so that text without punctuation has paragraphs too. Its md5
gives two words of 60 bits. A text's fingerprint is a vector of sums over its paragraphs:

* LANES sums of +1 and -1, one a bit of the words, as long integers that no text can overflow,
* the two words added modulo 2**60, residues wide enough for equality,
* the number of paragraphs.

It doesn't depend on the paragraphs' order, adding or subtracting a paragraph's vector inserts or deletes it, and equal
multisets have equal fingerprints. The likeness of two fingerprints is the cosine of their lanes, which estimates the cosine of the
paragraph multisets.

Three lanes of 20 bits are added at once in one word, RUN paragraphs at a time, before they are spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions

PARAGRAPH = r"[^\n.!?]{1,64}[.!?]{0,64}|[.!?]{1,64}"
_BLANKS = " \t\n\x0b\x0c\r"
SHIFTS = 20  # packed words a hash word: bits s, s + 20 and s + 40 of it are lanes of packed word s
_MASK = 1 + (1 << SHIFTS) + (1 << 2 * SHIFTS)
_LANE = (1 << SHIFTS) - 1
#: Paragraphs whose lanes are added in packed form; a lane of 20 bits holds as many.
RUN = 1_000_000
LANES = 6 * SHIFTS
RESIDUE = (1 << 60) - 1


def paragraphs(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")


def _once(value: Column, use) -> Column:
    """use(value), the value computed once: a lambda variable is not inlined."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _run_lanes(first: Column, second: Column) -> Column:
    """LANES sums of +1 and -1 of at most RUN paragraphs, from their hash words: one running sum for each packed word."""
    zero, mask = F.lit(0).cast("long"), F.lit(_MASK).cast("long")

    def word(values: Column, s: int) -> Column:
        return F.aggregate(values, zero, lambda total, w: total + F.shiftright(w, s).bitwiseAND(mask))

    packed = F.array(*[word(x, s) for x in (first, second) for s in range(SHIFTS)])
    n = F.size(first)
    lane = lambda words, k: F.transform(words, lambda x: 2 * F.shiftright(x, k * SHIFTS).bitwiseAND(F.lit(_LANE).cast("long")) - n)
    return _once(packed, lambda words: F.concat(lane(words, 0), lane(words, 1), lane(words, 2)))


def _sums(digests: Column) -> Column:
    """The sum of the vectors of paragraphs with these md5 digests."""
    zero, mask = F.lit(0).cast("long"), F.lit(RESIDUE).cast("long")

    def words(at: int) -> Column:
        return F.transform(digests, lambda d: F.conv(F.substring(d, at, 15), 16, 10).cast("long"))

    def residue(values: Column) -> Column:
        return F.aggregate(values, zero, lambda total, w: (total + w).bitwiseAND(mask))

    def whole(x: Column) -> Column:
        n = F.size(x["a"])
        part = lambda i: F.struct(F.slice(x["a"], i * RUN + 1, RUN).alias("a"), F.slice(x["b"], i * RUN + 1, RUN).alias("b"))
        run = lambda i: _once(part(i), lambda y: _run_lanes(y["a"], y["b"]))
        runs = F.aggregate(F.sequence(F.lit(1), F.floor((n - 1) / RUN).cast("int")), run(F.lit(0)), lambda total, i: add(total, run(i)))
        lanes = F.when(n <= RUN, _run_lanes(x["a"], x["b"])).otherwise(runs)
        return F.concat(lanes, F.array(residue(x["a"]), residue(x["b"]), n.cast("long")))

    return _once(F.struct(words(1).alias("a"), words(16).alias("b")), whole)


def _moduli(words: Column) -> Column:
    """words with the two residues brought back to 0 ... RESIDUE."""
    mask = F.lit(RESIDUE).cast("long")
    return F.concat(F.slice(words, 1, LANES), F.transform(F.slice(words, LANES + 1, 2), lambda x: x.bitwiseAND(mask)), F.slice(words, LANES + 3, 1))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs; lane sums alone may be added as they are."""
    return F.zip_with(a, b, lambda x, y: x + y)


def insert(a: Column, b: Column) -> Column:
    """The fingerprint a with the paragraphs of b added."""
    return _moduli(add(a, b))


def delete(a: Column, b: Column) -> Column:
    """The fingerprint a with the paragraphs of b taken out."""
    return _moduli(F.zip_with(a, b, lambda x, y: x - y))


def fingerprint(text: Column) -> Column:
    """array<long> of LANES + 3 words; all zero for null, empty and blank texts. Texts of any length are taken whole."""
    return _once(F.transform(paragraphs(text), lambda x: F.md5(x.cast("binary"))), _sums)


def as_text(words: Column) -> Column:
    return F.array_join(words.cast("array<string>"), ",")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints alone: 1 if equal, 0 if just one is of no paragraph."""

    def cosine(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        norm = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
        return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(_dot(x, y), norm)))).otherwise(0.0)  # least() skips nulls

    lanes = F.struct(F.slice(a, 1, LANES).alias("x"), F.slice(b, 1, LANES).alias("y"))
    return F.when(a == b, F.lit(1.0)).otherwise(F.round(_once(lanes, cosine), 9))


def next_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, next_id) of distinct non-null ids, descending, the last one's next being the first; no task sorts more than its range of ids."""
    spark = docs.sparkSession
    ids = docs.select(F.col(key).alias("doc_id")).where("doc_id is not null").distinct()
    ranged = cut(ids.repartitionByRange(partitions(spark), F.desc("doc_id")).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy(F.desc("doc_id"))
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head"))  # one row a partition
    following = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.max("head").over(Window.partitionBy())).alias("after"))
    linked = ranged.withColumn("next_id", F.lead("doc_id").over(own)).join(following, "part")
    return linked.select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs(doc_id, text, ...).

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next
    document's. Rows that share a doc_id share the next document; where several rows have the next id, the one whose
    head (as many characters as a row before it needs) is the smallest is taken, of equal heads the one with the smaller
    hash of its text. A null doc_id comes after all others, so its next is the largest id; a document alone is its own
    next. Null texts count as empty; texts of blanks alone have the fingerprint of the empty text; texts of any length are
    taken whole; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    links = next_ids(docs)
    first = docs.where("doc_id is not null").agg(F.max("doc_id").alias("first"))
    heads = rows.where("doc_id is not null").withColumn("n", F.char_length("text"))
    wants = heads.groupBy("doc_id").agg((F.floor(F.max("n") / 3)).cast("int").alias("want"))
    back = links.join(wants, "doc_id").select(F.col("doc_id").alias("prev_id"), F.col("next_id").alias("doc_id"), "want")
    given = heads.join(back, "doc_id").select("prev_id", F.struct(F.substring(F.col("text"), F.lit(1), F.col("want")).alias("head"), F.xxhash64("text").alias("tie"), fingerprint(F.col("text")).alias("next_words")).alias("given"))
    given = given.groupBy("prev_id").agg(F.min("given").alias("given"))
    loose = rows.where("doc_id is null")
    if loose.isEmpty():
        joined = rows.join(given, F.col("doc_id") == F.col("prev_id"))
    else:
        joined = rows.join(given, F.col("doc_id") == F.col("prev_id")).unionByName(_after_all(loose, heads, first))
    n = F.char_length("text")
    keep = n - F.floor(n / 3).cast("int")
    out = joined.select("doc_id", "text", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), keep), F.substring(F.col("given.head"), F.lit(1), F.floor(n / 3).cast("int"))).alias("edited"), "given.next_words")
    out = out.withColumn("words", fingerprint(F.col("text"))).withColumn("edited_words", fingerprint(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("words")).alias("fingerprint"), as_text(F.col("edited_words")).alias("edited_fingerprint"),
        likeness(F.col("words"), F.col("edited_words")).alias("near_edited"), likeness(F.col("words"), F.col("next_words")).alias("near_next"),
    )


def _after_all(loose: DataFrame, heads: DataFrame, first: DataFrame) -> DataFrame:
    """Rows without an id, with the head of the document that has the largest one, or of themselves if there is none."""
    text = heads.join(first, F.col("doc_id") == F.col("first"), "left_semi").agg(F.min("text").alias("following"))
    pair = loose.join(text, F.lit(True), "left").withColumn("following", F.coalesce("following", "text"))
    given = F.struct(F.col("following").alias("head"), F.xxhash64("following").alias("tie"), fingerprint(F.col("following")).alias("next_words"))
    return pair.select("doc_id", "text", F.lit(None).cast("long").alias("prev_id"), given.alias("given"))
