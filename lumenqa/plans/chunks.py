"""Queries on splitters, stems, pages and conditional spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages, stems
from ..functions import text as T
from ..operators import retrieval as R
from ..operators import spaces, splitters
from ..operators.spaces import Choice
from ..sources.tables import table
from .base import query


@query()
def chunk_documents_sentence(spark, sf_dir):
    """Whole sentences up to 64 words with an overlap of up to 16."""
    return splitters.chunk_sentences(table(spark, sf_dir, "documents"), 64, 16)


@query()
def chunk_documents_recursive(spark, sf_dir):
    """Pieces of up to 500 characters by paragraphs, lines, sentences and words."""
    return splitters.chunk_recursively(table(spark, sf_dir, "documents"), 500)


@query()
def sentence_windows(spark, sf_dir):
    """Every sentence with the two before and after it."""
    return splitters.sentence_windows(table(spark, sf_dir, "documents"), 2)


@query()
def chunk_pages(spark, sf_dir):
    """Pages in pieces of up to 1,024 characters, cut at block tags."""
    return splitters.chunk_pages(table(spark, sf_dir, "pages"), 1024)


@query()
def page_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"), pages.page_markdown("html").alias("markdown"))


@query(r"select page_id, substr(regexp_extract(html, '(?is)<title\b[^>]{0,1000}>.*?</title>', 0), 1, 256) as title from pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


@query()
def word_stems(spark, sf_dir):
    """The stem of every distinct word of all documents."""
    return stems.stem_table(table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")))


@query()
def bm25_stemmed_topk(spark, sf_dir):
    """As bm25_topk, over stems."""
    return R.bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 20, stem=True).withColumn("score", F.round("score", 6))


_CHUNKS = (Choice("splitter", ("recursive", "sentence", "token")), Choice("chunk_size", ("128", "256", "512", "1024")))
_RETRIEVAL = Choice("retrieval", ("dense", "sparse", "hybrid"), {"hybrid": (Choice("weight", tuple(f"0.{i}" for i in range(1, 10))),)})
SPACE = (
    Choice("mode", ("no_rag", "rag"), {"rag": (*_CHUNKS, _RETRIEVAL)}),
    Choice("reranker", ("off", "on"), {"on": (Choice("top_k", tuple(str(i) for i in range(2, 33))),)}),
    Choice("template", ("default", "concise", "CoT")),
)
_MODE, _RERANKER = 1 + 3 * 4 * 11, 1 + 31


@query(f"""with n as (select o_orderkey, (o_orderkey * 7919) % {_MODE * _RERANKER * 3} as number from orders),
d as (select *, number % {_MODE} as m, number // {_MODE} % {_RERANKER} as r, number // {_MODE * _RERANKER} as t, number % {_MODE} - 1 as x from n)
select o_orderkey, number, case when m = 0 then 'no_rag' else 'rag' end as mode, case when m > 0 then (['recursive', 'sentence', 'token'])[1 + x % 3] end as splitter, case when m > 0 then (128 << (x // 3 % 4)::int)::varchar end as chunk_size,
       case when m > 0 then case x // 12 when 0 then 'dense' when 1 then 'sparse' else 'hybrid' end end as retrieval, case when m > 0 and x // 12 >= 2 then '0.' || (x // 12 - 1) end as weight,
       case when r = 0 then 'off' else 'on' end as reranker, case when r > 0 then (r + 1)::varchar end as top_k, (['default', 'concise', 'CoT'])[1 + t] as template from d""")
def space_configurations(spark, sf_dir):
    """A configuration for every order, numbered in a space whose choices open others."""
    number = F.col("o_orderkey") * 7919 % spaces.cardinality(SPACE)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", number.alias("number")).withColumn("p", spaces.decode(SPACE, F.col("number")))
    return rows.select("o_orderkey", "number", *[F.col("p")[c].alias(c) for c in ("mode", "splitter", "chunk_size", "retrieval", "weight", "reranker", "top_k", "template")])


@query(f"with t as (select o_orderkey, o_custkey % 2 = 0 as own, (o_custkey * 31) % {_MODE * _RERANKER * 3} as number from orders) select min(o_orderkey) as number, number as code from t where not own and number not in (select number from t where own) group by number")
def transferred_trials(spark, sf_dir):
    """Trials of the odd customers' study whose configuration the even customers' study lacks, each configuration once."""
    code = F.col("o_custkey") * 31 % spaces.cardinality(SPACE)
    trials = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), (F.col("o_custkey") % 2 == 0).alias("own"), spaces.decode(SPACE, code).alias("params"))
    found = spaces.transfer(trials.where("own"), trials.where("not own"), SPACE)
    return found.select("number", spaces.encode(SPACE, F.col("params")).alias("code"))
