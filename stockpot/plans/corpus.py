"""An index over plain documents: language, source and length stand in for diet, appliance and time facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recipes import time_bucket
from ..functions.text import tokens
from ..lineage import cut, staged
from ..operators.index import Index, attributes, corpus_stats, counted, document_frequency

#: Characters that count as one minute of the time facet.
CHARS_A_MINUTE = 100


def lines(text: str = "text"):
    """Trimmed, non-blank lines of a text."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def docmeta(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """Metadata of each document; doc_length is the number of its distinct terms. `keep`: tokens to keep as a column."""
    minutes = F.expr(f"cast(n_chars div {CHARS_A_MINUTE} as int)")
    body = F.slice(lines(), F.lit(1), F.lit(30))
    return docs.select(
        "doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_url"), F.coalesce(F.try_element_at(body, F.lit(1)), F.lit("")).alias("title"), minutes.alias("total_minutes"),
        F.array("lang").alias("dietary_tags"), F.array("source").alias("appliance_tags"), F.array().cast("array<string>").alias("categories"),
        F.substring(F.array_join(F.slice(body, F.lit(1), F.lit(2)), " "), 1, 280).alias("snippet"), F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("doc_length"),
        *([] if keep is None else [keep.alias("tokens")]),
    )


def attrs(meta: DataFrame) -> DataFrame:
    kinds = {"dietary": F.array_compact("dietary_tags"), "appliance": F.array_compact("appliance_tags"), "timebucket": F.array(time_bucket(F.col("total_minutes")))}
    return attributes(meta, kinds)


def index(docs: DataFrame) -> Index:
    """The index of documents(doc_id, text, lang, source, n_chars), doc_id being unique.

    Texts are tokenised once: postings and metadata come from a staged table of tokens.
    """
    base = staged(docmeta(docs, tokens(F.col("text"))).drop("doc_length"))
    posts = counted(base.select("doc_id", "tokens"), F.col("tokens"))
    meta = base.withColumn("doc_length", F.size(F.array_distinct("tokens")).cast("long")).drop("tokens")
    return Index(posts, meta, attrs(meta), document_frequency(posts), corpus_stats(meta))


def index_for(docs: DataFrame, terms: list[str]) -> Index:
    """What a batch of queries over these terms needs, straight from texts.

    One pass over the texts leaves each document's length and its tokens among the terms;
    postings, frequencies, facets and statistics all come from that checkpoint.
    """
    found = tokens(F.col("text"))
    hits = F.filter(found, lambda t: t.isin(*terms)) if terms else F.array().cast("array<string>")
    minutes = F.expr(f"cast(n_chars div {CHARS_A_MINUTE} as int)")
    base = docs.select("doc_id", F.array("lang").alias("dietary_tags"), F.array("source").alias("appliance_tags"), minutes.alias("total_minutes"), F.size(F.array_distinct(found)).cast("long").alias("doc_length"), hits.alias("hits"))
    base = cut(base)
    posts = base.select("doc_id", F.explode("hits").alias("term")).groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))
    meta = base.drop("hits")
    return Index(posts, meta, attrs(meta), document_frequency(posts), corpus_stats(meta))
