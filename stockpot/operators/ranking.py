"""Facet intersection, BM25 and top-k as one DataFrame plan, for one query or a batch of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import Index

K1, B = 1.2, 0.75


def bm25(tf: Column, df: Column, docs: Column, length: Column, mean: Column) -> Column:
    """Okapi BM25 of one term; 0 without tf, plain tf where df or docs are not positive."""
    dl, avg = F.greatest(F.lit(1.0), length.cast("double")), F.greatest(F.lit(1.0), mean)
    idf = F.log(F.lit(1.0) + (docs - df + 0.5) / (df + 0.5))
    value = idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avg))
    return F.when(tf <= 0, 0.0).when((docs > 0) & (df > 0), value).otherwise(tf.cast("double"))


def facet_candidates(attrs: DataFrame, wanted: DataFrame, by: list[str], key: str = "doc_id") -> DataFrame:
    """Documents that have every facet of their query: wanted(by..., attr_type, attr_key)."""
    need = wanted.distinct()
    total = need.groupBy(*by).agg(F.count("*").alias("_need"))
    hits = attrs.join(F.broadcast(need), ["attr_type", "attr_key"]).select(*by, key, "attr_type", "attr_key").distinct()
    have = hits.groupBy(*by, key).agg(F.count("*").alias("_have"))
    return have.join(F.broadcast(total), by).filter("_have = _need").select(*by, key)


def search(index: Index, terms: DataFrame, facets: DataFrame, limits: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, score) for a batch of parsed queries.

    terms(query_id, term), facets(query_id, attr_type, attr_key), limits(query_id, top) come
    from the query parser and are as small as the batch. Terms are alternatives, facets are
    all required; a query with facets only scores 1 for each candidate; one with neither
    has no hits. Ties go to the smaller doc_id. Postings meet the terms in a broadcast join,
    so only matching postings are shuffled.
    """
    key = "doc_id"
    terms, facets = terms.distinct(), facets.distinct()
    found = index.postings.select("term", key, "tf").join(F.broadcast(terms), "term")
    df = index.df.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    found = found.join(F.broadcast(df), "term", "left")
    flat = None
    if not facets.isEmpty():
        candidates = facet_candidates(index.attrs, facets, ["query_id"]).withColumn("_in", F.lit(True))
        faceted = facets.select("query_id").distinct().withColumn("_faceted", F.lit(True))
        found = found.join(F.broadcast(faceted), "query_id", "left").join(candidates, ["query_id", key], "left")
        found = found.filter("_faceted IS NULL OR _in").drop("_faceted", "_in")
        flat = candidates.join(F.broadcast(terms.select("query_id").distinct()), "query_id", "left_anti").select("query_id", key, F.lit(1.0).alias("score"))
    found = found.join(index.docmeta.select(key, "doc_length"), key, "left").crossJoin(F.broadcast(index.stats.select("doc_count", "avg_doc_length")))
    value = bm25(F.col("tf"), F.coalesce("df", F.lit(0)), F.col("doc_count"), F.coalesce("doc_length", F.lit(1)), F.col("avg_doc_length"))
    scored = found.groupBy("query_id", key).agg(F.sum(value).alias("score"))
    return top_k(scored if flat is None else scored.unionByName(flat), limits, key)


def top_k(scored: DataFrame, limits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first `top` (at least 1) rows of each query by score and then key.

    The largest limit of the batch is a literal in the plan, so that every task keeps only that
    many rows of a query before they are sorted; each query's own limit comes after.
    """
    most = max(1, limits.agg(F.max("top")).first()[0] or 1)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    out = scored.withColumn("rank", rank).filter(F.col("rank") <= most).join(F.broadcast(limits), "query_id")
    return out.filter(F.col("rank") <= F.greatest(F.lit(1), F.col("top"))).select("query_id", "rank", key, "score")


def with_meta(ranked: DataFrame, index: Index) -> DataFrame:
    """Hits with their metadata, fetched after the cut; a hit without metadata is dropped."""
    shown = index.docmeta.select("doc_id", "title", "source_url", "snippet", "dietary_tags", "appliance_tags", "categories", "total_minutes")
    return F.broadcast(ranked).join(shown, "doc_id")
