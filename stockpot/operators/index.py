"""The inverted index: postings, document metadata, attribute lists and corpus statistics as flat tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.recipes import time_bucket
from ..functions.text import tokens
from . import counting

SNIPPET = 280
#: Field weights of the full-text column: title, ingredients, steps.
WEIGHTS = {"A": "title", "B": "ingredients", "C": "steps"}


def postings(docs: DataFrame, sections: list[Column], key: str = "doc_id") -> DataFrame:
    """(term, key, tf, positions): counts and sorted token offsets over all sections, in their order.

    Rows that repeat a key count once. Tokens are counted inside the row; only repeated keys are shuffled.
    """
    found = counting.placed(docs, key, F.concat(*[tokens(s) for s in sections]))
    return found.select("term", key, F.col("tf").cast("int").alias("tf"), "positions")


def counted_postings(docs: DataFrame, text: Column, key: str = "doc_id") -> DataFrame:
    """(term, key, tf) without positions; rows that share a key add up.

    A document's tokens are counted inside its row, so nothing is shuffled but rows that share a key.
    """
    return counted(docs, tokens(text), key)


def counted(docs: DataFrame, found: Column, key: str = "doc_id") -> DataFrame:
    """(term, key, tf) of rows whose tokens are known."""
    return counting.counted(docs, key, found).select("term", key, F.col("tf").cast("int").alias("tf"))


def document_frequency(posts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df); (term, key) is unique in postings."""
    return posts.groupBy("term").agg(F.count(key).alias("df"))


def corpus_stats(meta: DataFrame) -> DataFrame:
    """One row: doc_count, doc_len_sum and avg_doc_length (at least 1); (0, 0, 1) for no documents."""
    total = F.coalesce(F.sum("doc_length"), F.lit(0)).cast("long")
    row = meta.agg(F.count("*").alias("doc_count"), total.alias("doc_len_sum"))
    mean = F.when(F.col("doc_count") > 0, F.greatest(F.lit(1.0), F.col("doc_len_sum") / F.col("doc_count"))).otherwise(1.0)
    return row.withColumn("avg_doc_length", mean)


def doc_lengths(posts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, doc_length): distinct terms of each document."""
    return posts.groupBy(key).agg(F.count("*").alias("doc_length"))


def attributes(meta: DataFrame, kinds: dict[str, Column], key: str = "doc_id") -> DataFrame:
    """(attr_type, attr_key, key), distinct: one pass that explodes every kind's array of tags."""
    pairs = [F.transform(values, _tagged(kind)) for kind, values in kinds.items()]
    return meta.select(key, F.explode(F.concat(*pairs)).alias("_a")).select("_a.attr_type", "_a.attr_key", key).distinct()


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("attr_type"), F.lower(v).alias("attr_key"))


def first_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key: the first by `order`, which should be total."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", rank).filter("_n = 1").drop("_n")


@dataclass
class Index:
    """The tables of an index; `write` and `read` keep them as Parquet."""

    postings: DataFrame
    docmeta: DataFrame
    attrs: DataFrame
    df: DataFrame
    stats: DataFrame

    def write(self, folder: str, buckets: int | None = None) -> None:
        """Overwrite the index: tables are in ranges of term or facet and document, so that a query's terms
        touch few row groups and a hot term or facet is spread over tasks and files."""
        spark = self.postings.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.postings.repartitionByRange(n, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
        stored = spark.read.parquet(f"{folder}/postings")
        self.docmeta.write.mode("overwrite").parquet(f"{folder}/docmeta")
        self.attrs.repartitionByRange(n, "attr_type", "attr_key", "doc_id").sortWithinPartitions("attr_type", "attr_key", "doc_id").write.mode("overwrite").parquet(f"{folder}/attrs")
        # Derived from what is stored, so that texts are not read and tokenised again.
        document_frequency(stored).write.mode("overwrite").parquet(f"{folder}/df")
        corpus_stats(spark.read.parquet(f"{folder}/docmeta")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")

    def cached(self) -> Index:
        """The same index held in executor memory (spilling to disk): for a session of many queries."""
        return Index(*[t.cache() for t in (self.postings, self.docmeta, self.attrs, self.df, self.stats)])

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Index:
        return cls(*[spark.read.parquet(f"{folder}/{t}") for t in ("postings", "docmeta", "attrs", "df", "stats")])


def build(recipes: DataFrame) -> Index:
    """The index of canonical recipes: one document a recipe_id, the one with the smallest source_url."""
    docs = first_per_key(recipes, "recipe_id", [F.col("source_url")]).withColumnRenamed("recipe_id", "doc_id")
    sections = [F.col("title"), F.array_join("ingredient_tokens", " "), F.array_join("steps_raw", " ")]
    posts = postings(docs, sections).join(docs.select("doc_id", "source_url"), "doc_id")
    snippet = F.substring(F.array_join(F.slice("steps_raw", 1, 2), " "), 1, SNIPPET)
    merged = F.array_distinct(F.concat(*[tokens(s) for s in sections]))
    meta = docs.select("doc_id", "source_url", "title", F.col("times.total_minutes").alias("total_minutes"), "dietary_tags", "appliance_tags", "categories", snippet.alias("snippet"), F.size(merged).cast("long").alias("doc_length"))
    kinds = {"dietary": F.col("dietary_tags"), "appliance": F.col("appliance_tags"), "category": F.col("categories"), "timebucket": F.array(time_bucket(F.col("total_minutes")))}
    return Index(posts, meta, attributes(meta, kinds), document_frequency(posts), corpus_stats(meta))


def weighted_postings(recipes: DataFrame) -> DataFrame:
    """(term, doc_id, weight, tf): the weighted full-text column, weight A title, B ingredients, C steps."""
    texts = {"title": F.col("title"), "ingredients": F.array_join("ingredients_raw", " "), "steps": F.array_join("steps_raw", " ")}
    parts = [F.transform(tokens(texts[field]), _weighted(w)) for w, field in WEIGHTS.items()]
    rows = counting.counted(recipes.withColumn("doc_id", F.col("recipe_id")), "doc_id", F.concat(*parts))
    return rows.select(F.expr("substring(term, 2)").alias("term"), "doc_id", F.substring("term", 1, 1).alias("weight"), "tf")


def _weighted(weight: str):
    """A term with the letter of its weight before it."""
    return lambda t: F.concat(F.lit(weight), t)
