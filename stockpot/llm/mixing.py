"""Mixing sources to target weights.

Rows get hash-random keys, are range-sorted within each source, prefix sums of their token
counts are computed over the sorted partitions, and every source is cut at its exact budget,
with whole epochs before the cut where the budget exceeds the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_small, ordered_prefix, staged

SEED = 17
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """One non-null string per source that sorts by code point, null last."""
    return F.when(source.isNull(), "b").otherwise(F.concat(F.lit("a"), source.cast("string")))


def _random(seed: int, doc_id: Column) -> Column:
    """The hash-random key of a row: hexadecimal, so that it sorts alike in any system."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(key, source_size, source_before, target) for sizes(key, size).

    Sources in the order of `key` take the weights in turn. Targets share `share` of all
    sizes by weight; a target above `most` times its source's size stops there and the
    excess is shared again by weight among the others, until none is above.
    """
    per = staged(sizes.groupBy("key").agg(F.sum("size").cast("long").alias("source_size")))
    per = ordered_prefix(per.withColumn("one", F.lit(1).cast("long")), ["key"], ["one", "source_size"])
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = checkpointed(per.select("key", "source_size", F.col("source_size_before").alias("source_before"), F.element_at(turn, (F.col("one_before") % len(weights) + 1).cast("int")).alias("weight")))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    # Water-filling: only two sums a round reach the driver, and a round ends the search unless it caps a source.
    level, capped, left, weight = 0.0, -1, total * share, None
    cap = F.col("source_size") * F.lit(float(most))
    while True:
        full = F.col("weight") * F.lit(level) > cap if capped >= 0 else F.lit(False)
        row = per.agg(F.sum(F.when(full, cap)).alias("c"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, left, weight = row["n"], total * share - (row["c"] or 0.0), row["w"]
        level = left / weight
    return per.select("key", "source_size", "source_before", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Per source: target, whole epochs and the place where the last epoch is cut.

    rows(key, h, doc_id, size). The cut is the row on which the budget ends; rows equal to
    it in (h, doc_id, size) share what is left of the budget evenly (integer division).
    """
    per = checkpointed(targets(rows.select("key", "size"), weights, share, most)
                       .withColumn("budget", F.floor(F.col("target") + 0.5))
                       .withColumn("epochs", F.expr("CASE WHEN source_size > 0 THEN budget div source_size ELSE 0L END"))
                       .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")))
    ordered = ordered_prefix(rows, ["key", "h", "doc_id", "size"], ["size"])
    placed = join_small(ordered, per.select("key", "source_before", "rest"), "key").withColumn("before", F.col("size_before") - F.col("source_before"))
    cut = placed.filter("before < rest AND before + size >= rest").groupBy("key").agg(F.min(F.struct("before", "h", "doc_id", "size")).alias("cut"))
    cut = checkpointed(cut.select("key", F.col("cut.h").alias("cut_h"), F.col("cut.doc_id").alias("cut_doc"), F.col("cut.size").alias("cut_size")))
    same = (F.col("h") == F.col("cut_h")) & F.col("doc_id").eqNullSafe(F.col("cut_doc")) & (F.col("size") == F.col("cut_size"))
    ties = join_small(placed, cut, "key").filter(same).groupBy("key").agg(F.min("before").alias("cut_before"), F.count("*").alias("cut_rows"))
    return checkpointed(join_small(join_small(per, cut, "key"), ties, "key"))


def decide(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Add source_size, target, epochs and taken to rows that have key, h, doc_id and size."""
    out = join_small(rows, per, "key")
    mine, cut = F.struct("h", "doc_id", "size"), F.struct(F.col("cut_h").alias("h"), F.col("cut_doc").alias("doc_id"), F.col("cut_size").alias("size"))
    part = (F.when((F.col("rest") == 0) | (F.col("size") == 0), F.lit(0))
            .when(F.col("cut_h").isNull(), F.col("size"))
            .when(mine < cut, F.col("size"))
            .when(mine > cut, F.lit(0))
            .otherwise(F.floor((F.col("rest") - F.col("cut_before")) / F.col("cut_rows"))))
    return out.withColumn("last", part.cast("long")).withColumn("taken", F.col("epochs") * F.col("size") + F.col("last")).drop("cut_h", "cut_doc", "cut_size", "cut_before", "cut_rows", "rest", "budget", "source_before")


def keyed(docs: DataFrame, seed: int, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """rows(key, h, doc_id, size): h is random by seed and doc_id."""
    return docs.select(_key(F.col(source)).alias("key"), _random(seed, F.col(doc_id)).alias("h"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("size"))


def mix_digest(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, epochs), one row per input row.

    A null text has size 0; a null source is a source and comes last; equal rows get equal
    results; an empty table gives no rows; other columns are ignored.
    """
    rows = staged(keyed(docs, seed))
    return decide(rows, plan(rows, weights, share, most)).select("doc_id", "size", "source_size", "target", "taken", "epochs")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = SEED) -> DataFrame:
    """The mixed documents, with the columns of `docs` (doc_id, text, source and any others).

    A document is repeated once per epoch that takes it whole; the one on which a source's
    budget ends is cut after its last taken word. Texts are not shuffled: only
    (source, key, doc_id, size) rows are sorted, and each row is then decided where it lies.
    A row without words is kept once in every whole epoch. n_chars, where present, follows the text.
    """
    per = plan(staged(keyed(docs, seed)), weights, share, most)
    names = docs.columns
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _key(F.col("source")).alias("key"), _random(seed, F.col("doc_id")).alias("h"), F.col("doc_id"), words(F.col("text")).alias("size"))
    done = decide(kept, per)
    whole = F.transform(F.sequence(F.lit(1), F.col("epochs").cast("int")), lambda _: F.col("size"))
    whole = F.when(F.col("epochs") > 0, whole).otherwise(F.array().cast("array<bigint>"))
    takes = F.concat(whole, F.when(F.col("last") > 0, F.array("last")).otherwise(F.array().cast("array<bigint>")))
    done = done.select("row", "size", F.explode(takes).alias("take"))
    head = F.concat_ws("", F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0)), 1, F.col("take").cast("int")))
    text = F.when(F.col("take") < F.col("size"), head).otherwise(F.col("row.text"))
    made = {"text": text} | ({"n_chars": F.when(F.col("take") < F.col("size"), F.length(text).cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in names else {})
    return done.select(*[made.get(c, F.col("row")[c]).alias(c) for c in names])
