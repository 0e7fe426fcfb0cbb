"""Counts inside rows: rows that share a key, null keys, long rows, and how little is shuffled."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from stockpot.functions.porter import stem
from stockpot.operators import counting, index, ngrams


def shuffled(spark) -> int:
    """Records that all stages so far have shuffled."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


ROWS = [(1, "b a b a c"), (2, "x"), (2, "x x y"), (None, "n m"), (None, "n"), (3, None), (4, ""), (5, "a " * 70_000 + "z"), (6, "flies fly flying dies die")]


def expected(longest, of=lambda w: w):
    out = Counter()
    for key, text in ROWS:
        words = [of(w) for w in (text or "").split()]
        for n in range(1, longest + 1):
            out.update((key, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    return out


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
@pytest.mark.parametrize("most", [1 << 16, 3])
def test_counts(spark, monkeypatch, longest, most):
    monkeypatch.setattr(counting, "_WORDS", most)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = ngrams.in_row_grams(docs, [], longest=longest).collect()
    assert {(r["doc_id"], r["gram"]): r["freq"] for r in got} == expected(longest) and len(got) == len(expected(longest))


def test_stems_are_counted_in_rows(spark):
    docs = spark.createDataFrame(ROWS, "url long, text string")
    got = ngrams.local_index(docs).collect()
    assert {(r["url"], r["gram"]): r["freq"] for r in got} == expected(3, stem)


def test_wide_ids_are_numbered_again():
    """Products of many words that leave 62 bits."""
    import numpy as np
    import pyarrow as pa

    words = [f"w{i % 70_000}" for i in range(140_000)]
    (*_, last) = counting._runs(pa.array(words), np.array([140_000]), 5, False, False)
    assert len(last[1]) == 70_000 and sum(last[2].to_pylist()) == 139_996 and last[1][0].as_py() == "w0 w1 w2 w3 w4"


def test_places(spark):
    docs = spark.createDataFrame([(1, "bb aa bb"), (2, "xx"), (2, "xx"), (None, "nn nn")], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): (r["tf"], r["positions"]) for r in index.postings(docs, [F.col("text")]).collect()}
    assert got == {(1, "bb"): (2, [0, 2]), (1, "aa"): (1, [1]), (2, "xx"): (1, [0]), (None, "nn"): (2, [0, 1])}


def test_only_shared_keys_are_shuffled(spark, data):
    """Postings and grams of documents with an id of their own stay where their text lies."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    makers = [lambda: ngrams.in_row_grams(docs, ngrams.STOPWORDS), lambda: index.counted_postings(docs, F.col("text")), lambda: index.postings(docs, [F.col("text")]), lambda: ngrams.local_index(docs.withColumn("url", F.col("doc_id").cast("string")), ngrams.stopwords(spark))]
    for make in makers:
        before = shuffled(spark)
        assert make().count() > 10_000
        assert shuffled(spark) - before < 1_000


def test_pages_reach_python_in_small_batches(spark, data):
    """A worker's memory follows the batch, so pages and prompts come 500 at a time, whatever the session says."""
    from stockpot.functions.html import parse_pages
    from stockpot.shipping import ARROW_ROWS

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert parse_pages(spark.read.parquet(f"{data}/pages.parquet")).count() > 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS


def test_rows_of_an_index_are_shuffled_once(spark):
    """Lists, hot grams and merges of several indexes: one shuffle of the rows, no sums of distinct rows before it."""
    rows = [(f"g{i % 3000}", f"u{i}", 1) for i in range(9000)] + [("hot", f"u{i}", 2) for i in range(500)]
    flat = spark.createDataFrame(rows, "gram string, url string, freq long").select("gram", "freq", "url")
    before = shuffled(spark)
    lists = ngrams.posting_lists(flat, most=100).collect()
    # The rows, the slots of each task and the count of the one hot gram; three times the rows before.
    assert shuffled(spark) - before < len(rows) + 4 * 3000 + 100
    hot = [r["postings"] for r in lists if r["gram"] == "hot"]
    assert len(hot) == 5 and sorted(p["url"] for x in hot for p in x) == sorted(f"u{i}" for i in range(500))
    assert sum(len(r["postings"]) for r in lists) == len(rows)
    before = shuffled(spark)
    summed = ngrams.merge(flat, flat, flat).collect()
    assert shuffled(spark) - before <= 3 * len(rows) and {r["freq"] for r in summed} == {3, 6} and len(summed) == len(rows)


def test_keywords_and_trims_run_without_patterns(spark):
    """Plain keywords and white space need no regex over whole texts; the results are those of the patterns."""
    from stockpot.functions import recipes

    texts = ["Beef in the  oven", "soven", "air fryer", "AIRFRY", "", None, "gluten-free", "\t a\n b \x0b\f\r", " \n ", "a", "böuf ham "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for keys in (recipes.MEAT, recipes.GLUTEN_FREE, *recipes.APPLIANCES.values()):
        got = rows.select(recipes._has(F.col("t"), keys).alias("a"), F.rlike("t", F.lit("|".join(keys))).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]
    trimmed = rows.select(recipes._trim(F.col("t")).alias("a"), F.regexp_replace("t", "^\\s+|\\s+$", "").alias("b"))
    assert all(r["a"] == r["b"] for r in trimmed.collect())
    assert "rlike" not in str(recipes._has(F.col("t"), recipes.MEAT)).lower() and "regexp" not in str(recipes._trim(F.col("t"))).lower()


def test_recipes_of_one_url_alone_are_shuffled(spark, data):
    from stockpot.functions.recipes import normalise
    from stockpot.queries import _records
    from stockpot.sources import tables

    rows = normalise(_records(spark, data))
    twice = rows.limit(1).withColumn("recipe_id", F.lit(""))
    made = tables.relational(rows.unionByName(twice))["recipes"]
    # Before, the window sorted every recipe; now the longest way of a recipe is a bitmap lookup.
    assert made.count() == rows.count() and made.filter("recipe_id = ''").count() == 1
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.split("Window")[0]
