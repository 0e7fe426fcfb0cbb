"""Raw pages to what the indexes take, each in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import crawl_docs, parse_pages
from ..functions.recipes import normalise
from ..operators import counting, index, ngrams


def canonical(pages: DataFrame) -> DataFrame:
    """Canonical recipes of pages(url, html)."""
    return normalise(crawl_docs(pages))


def recipe_index(pages: DataFrame) -> index.Index:
    """The recipe index of pages(url, html)."""
    return index.build(canonical(pages))


def gram_index(pages: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(gram, url, freq): the n-gram index of pages(url, html) without markup."""
    kept = ngrams.kept_words(F.col("page.text"), ngrams.STOPWORDS if stop is None else stop)
    words = lambda part: parse_pages(part).select("url", kept.alias("_w"))
    return counting.counted(pages.select("url", "html"), "url", words, ngrams.LONGEST, "gram", "freq").select("gram", "url", "freq")


def crawl_links(pages: DataFrame, visited: DataFrame, holds: str = "food.com/recipe") -> DataFrame:
    """(url): the links of pages(url, html) that the n-gram crawl follows: those that hold a string and are not visited(url)."""
    found = parse_pages(pages.select("url", "html")).select(F.explode(F.array_distinct("page.anchors")).alias("url"))
    return found.filter(F.col("url").contains(holds)).distinct().join(visited.select("url"), "url", "left_anti")
