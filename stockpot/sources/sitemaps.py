"""Seeds from robots.txt and sitemaps, and from seed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut

MAX_SITEMAP_DEPTH = 6


def robots_sitemaps(body: Column) -> Column:
    """Sitemap URLs of a robots.txt body, in order."""
    lines = F.split(F.coalesce(body, F.lit("")), "\\r?\\n")
    found = F.filter(lines, lambda x: F.rlike(x, F.lit("(?i)^\\s*sitemap:\\s*.+$")))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, "(?i)^\\s*sitemap:\\s*", "")))


def locations(xml: Column) -> Column:
    """Trimmed, non-empty <loc> contents, in order."""
    found = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit("(?i)<loc>\\s*([^<]+?)\\s*</loc>"), F.lit(1))
    return F.filter(F.transform(found, lambda u: F.trim(u)), lambda u: u != "")


def is_index(xml: Column) -> Column:
    return F.rlike(xml, F.lit("(?i)<sitemapindex[\\s>]"))


def is_page(xml: Column) -> Column:
    """Whether a body is an HTML page or a bot challenge instead of a sitemap."""
    return F.rlike(xml, F.lit("(?i)<html[\\s>]|Just a moment"))


def leaf_locations(roots: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_depth: int = MAX_SITEMAP_DEPTH) -> DataFrame:
    """(url): locations of all sitemaps under roots(url). Each level is one fetch of what was not yet seen."""
    level = cut(roots.select("url").distinct())
    seen, leaves = level, None
    for _ in range(max_depth + 1):
        if level.isEmpty():
            break
        bodies = fetch(level).filter(F.col("html").isNotNull() & ~is_page(F.col("html")))
        rows = cut(bodies.select(is_index(F.col("html")).alias("index"), F.explode(locations(F.col("html"))).alias("url")))
        leaf = rows.filter("NOT index").select("url")
        leaves = leaf if leaves is None else leaves.union(leaf)
        level = cut(rows.filter("index").select("url").distinct().join(seen, "url", "left_anti"))
        seen = cut(seen.union(level))
    return leaves if leaves is not None else roots.select("url").filter("false")


def seeds(robots: DataFrame, fetch: Callable[[DataFrame], DataFrame], allowed: Callable[[Column], Column], most: int | None = None, max_depth: int = MAX_SITEMAP_DEPTH) -> DataFrame:
    """Distinct allowed page URLs from robots(body), at most `most`, in URL order."""
    roots = robots.select(F.explode(robots_sitemaps(F.col("body"))).alias("url"))
    urls = leaf_locations(roots, fetch, max_depth).distinct().filter(allowed(F.col("url")))
    return urls if most is None else urls.orderBy("url").limit(most)


def seeds_file(spark: SparkSession, path: str) -> DataFrame:
    """(url): trimmed lines of a text file without blank ones and # comments."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> '' AND NOT startswith(url, '#')")


def write_seeds(urls: DataFrame, path: str) -> None:
    urls.select(F.col("url").alias("value")).write.mode("overwrite").text(path)
