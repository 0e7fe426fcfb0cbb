"""Breadth-first frontier expansion: visited and depth filters, links and the merge of parents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import frontier_links

MAX_DEPTH, MAX_OUTLINKS = 6, 150


def merge_frontier(links: DataFrame) -> DataFrame:
    """(url, depth, parent): the smallest depth of each url, then the smallest parent."""
    best = links.groupBy("url").agg(F.min(F.struct("depth", "parent")).alias("best"))
    return best.select("url", "best.depth", "best.parent")


def to_visit(frontier: DataFrame, visited: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Frontier rows within the depth and not yet visited. The visited set is never broadcast."""
    return frontier.filter(F.col("depth") <= max_depth).join(visited.select("url"), "url", "left_anti")


def expand(parsed: DataFrame, allowed: Callable[[Column], Column], max_outlinks: int = MAX_OUTLINKS) -> DataFrame:
    """(url, depth, parent): allowed links of parsed pages (url, depth, page), one level deeper."""
    links = frontier_links(F.col("page.listed"), F.col("page.anchors"), allowed, max_outlinks)
    return parsed.select(F.explode(links).alias("link"), (F.col("depth") + 1).alias("depth"), F.col("url").alias("parent")).withColumnRenamed("link", "url")
