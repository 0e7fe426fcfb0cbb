"""The crawl: rounds of fetching, storing and expanding until nothing is left or a limit is met."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import crawl_docs, is_rich, parse_pages, records
from ..functions.urls import policy
from ..lineage import cut, staged
from ..operators.frontier import MAX_DEPTH, MAX_OUTLINKS, expand, merge_frontier, to_visit

Fetch = Callable[[DataFrame], DataFrame]
PROFILE = "round int, frontier_in long, wall_ms long, visited_after long, visited_delta long, frontier_adds long, next_frontier long"


@dataclass
class Crawl:
    """What a crawl leaves: tables and a summary."""

    visited: DataFrame
    docs: DataFrame
    frontier: DataFrame
    rounds: int
    frontier_adds: int
    stopped_early: bool
    profiles: list[tuple] = field(default_factory=list)

    def summary(self, doc_stats: bool = False) -> dict:
        out = {"roundsCompleted": self.rounds, "frontierAdds": self.frontier_adds, "visitedCount": self.visited.count()}
        if self.stopped_early:
            out["stoppedEarly"] = True
        if doc_stats:
            row = rich_stats(self.docs).first()
            out |= {"totalDocs": row["total_docs"], "richDocs": row["rich_docs"]}
        return out

    def profile_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.profiles, PROFILE)


def rich_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("total_docs"), F.count_if(is_rich(F.col("ingredients"), F.col("times"))).alias("rich_docs"))


def run(spark: SparkSession, seeds: DataFrame, fetch: Fetch, allowed: Callable[[Column], Column] | None = None, max_rounds: int = 50, max_depth: int = MAX_DEPTH, max_outlinks: int = MAX_OUTLINKS, max_pages: int | None = None, should_abort: Callable[[], bool] | None = None, visited: DataFrame | None = None) -> Crawl:
    """Crawl from seeds(url).

    fetch turns rows with url into the fetched ones with final_url and html added. A round
    filters by depth and visited pages, fetches, keeps each page under the requested url
    and merges its links into the next frontier. It ends with an empty frontier, max_rounds,
    max_pages visited (looked at between rounds) or should_abort at a round's start. The
    tables of a round are checkpointed or staged, so that no plan but the union of the docs grows with rounds.
    """
    allowed = allowed or policy("multisite")
    seen = cut(visited.select("url").distinct()) if visited is not None else spark.createDataFrame([], "url string")
    docs = None
    frontier = cut(merge_frontier(seeds.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))))
    waiting, rounds, adds, stopped, profiles, before = frontier.count(), 0, 0, False, [], seen.count()
    while waiting and rounds < max_rounds:
        if should_abort is not None and should_abort():
            stopped = True
            break
        started = time.monotonic()
        pages = fetch(to_visit(frontier, seen, max_depth)).filter(F.coalesce(F.col("html"), F.lit("")) != "")
        pages = pages.select(F.col("url").alias("key"), F.coalesce("final_url", "url").alias("url"), "depth", "html").dropDuplicates(["key"])
        # Each page is parsed once; what is kept of it and its links are read from the staged result.
        parsed = staged(parse_pages(pages))
        stored = records(parsed, "key").select("url", "key", "text", "title", "times", "ingredients", "categories")
        docs = stored if docs is None else docs.unionByName(stored)
        seen = cut(seen.union(parsed.select(F.col("key").alias("url"))))
        links = merge_frontier(expand(parsed.select(F.col("key").alias("url"), "depth", "page"), allowed, max_outlinks))
        following = cut(to_visit(links, seen, max_depth))
        rounds, added, after = rounds + 1, following.count(), seen.count()
        adds += added
        profiles.append((rounds - 1, waiting, int((time.monotonic() - started) * 1000), after, after - before, added, added))
        frontier, waiting, before = following, added, after
        if max_pages is not None and after >= max_pages:
            break
    if docs is None:
        docs = crawl_docs(spark.createDataFrame([], "url string, html string")).withColumn("key", F.col("url"))
    return Crawl(seen, docs, frontier, rounds, adds, stopped, profiles)
