"""Command line: python -m stockpot seeds|crawl|index|query|tables|rounds ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.recipes import normalise
from .functions.urls import policy
from .operators import index, stats
from .plans import crawl, hybrid
from .sources import sitemaps, tables, web


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stockpot")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("seeds", help="page URLs from robots.txt bodies (a text file each)")
    p.add_argument("--robots", required=True)
    p.add_argument("--pages", required=True, help="Parquet with url and html: sitemaps are found in it")
    p.add_argument("--out", required=True)
    p.add_argument("--max-urls", type=int)
    p.add_argument("--policy", default="multisite")
    p = sub.add_parser("crawl", help="crawl from a seeds file")
    p.add_argument("--seeds", required=True)
    p.add_argument("--pages", help="Parquet with url and html; without it pages are fetched over the network")
    p.add_argument("--out", required=True)
    p.add_argument("--policy", default="multisite")
    for name, value in (("max-rounds", 50), ("max-depth", 6), ("max-outlinks", 150), ("max-pages", None)):
        p.add_argument(f"--{name}", type=int, default=value)
    p = sub.add_parser("index", help="normalise crawl records and build the index")
    p.add_argument("--docs", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("query", help="one hybrid query")
    p.add_argument("--index", required=True)
    p.add_argument("--query", required=True)
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--auto-correct", action="store_true")
    p = sub.add_parser("tables", help="write the relational tables of crawl records")
    p.add_argument("--docs", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--old")
    p.add_argument("--limit", type=int)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("stockpot").getOrCreate()
    if args.command == "seeds":
        robots = spark.read.text(args.robots, wholetext=True).select(F.col("value").alias("body"))
        fetch = web.from_table(spark.read.parquet(args.pages))
        sitemaps.write_seeds(sitemaps.seeds(robots, fetch, policy(args.policy), args.max_urls), args.out)
    elif args.command == "crawl":
        fetch = web.from_table(spark.read.parquet(args.pages)) if args.pages else web.fetcher(web.urllib_get)
        done = crawl.run(spark, sitemaps.seeds_file(spark, args.seeds), fetch, policy(args.policy), args.max_rounds, args.max_depth, args.max_outlinks, args.max_pages)
        done.docs.write.mode("overwrite").parquet(f"{args.out}/docs")
        done.visited.write.mode("overwrite").parquet(f"{args.out}/visited")
        stats.write_rounds(done.profile_rows(spark), f"{args.out}/rounds")
        print(json.dumps(done.summary(doc_stats=True)))
    elif args.command == "index":
        index.build(normalise(spark.read.parquet(args.docs))).write(args.out)
    elif args.command == "query":
        run = hybrid.run_corrected if args.auto_correct else hybrid.run
        print(json.dumps(run(spark, index.Index.read(spark, args.index), args.query, args.limit), default=str))
    elif args.command == "tables":
        docs = spark.read.parquet(args.docs)
        print(json.dumps(tables.sample_to_tables(spark, docs, args.out, args.limit) if args.limit else tables.write(normalise(docs), args.out, args.old)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
