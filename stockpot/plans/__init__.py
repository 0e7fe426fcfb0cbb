"""Whole plans: index build, hybrid query, crawl."""
