"""Small aggregates: latency statistics, counts by kind, round deltas and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, value: str, by: list[str], points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(by..., p<point>...): exact nearest-rank percentiles, the ceil(p / 100 * n)-th smallest.

    Values are counted first, so ranks come from running sums over distinct values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy(*by).orderBy(value)
    counts = counts.withColumn("_upto", F.sum("_n").over(up_to)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = lambda p: F.min(F.when(F.col("_upto") >= F.ceil(F.lit(p) * F.col("_all") / 100), F.col(value))).alias(f"p{p}")
    return counts.groupBy(*by).agg(*[at(p) for p in points])


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., count, min, max, mean, p50, p95, p99) of a value."""
    base = rows.groupBy(*by).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return base.join(nearest_rank(rows, value, by), by, "left")


def count_by(rows: DataFrame, kind: str) -> DataFrame:
    return rows.groupBy(kind).agg(F.count("*").alias("n"))


def deltas(rounds: DataFrame, order: str, value: str, by: list[Column] | None = None) -> DataFrame:
    """Add `<value>_delta`: growth since the row before, the value itself in the first row."""
    before = F.lag(value).over(Window.partitionBy(*(by or [])).orderBy(order))
    return rounds.withColumn(f"{value}_delta", F.col(value) - F.coalesce(before, F.lit(0)))


def write_rounds(rounds: DataFrame, folder: str) -> None:
    rounds.coalesce(1).orderBy("round").write.mode("overwrite").option("header", True).csv(folder)


def write_metrics(metrics: DataFrame, folder: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(folder)
