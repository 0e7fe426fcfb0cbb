"""The map-reduce facade: user functions over keyed JSON records, for parity. Prefer DataFrame operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

Mapper = Callable[[str, object], Iterable[dict]]
Reducer = Callable[[str, list], object]


def map_records(rows: DataFrame, mapper: Mapper) -> DataFrame:
    """(key, value): the single-key objects that the mapper makes of each (key, JSON value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(str(k), json.dumps(v)) for key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True) for made in mapper(key, json.loads(value)) for k, v in made.items()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([v for _, v in out], pa.string())], names=["key", "value"])

    ship(rows.sparkSession)
    return rows.select("key", "value").mapInArrow(run, "key string, value string")


def reduce_records(pairs: DataFrame, reducer: Reducer) -> DataFrame:
    """(key, value): the reducer's result for each key and its values in JSON order; None results are left out.

    The values of a key meet in one task, as the contract of a reducer asks; aggregates that
    can be combined belong in groupBy().agg() instead.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = group["key"].iloc[0]
        made = reducer(key, [json.loads(v) for v in sorted(group["value"])])
        return pd.DataFrame([] if made is None else [(key, json.dumps(made))], columns=["key", "value"])

    return pairs.groupBy("key").applyInPandas(run, "key string, value string")


def map_reduce(rows: DataFrame, mapper: Mapper, reducer: Reducer) -> DataFrame:
    return reduce_records(map_records(rows, mapper), reducer)


def run_job(rows: DataFrame, mapper: Mapper, reducer: Reducer) -> DataFrame:
    """map_reduce with the results as a table of JSON objects {key: value}."""
    return map_reduce(rows, mapper, reducer).select(F.to_json(F.create_map("key", "value")).alias("result"))
