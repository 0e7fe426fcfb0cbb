"""Helpers shared by the operators: lineage cuts, ordered prefix sums, skew-safe joins."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship, small_batches  # noqa: F401  (operators take small_batches from here)

#: Rows of a per-key side table up to which it is broadcast; beyond it the join is salted.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if configured:
        if current.isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stockpot-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def release() -> None:
    """Give memory that a batch needed back to the system, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(step):
    """An Arrow step that releases memory whenever its input ends."""

    def run(batches):
        yield from step(batches)
        release()

    return run


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage and keep partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder (compressed, column-pruned on reuse)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stockpot-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_prefix(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Add `<value>_before`: the sum of `value` over all rows that precede in the order of `keys`.

    Rows are range-partitioned and sorted once (a hot leading key is split by the
    later keys), the sorted partitions are checkpointed, only one total per partition
    reaches the driver, and a second pass over the checkpoint adds running sums.
    Rows that tie on all keys get an arbitrary order among themselves.
    """
    spark = df.sparkSession
    ship(spark)
    ranged = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    ranged = checkpointed(ranged.withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(v).cast("long").alias(v) for v in values]).collect()
    size = 1 + max((r["_part"] for r in totals), default=0)
    before = {}
    for v in values:
        sums = np.zeros(size + 1, np.int64)
        for r in totals:
            sums[r["_part"] + 1] = r[v]
        before[v] = np.cumsum(sums)
    schema = StructType(list(ranged.schema.fields))
    for v in values:
        schema = schema.add(f"{v}_before", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = list(batch.columns)
            for v in values:
                sizes = batch.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
                start = at.get(v, int(before[v][batch.column("_part")[0].as_py()]))
                ends = start + np.cumsum(sizes)
                at[v] = int(ends[-1])
                columns.append(pa.array(ends - sizes))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *[f"{v}_before" for v in values]])

    return ranged.mapInArrow(released(run), schema).drop("_part")


def hash_sample(rows: DataFrame, h: str, most: int) -> DataFrame:
    """(h): at most `most` distinct values of a hash column, the same for the same rows.

    Rows are first thinned by their hash to a little more than `most` in expectation, so
    that neither a task nor the driver gets more than that, however many tasks there are.
    """
    n = max(1, rows.count())
    share = min(1.0, (most + 6 * most**0.5) / n)
    few = rows.select(h).filter(F.pmod(h, F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))) if share < 1 else rows.select(h)
    return few.distinct().orderBy(h).limit(most)


def join_small(rows: DataFrame, side: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """Left join of many rows with a table of one row per non-null key.

    The side is broadcast after a count shows it within BROADCAST_ROWS; a larger one is
    repeated for every salt, so that rows of a hot key spread over `salts` tasks.
    """
    if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), key, "left")
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return spread.join(salted, [key, "_salt"], "left").drop("_salt")
