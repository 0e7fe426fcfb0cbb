"""A tailed queue of URLs: new lines are crawled and indexed until a stop line or everything is visited."""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STOP = "stop"


def read_queue(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (url) lines from text files as they arrive."""
    return spark.readStream.text(folder).select(F.trim("value").alias("url")).filter("url <> ''")


def start_queue(urls: DataFrame, handle: Callable[[DataFrame], object], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hand each batch's distinct URLs to `handle`, as files arrive, until a batch holds the stop line or `handle` returns true.

    The batch in which that happens is the last that is committed: batches after it fail, so that
    their URLs come again when the queue is started anew. tail() waits for the end and stops the stream.
    """
    ended = threading.Event()

    def step(batch: DataFrame, _: int) -> None:
        if ended.is_set():
            raise RuntimeError("the queue was stopped")
        seen = batch.select("url").distinct()
        done = handle(seen.filter(F.col("url") != STOP))
        if done or not seen.filter(F.col("url") == STOP).isEmpty():
            ended.set()

    found = urls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    found = found.trigger(processingTime=every) if every else found.trigger(availableNow=True)
    running = found.start()
    running.ended = ended
    return running


def tail(running: StreamingQuery, timeout: float | None = None) -> bool:
    """Wait until the queue has ended (or `timeout` seconds), stop its stream and say whether it had ended."""
    start = time.monotonic()
    while not running.ended.wait(0.2) and running.isActive and (timeout is None or time.monotonic() - start < timeout):
        pass
    with contextlib.suppress(Exception):  # a batch after the stop line fails on purpose
        running.processAllAvailable()  # the batch with the stop line is committed
    running.stop()
    return running.ended.is_set()
