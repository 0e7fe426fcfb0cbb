"""Approximate nearest neighbours by an inverted multi-index.

Vectors are split in two halves, each quantised by its own codebook; a pair of centroids
is a cell. A query visits cells by the sum of its two half distances, with a heap, until
they hold the wanted share of the vectors, and the entries of those cells are reranked by
exact cosine. Every vector is indexed; codebooks grow with the table and are fitted on a
sample that grows with them. Vectors of each length have an index of their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, partitions, released, small_batches, staged
from .vectors import matrix, unit, usable

#: Vectors of one block at most, and at least in a table with few of them; queries for which a block is sent once.
BLOCK, SMALL_BLOCK, CHUNK = 8_192, 256, 65_536
#: Centroids of a half: n ** 0.4 for n vectors, within these bounds; sampled vectors a centroid.
CENTROIDS, SAMPLE = (32, 1_024), 64
#: Share of the vectors whose cells a query visits.
SHARE = 0.6


@dataclass
class Index:
    """The cells of every vector length, numbered one after the other, and the blocks they lie in."""

    books: dict[int, tuple[np.ndarray, np.ndarray]]  # by length
    base: dict[int, int]  # first cell of each length
    counts: np.ndarray  # vectors in each cell
    first: np.ndarray  # first block of each cell
    parts: np.ndarray  # blocks of each cell; more than one for a large cell


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * x @ book.T


def traverse(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """Cells (row * len(b) + column) in order of a[row] + b[column] until they hold `wanted` entries."""
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, found, total = [(a[order_a[0]] + b[order_b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(order_a[i]) * len(b) + int(order_b[j])
        found.append(cell)
        total += int(counts[cell])
        for p in ((i + 1, j), (i, j + 1)):
            if p[0] < len(a) and p[1] < len(b) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (a[order_a[p[0]]] + b[order_b[p[1]]], *p))
    return np.array(found, np.int64)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def _far(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Distances of both halves of each row to the centroids of their codebooks."""
    return [distances(h, book) for h, book in zip(_halves(unit(x)), books, strict=True)]


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) for each length in a batch."""
    lengths = np.asarray(column.value_lengths())
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield int(n), rows, matrix(column.take(pa.array(rows)))


def fit_books(rows: DataFrame, sizes: dict[int, int], rounds: int = 8, seed: int = 9) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks of both halves for every length, from about SAMPLE vectors a centroid, taken by hash.

    sizes: vectors of each length. A length with few vectors has all of them in its sample.
    """
    spark = rows.sparkSession
    wanted = {n: min(max(CENTROIDS[0], math.ceil(count**0.4)), CENTROIDS[1]) for n, count in sizes.items()}
    share = spark.createDataFrame([(n, min(1.0, SAMPLE * wanted[n] / count)) for n, count in sizes.items()], "size int, share double")
    hashed = rows.select(F.size("embedding").alias("size"), F.xxhash64("vec_id", "embedding").alias("h"), "embedding")
    chosen = join_small(hashed, share, "size").filter(F.pmod("h", F.lit(1 << 31)) < F.col("share") * (1 << 31))
    got = chosen.groupBy("size", "h").agg(F.first("embedding").alias("embedding")).toArrow().sort_by([("size", "ascending"), ("h", "ascending")])
    rng = np.random.default_rng(seed)
    books = {n: tuple(_kmeans(h, wanted[n], rounds, rng) for h in _halves(unit(x))) for n, _, x in _by_length(got["embedding"].combine_chunks())}
    # No row of a large length may fall into the sample only if its hashes are alike; one centroid then serves.
    return {n: books.get(n, (np.zeros((1, n // 2)), np.zeros((1, n - n // 2)))) for n in sizes}


def _in_cells(rows: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray]], base: dict[int, int]) -> DataFrame:
    """(vec_id, embedding, cell) of all rows."""
    sent = rows.sparkSession.sparkContext.broadcast((books, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, base = sent.value
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            for n, some, x in _by_length(batch.column("embedding")):
                a, b = (d.argmin(1) for d in _far(x, books[n]))
                cells[some] = base[n] + a * len(books[n][1]) + b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["vec_id", "embedding", "cell"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(released(run), f"vec_id long, embedding {kind}, cell int")


def build(rows: DataFrame) -> tuple[DataFrame, Index]:
    """(vec_id, embedding, cell) of all rows and the index; one count a length and a cell reaches the driver.

    Small cells of one length share blocks; a larger cell has several. Blocks hold at most BLOCK
    vectors, fewer where a table would otherwise give less than two blocks a task.
    """
    sizes = {r["n"]: r["count"] for r in rows.groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect()}
    books = fit_books(rows, sizes)
    base, cells = {}, 0
    for n in sizes:
        base[n], cells = cells, cells + len(books[n][0]) * len(books[n][1])
    entries = staged(_in_cells(rows, books, base))
    counts = np.zeros(cells, np.int64)
    found = entries.groupBy("cell").count().toArrow()
    counts[found["cell"].to_numpy()] = found["count"].to_numpy()
    most = min(BLOCK, max(SMALL_BLOCK, int(counts.sum()) // (2 * partitions(rows.sparkSession))))
    first, parts, block, room, borders = np.zeros(cells, np.int64), np.maximum(1, -(-counts // most)), 0, most, set(base.values())
    for cell, n in enumerate(counts.tolist()):
        if room < most and (n > room or cell in borders):
            block, room = block + 1, most
        first[cell] = block
        room -= n
        if parts[cell] > 1:
            block, room = block + int(parts[cell]), most
    return entries, Index(books, base, counts, first, parts)


def _visits(queries: DataFrame, index: Index, share: float, least: int) -> DataFrame:
    """(vec_id, embedding, block, cells): each query once for each block it visits, with the cells it visits there."""
    sent = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for batch in batches:
            for n, some, x in _by_length(batch.column("embedding")):
                if n not in ix.base:
                    continue
                low, size = ix.base[n], len(ix.books[n][0]) * len(ix.books[n][1])
                counts = ix.counts[low : low + size]
                wanted = max(least, math.ceil(share * int(counts.sum())))
                a, b = _far(x, ix.books[n])
                for i, row in enumerate(some.tolist()):
                    cells = traverse(a[i], b[i], counts, wanted)
                    cells = low + cells[counts[cells] > 0]
                    times = ix.parts[cells]
                    block = np.repeat(ix.first[cells], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    cells = np.repeat(cells, times)
                    order = np.lexsort((cells, block))
                    block, cells = block[order], cells[order].astype(np.int32)
                    cuts = np.flatnonzero(np.diff(block, prepend=-1)) if len(block) else np.zeros(0, np.int64)
                    if len(cuts):
                        one = pa.array(np.full(len(cuts), row))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(block)).astype(np.int32)), pa.array(cells))
                        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(one), batch.column("embedding").take(one), pa.array(block[cuts].astype(np.int32)), lists], names=["vec_id", "embedding", "block", "cells"])

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.select("vec_id", "embedding").mapInArrow(released(run), f"vec_id long, embedding {kind}, block int, cells array<int>")


class _Block:
    """The entries of one block, ready to be asked."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        x = np.concatenate([matrix(b.column("embedding")) for b in batches])
        self.ids = np.concatenate([b.column("vec_id").to_numpy() for b in batches])
        self.cells, self.of = np.unique(np.concatenate([b.column("cells").flatten().to_numpy() for b in batches]), return_inverse=True)
        self.near, self.x = unit(x), x / np.abs(x).max(1, keepdims=True)
        self.length = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))

    def ask(self, batch: pa.RecordBatch, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, cosines) of the `top` best entries of each query in the cells it visits."""
        q = matrix(batch.column("embedding"))
        rough = unit(q) @ self.near.T
        q = q / np.abs(q).max(1, keepdims=True)
        cells = batch.column("cells")
        for i, me in enumerate(batch.column("vec_id").to_pylist()):
            wanted = np.isin(self.cells, cells[i].values.to_numpy(), assume_unique=True)
            ok = np.flatnonzero(wanted[self.of] & (self.ids != me))
            if len(ok) > top:
                s = rough[i, ok]
                ok = ok[s >= np.partition(s, -top)[-top] - 1e-9]
            exact = np.einsum("ij,j->i", self.x[ok], q[i]) / (self.length[ok] * np.sqrt(np.einsum("j,j->", q[i], q[i])))
            best = np.lexsort((self.ids[ok], -exact))[:top]
            yield me, self.ids[ok[best]], exact[best]


def _rerank(top: int):
    """Rows sorted by (block, chunk, side): the entries of a block come first and stay, its queries then pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            key = batch.column("block").to_numpy().astype(np.int64) << 32 | batch.column("chunk").to_numpy()
            side = batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(side, prepend=-1) != 0))
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if key[a] != at:
                    at, held, block = key[a], [], None
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    block, held = _Block(held), []
                if block is not None:
                    for i in range(0, part.num_rows, 128):
                        found = list(block.ask(part.slice(i, 128), top))
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 5, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its `top` nearest rows of vectors of its length.

    Both have vec_id and embedding. A query visits cells until they hold `share` of the vectors
    of its length; its own vec_id is no candidate. Ties go to the smaller vec_id. Vectors that
    are null, zero, hold null or non-finite components or lack an id take no part. Rows that
    repeat a vec_id are one candidate with its best score. Every vector is shuffled once for
    CHUNK queries; its block is held while the queries that visit it pass by, so a task's memory
    does not grow with them.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    if rows.isEmpty():
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).filter("false")
    entries, index = build(rows)
    chunks = math.ceil(max(1, asked.count()) / CHUNK)
    sent = vectors.sparkSession.sparkContext.broadcast((index.first, index.parts))

    def blocks(cells: pa.Array, hashes: pa.Array) -> pa.Array:
        first, parts = sent.value
        c = cells.to_numpy()
        return pa.array((first[c] + hashes.to_numpy() % parts[c]).astype(np.int32))

    block = F.arrow_udf(blocks, "int")
    dealt = entries.withColumn("block", block("cell", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)))).select("vec_id", "embedding", "block", F.array("cell").alias("cells"))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("side", F.lit(0))
    asking = _visits(asked, index, share, top + 1).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).withColumn("side", F.lit(1))
    both = dealt.unionByName(asking).repartition(partitions(vectors.sparkSession), "block", "chunk").sortWithinPartitions("block", "chunk", "side")
    found = both.mapInArrow(released(_rerank(top)), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
