"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are hashed by quantised random projections in several tables. Members
of a bucket first meet as sketches, a few bytes whose distance never exceeds that of the
vectors; only those with a partner that may be near meet again with their vectors, and
exact cosines decide. Pairs are counted, not emitted: each pair counts in the first table
in which it shares a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, release, released, small_batches, staged
from .components import components
from .vectors import matrix, unit, usable
from .wordhash import mix

#: Quantisation step in units of the distance at the threshold; expected bucket size; chance that a link is missed.
STEP, BUCKET, MISS = 6.0, 256, 1e-5
#: Dimensions of a sketch, a byte each.
SKETCH = 32
#: Sketches, and vectors, of a bucket that meet in one group; rows of small buckets that share a group.
SKETCHES, BLOCK, PACK = 4_096, 384, 16_384


def collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection agrees for points at this distance."""
    r = width / distance
    return 1 - 2 * 0.5 * math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(rows: int, cosine: float) -> tuple[int, int, float]:
    """(projections a table, tables, width): buckets of unrelated vectors stay near BUCKET
    rows, and a pair at the threshold is missed by all tables with chance MISS at most."""
    near = math.sqrt(2 - 2 * cosine)
    width = STEP * near
    far = collision(math.sqrt(2), width)
    k = max(2, round(math.log(max(rows, BUCKET) / BUCKET) / math.log(1 / far)))
    return k, math.ceil(math.log(MISS) / math.log(1 - collision(near, width) ** k)), width


def _keys(x: np.ndarray, label: np.ndarray, k: int, tables: int, width: float, seed: int = 41) -> np.ndarray:
    """Bucket of each row in each table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a, b = rng.normal(size=(x.shape[1], tables * k)), rng.uniform(0, width, tables * k)
    cells = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    out = mix(label.astype(np.int64).view(np.uint64)[:, None] + np.arange(tables, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1]))
    for j in range(k):
        out = mix(out ^ (cells[:, :, j] + np.uint64(j)))
    return out.view(np.int64)


def _sketches(x: np.ndarray, seed: int = 43) -> np.ndarray:
    """Bytes of unit vectors on SKETCH orthonormal directions; short vectors keep all their components."""
    if x.shape[1] > SKETCH:
        x = x @ np.linalg.qr(np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], SKETCH)))[0]
    return np.rint(x * 127).astype(np.int8)


def _hashed(classes: DataFrame, k: int, tables: int, width: float) -> DataFrame:
    """(node, copies, embedding, keys, sketch) of all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("size").to_numpy()
            keys, sketch = np.zeros((batch.num_rows, tables), np.int64), np.full(batch.num_rows, b"", object)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                x = unit(matrix(batch.column("embedding").take(pa.array(rows))))
                keys[rows] = _keys(x, batch.column("label").to_numpy()[rows], k, tables, width)
                sketch[rows] = [r.tobytes() for r in _sketches(x)]
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), batch.column("embedding"), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))), pa.array(sketch, pa.binary())], names=["node", "copies", "embedding", "keys", "sketch"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.select("node", "copies", F.xxhash64("label").alias("label"), F.size("embedding").alias("size"), "embedding").mapInArrow(released(run), f"node long, copies long, embedding {kind}, keys array<long>, sketch binary")


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """Add pack, i, j and part to rows(bucket, node, ...): groups in which all pairs of a bucket meet.

    A bucket of more than `most` rows is dealt in parts by hash, and every pair of parts is a
    pack; all other buckets share packs of about PACK rows.
    """
    large = staged(rows.groupBy("bucket").count().filter(F.col("count") > most).select("bucket", F.ceil(F.col("count") / most).cast("int").alias("parts")))
    packs = max(1, math.ceil(rows.count() / PACK))
    rows = join_small(rows, large, "bucket")
    rows = rows.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(0))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    return rows.withColumn("pack", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(F.xxhash64("bucket", "i", "j"))).drop("other", "parts")


def _segments(table: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
    """A pack sorted by bucket, and where its buckets of more than one row start and end."""
    table = table.combine_chunks().sort_by([("bucket", "ascending"), ("node", "ascending")]).combine_chunks()
    bucket = table["bucket"].to_numpy()
    borders = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist()
    return table, [(a, b) for a, b in zip(borders[:-1], borders[1:], strict=True) if b - a > 1]


def _maybe_near(cosine: float):
    """(bucket, node) of the members that may have a near partner in the bucket, by their sketches."""
    reach = 127 * math.sqrt(2 - 2 * cosine)

    def run(table: pa.Table) -> pa.Table:
        table, segments = _segments(table)
        node, part = table["node"].to_numpy(), table["part"].to_numpy()
        sketch = pa.concat_arrays(table["sketch"].chunks)
        at = np.frombuffer(sketch.buffers()[1], np.int32)[sketch.offset : sketch.offset + len(sketch) + 1]
        data = np.frombuffer(sketch.buffers()[2], np.int8)
        kept = np.zeros(len(node), bool)
        for a, b in segments:
            s = data[at[a] : at[b]].reshape(b - a, -1).astype(np.float32)
            square = (s * s).sum(1)
            # Rounding moves each sketch by at most half the root of its length.
            near = square[:, None] + square[None, :] - 2 * (s @ s.T) <= (reach + math.sqrt(s.shape[1]) + 1e-3) ** 2
            if table["i"][a].as_py() != table["j"][a].as_py():
                near &= part[a:b, None] != part[None, a:b]
            np.fill_diagonal(near, False)
            kept[a:b] = near.any(1)
        release()
        return table.select(["bucket", "node"]).filter(pa.array(kept))

    return run


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table, segments = _segments(table)
        bucket, node, copies, part = (table[c].to_numpy() for c in ("bucket", "node", "copies", "part"))
        keys, vectors = pa.concat_arrays(table["keys"].chunks).flatten().to_numpy().reshape(len(node), -1), pa.concat_arrays(table["embedding"].chunks)
        links, root = np.zeros(len(node), np.int64), node.copy()
        for low, high in segments:
            x = unit(matrix(vectors.slice(low, high - low)))
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            if table["i"][low].as_py() != table["j"][low].as_py():
                near &= part[low:high, None] != part[None, low:high]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            mine, new = keys[low:high], np.ones(len(a), bool)
            for t in range(int(np.flatnonzero(mine[0] == bucket[low])[0])):  # an earlier table has counted the pair
                new &= mine[a, t] != mine[b, t]
            links[low:high] += np.bincount(a[new], copies[low + b[new]], high - low).astype(np.int64)
            names = node[low:high].copy()
            while True:
                least = names.copy()
                np.minimum.at(least, a, names[b])
                if (least == names).all():
                    break
                names = least
            root[low:high] = names
        release()
        some = (links > 0) | (root != node)
        return pa.table({"node": node[some], "links": links[some], "root": root[some]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors(vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine in doubles is at
    least `cosine`. Null or zero vectors, those with null or non-finite components and those
    without vec_id link with nothing; vectors of different lengths do not link. Equal vectors of a label are one class before
    anything is compared; each of its rows has its copies among its links. A row without
    vec_id has component null and is kept.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("fit", usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = staged(rows.filter("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables, width = parameters(most, cosine)
    hashed = staged(_hashed(classes, k, tables, width))
    posts = hashed.select("node", "sketch", F.explode("keys").alias("bucket"))
    maybe = _dealt(posts, SKETCHES).groupBy("pack", "i", "j").applyInArrow(_maybe_near(cosine), "bucket long, node long")
    maybe = staged(maybe.distinct())
    whole = _dealt(maybe, BLOCK).join(hashed.drop("sketch").hint("merge"), "node")
    found = staged(whole.groupBy("pack", "i", "j").applyInArrow(_compare(cosine), "node long, links long, root long"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("root <> node"), "node", "root")
    named = classes.join(sums.hint("merge"), "node", "left").join(roots.hint("merge"), "node", "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    linked = rows.filter("fit").drop("fit").join(named.hint("merge"), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
