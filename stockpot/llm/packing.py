"""Packing of tokenised documents into fixed windows by non-negative least squares.

Documents are cut into windows and a remainder. Remainder lengths are put in a histogram
of bounded size; shallow combinations of bins that fill a window are enumerated, repeat
counts are solved against the histogram by non-negative least squares, rounded down, and
the residual histogram is packed greedily. Pieces then take places by their rank in their bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ordered_prefix, released, small_batches, staged

#: Texts with other characters than these, or longer ones, go to the slower encoder; the ids are the same.
_PLAIN = 0x250
LONG = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set (Lawson and Hanson, 1974)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    slope = a.T @ b
    for _ in range(rounds or 3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min() > 0:
                x = s
                break
            bad = free & (s <= 0)
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            free &= x > 1e-12 * max(1.0, x.max())
            x[~free] = 0
            if not free.any():
                break
    return x


def combinations(bins: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All ways to fill `bins` with 1 to `depth` parts, largest first."""
    found: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(parts)
        elif len(parts) < depth:
            for p in range(min(left, parts[-1] if parts else left), 0, -1):
                extend((*parts, p), left - p)

    extend((), bins)
    return found


def solve(histogram: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(parts, repeats) that place every piece: histogram[k] pieces of k bins, k = 1..bins."""
    left = histogram.astype(np.int64).copy()
    bins = len(left) - 1
    plans: list[tuple[tuple[int, ...], int]] = []
    if left[bins]:  # whole windows are a sequence each
        plans.append(((bins,), int(left[bins])))
        left[bins] = 0
    if left.sum():
        ways = [w for w in combinations(bins, depth) if len(w) > 1]
        use = np.zeros((bins, len(ways)))
        for j, way in enumerate(ways):
            for part in way:
                use[part - 1, j] += 1
        repeats = nnls(use, left[1:].astype(float))
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] < 1:
                break
            need = use[:, j].astype(np.int64)
            most = min(int(left[p] // need[p - 1]) for p in set(ways[j]))
            if (n := min(int(repeats[j]), most)) > 0:
                plans.append((ways[j], n))
                left[1:] -= n * need
    while left.sum():  # each turn uses up a bin
        parts: list[int] = []
        spare, gap = left.copy(), bins
        for p in range(bins, 0, -1):
            n = min(int(spare[p]), gap // p)
            parts += [p] * n
            gap -= n * p
        need = np.bincount(parts, minlength=bins + 1)
        n = int((left[need > 0] // need[need > 0]).min())
        plans.append((tuple(parts), n))
        left -= n * need
    return plans


def _encoder(path: str):
    """A function from texts to lists of ids: those of the tokenizers file without special tokens added.

    Added tokens that stand in a text keep their own ids, as the tokenizers library gives them.
    Latin texts up to LONG characters go to a faster library with the same vocabulary, all others,
    and those that hold an added token, to the tokenizers library.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(Path(path).read_text())
    # The same ranks as a byte table: the file's alphabet maps printable characters to bytes.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    others: list[Tokenizer] = []  # loaded when a text needs it

    def encode(text: str) -> list[int]:
        if len(text) <= LONG and (text.isascii() or ord(max(text)) < _PLAIN) and not any(t in text for t in added):
            return fast.encode_ordinary(text)
        if not others:
            others.append(Tokenizer.from_file(path))
        return others[0].encode(text, add_special_tokens=False).ids

    return encode


def pieces(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, end: int = 1) -> DataFrame:
    """Each document's ids and then `end`, cut into windows and a remainder: PIECES.

    A null text is empty and still has its end id. Repeated rows give repeated pieces.
    tokenizer: path of a tokenizers file; by default the installed public byte-level one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer:
            path = tokenizer
        else:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        encode = _encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = np.array([*encode(texts[i].as_py() or ""), end], "<u4")
                rows += [(doc, s, min(window, len(ids) - s), zlib.crc32(ids[s : s + window].tobytes()), len(ids)) for s in range(0, len(ids), window)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, end: int = 1, bin_width: int = 16, depth: int = 3) -> DataFrame:
    """PIECES and sequence_id, offset: every piece of `docs` with its place.

    Only the histogram (window / bin_width counts) reaches the driver. Texts are read once
    and never shuffled; pieces are ranked within their bin over a range sort, so that a hot
    length is spread over tasks. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bins = window // bin_width
    cut = staged(pieces(docs, tokenizer, window, end).withColumn("bin", F.ceil(F.col("length") / bin_width).cast("int")))
    histogram = np.zeros(bins + 1, np.int64)
    for r in cut.groupBy("bin").count().collect():
        histogram[r["bin"]] = r["count"]
    plans = solve(histogram, depth)
    # For each bin: the patterns that use it, as first rank, first sequence, places a sequence and first place.
    base, sequence = np.cumsum(histogram) - histogram, 0
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros(bins + 1, np.int64)
    for parts, repeats in plans:
        for p in dict.fromkeys(parts):
            m = parts.count(p)
            entries.setdefault(p, []).append((int(used[p]), sequence, m, parts.index(p)))
            used[p] += m * repeats
        sequence += repeats
    tables = {p: tuple(np.array(c, np.int64) for c in zip(*e, strict=True)) for p, e in entries.items()}
    ranked = ordered_prefix(cut.withColumn("one", F.lit(1).cast("long")).withColumn("h", F.xxhash64("doc_id", "start", "ids_crc32")), ["bin", "h"], ["one"])
    schema = f"{PIECES}, sequence_id long, place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column("bin").to_numpy()
            rank = batch.column("one_before").to_numpy() - base[b]
            sequence_id, place = np.zeros(len(b), np.int64), np.zeros(len(b), np.int32)
            for p in np.unique(b):
                rows = b == p
                first, seq, m, slot = tables[int(p)]
                j = np.searchsorted(first, rank[rows], "right") - 1
                at = rank[rows] - first[j]
                sequence_id[rows] = seq[j] + at // m[j]
                place[rows] = slot[j] + at % m[j]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")], pa.array(sequence_id), pa.array(place)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])

    placed = ranked.mapInArrow(released(run), schema)
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
