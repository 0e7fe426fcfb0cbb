"""Counts of words and word runs where their row lies: only rows that share a key meet in a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import stem
from ..shipping import small_batches

#: Words counted at once, so that a task's memory does not follow the size of a batch.
_WORDS = 1 << 16
#: Bits of the map of keys that several rows have: 1 MB, whatever the input.
_BITS = 1 << 23

_stem = lru_cache(1 << 17)(stem)


def by_key(rows: DataFrame, key: str, units: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose key no other row has, all others). A null key is a key.

    With `units`, (key, ...), keys are told apart by how many rows they have there.

    Only keys are shuffled. A bitmap of fixed size tells the two apart; its collisions put
    a few single rows among the others, which take the longer way to the same result.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(_BITS))
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    again = (rows if units is None else units).groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(slot.alias("_slot"))
    bits = again.groupBy(F.expr("_slot div 64").alias("_at")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_slot", slot).withColumn("_at", F.expr("_slot div 64")).join(F.broadcast(bits), "_at", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.filter(~hit).select(*rows.columns), marked.filter(hit).select(*rows.columns)


def counted(rows: DataFrame, key: str, words: Column | Callable[[DataFrame], DataFrame], longest: int = 1, into: str = "term", count: str = "tf", stems: bool = False) -> DataFrame:
    """(key, into, count): how often each run of 1 to `longest` words is among the words of a key's rows.

    words: an array of strings, or what makes (key, _w) of a part of the rows. Runs don't
    cross rows. Words are stemmed first if `stems`. Counts are longs.
    """
    make = (lambda part: part.select(key, words.alias("_w"))) if isinstance(words, Column) else words
    single, several = by_key(rows, key)
    once, again = (_in_rows(make(part).select(key, "_w"), key, longest, into, count, stems) for part in (single, several))
    return once.unionByName(again.groupBy(key, into).agg(F.sum(count).alias(count)).select(key, into, count))


def placed(rows: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, term, tf, positions): counts and places, from 0, of each word of a row; of rows that share a key one counts."""
    single, several = (part.select(key, words.alias("_w")) for part in by_key(rows, key))
    return _in_rows(single.unionByName(several.dropDuplicates([key])), key, 1, "term", "tf", False, places=True)


def _in_rows(rows: DataFrame, key: str, longest: int, into: str, count: str, stems: bool, places: bool = False) -> DataFrame:
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            i = 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _WORDS, "right")))
                for columns in _runs(lists.slice(i, j - i).flatten(), sizes[i:j], longest, stems, places):
                    yield pa.RecordBatch.from_arrays([keys.slice(i, j - i).take(pa.array(columns[0])), *columns[1:]], names=names)
                i = j

    names = [key, into, count, *(["positions"] if places else [])]
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, `{into}` string, `{count}` long" + (", positions array<int>" if places else ""))


def _runs(words: pa.Array, sizes: np.ndarray, longest: int, stems: bool, places: bool) -> Iterator[tuple]:
    """For each length of runs: rows, runs, counts and perhaps places, of words that lie row by row."""
    coded = words.dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if stems:
        coded = pa.array([_stem(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64)[code], coded.dictionary
    row = np.repeat(np.arange(len(sizes)), sizes)
    many, ids, bound = max(1, len(names)), code, max(1, len(names))
    for n in range(1, longest + 1):
        if n > 1:
            if bound * many >= 1 << 62:
                ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
                bound = len(ids) + 1
            ids, bound = ids[: len(ids) - 1] * many + code[n - 1 :], bound * many
        inside = row[: len(ids)] == row[n - 1 :]
        at = np.flatnonzero(inside)
        if not len(at):
            return
        if bound * len(sizes) < 1 << 62:
            both = row[at] * bound + ids[at]
        else:
            both = np.unique(ids[at], return_inverse=True)[1].astype(np.int64) + row[at] * len(at)
        order = np.argsort(both, kind="stable")
        sorted_ = both[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        first = at[order[starts]]
        count = np.diff(np.append(starts, len(at)))
        parts = [names.take(pa.array(code[first + x])) for x in range(n)]
        text = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        extra = []
        if places:
            begin = np.cumsum(sizes) - sizes
            where = at[order]
            extra = [pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(where - begin[row[where]], pa.int32()))]
        yield (row[first], text, pa.array(count, pa.int64()), *extra)
