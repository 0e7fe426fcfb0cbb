"""Places of regular expression matches, in code points, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def running_sums(values: Column) -> Column:
    """Sums of the elements before each element of array<bigint>, in blocks so that long arrays stay cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda i: F.slice(values, i * _BLOCK + 1, F.lit(_BLOCK)))
    zero = F.lit(0).cast("bigint")
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    total = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x))
    bases = F.aggregate(total, F.array(zero), grow)
    inner = F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(bases) - 1), lambda b, base: F.slice(F.aggregate(b, F.array(base), grow), F.lit(1), F.size(b)))
    return F.when(F.size(values) > 0, F.flatten(inner)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start bigint, end bigint, value string>> of the leftmost non-overlapping, never empty matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("len"), m.alias("value")))
    # The running sum before match i covers the gaps and matches before it; its own gap is added.
    before = running_sums(F.transform(pairs, lambda p: p["gap"] + p["len"]))
    out = F.zip_with(pairs, before, lambda p, b: F.struct((b + p["gap"]).alias("start"), (b + p["gap"] + p["len"]).alias("end"), p["value"].alias("value")))
    return F.when(F.size(found) > 0, out).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))
