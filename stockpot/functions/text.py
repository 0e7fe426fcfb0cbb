"""Tokenising as Column expressions: everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, in order; other characters separate. Null gives an empty array."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\\s]", " ")
    return F.filter(F.split(clean, "\\s+"), lambda w: F.length(w) > 0)


def tokens(text: Column) -> Column:
    """The words of at least two characters: what the index holds."""
    return F.filter(words(text), lambda w: F.length(w) >= 2)


def letter_runs(text: Column) -> Column:
    """Lower-cased runs of ASCII letters: the words of the n-gram engine. Bytes of other characters separate."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: F.length(w) > 0)


def clean_nullable(text: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def positions(sections: list[Column], docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, position): every token of the sections in turn, positions counted across sections from 0."""
    merged = F.concat(*[tokens(s) for s in sections])
    return docs.select(key, F.posexplode(merged).alias("position", "term"))
