"""Spelling suggestions: candidate edits joined with the vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Words of this length or more get a second round of edits if the first finds nothing, up to SECOND candidates.
LONG, SECOND = 6, 600


def _edits(word: str) -> Iterator[str]:
    """Deletions, swaps, replacements and insertions, in this order, with repeats: 74n + 35 of them."""
    halves = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    yield from (a + b[1:] for a, b in halves if b)
    yield from (a + b[1] + b[0] + b[2:] for a, b in halves if len(b) > 1)
    yield from (a + c + b[1:] for a, b in halves if b for c in ALPHABET)
    yield from (a + c + b for a, b in halves for c in ALPHABET)


def edits(word: str) -> list[str]:
    """Distinct single edits in order of their first appearance; none of an empty word."""
    return list(dict.fromkeys(_edits(word))) if word else []


def double_edits(word: str, most: int = 800) -> list[str]:
    """The first `most` distinct words two edits away, in order."""
    found: dict[str, None] = {}
    for once in edits(word):
        for twice in edits(once):
            found[twice] = None
            if len(found) >= most:
                return list(found)
    return list(found)


def tag_token(tag: str) -> str:
    """Lower-cased letters and digits of a tag."""
    return re.sub(r"[^a-z0-9]", "", tag.lower())


def tag_tokens(tag: Column) -> Column:
    """tag_token of a column."""
    return F.regexp_replace(F.lower(tag), "[^a-z0-9]", "")


def _ranked(spark: SparkSession, pairs: list[tuple[str, str]], scores: DataFrame) -> dict[str, str]:
    """For each token its best candidate: vocabulary rows meet the broadcast candidates in one join."""
    if not pairs:
        return {}
    candidates = F.broadcast(spark.createDataFrame(pairs, "token string, term string"))
    best = Window.partitionBy("token").orderBy(F.desc("score"), "term")
    rows = scores.filter("score > 0").join(candidates, "term").withColumn("n", F.row_number().over(best))
    return {r["token"]: r["term"] for r in rows.filter("n = 1").collect()}


def best_words(spark: SparkSession, tokens: list[str], scores: DataFrame) -> dict[str, str]:
    """Best known word for each token that has one: scores(term, score), larger first, ties by word."""
    tokens = [t for t in dict.fromkeys(tokens) if t]
    found = _ranked(spark, [(t, e) for t in tokens for e in edits(t) if e and e != t], scores)
    more = [t for t in tokens if t not in found and len(t) >= LONG]
    return found | _ranked(spark, [(t, e) for t in more for e in double_edits(t, SECOND) if e and e != t], scores)


def suggest(spark: SparkSession, tokens: list[str], scores: DataFrame) -> list[str] | None:
    """Tokens with those outside the vocabulary replaced; None if nothing changes."""
    asked = F.broadcast(spark.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "term string"))
    known = {r["term"] for r in scores.join(asked, "term", "left_semi").select("term").distinct().collect()}
    best = best_words(spark, [t for t in tokens if t not in known], scores)
    after = [best.get(t, t) for t in tokens]
    return after if after != tokens else None


def corrected(query: str, before: list[str], after: list[str]) -> str:
    """The original query with changed tokens replaced as whole words, in any case."""
    for old, new in zip(before, after, strict=True):
        if old != new:
            query = re.sub(rf"\b{re.escape(old)}\b", lambda _, n=new: n, query, flags=re.IGNORECASE | re.ASCII)
    return query
