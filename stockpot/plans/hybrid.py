"""The hybrid query: parse, rank, suggest."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.recipes import APPLIANCES
from ..operators import ranking, spell
from ..operators.index import Index

# The diets that a query may name.
DIETS = ("vegetarian", "vegan", "dairy-free", "gluten-free", "contains-gluten")
STOP_TERMS = {"recipe"}


@dataclass
class Parsed:
    dietary: list[str] = field(default_factory=list)
    appliance: list[str] = field(default_factory=list)
    category: list[str] = field(default_factory=list)
    timebucket: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)

    def facets(self) -> list[tuple[str, str]]:
        return [(kind, key) for kind in ("dietary", "appliance", "category", "timebucket") for key in getattr(self, kind)]


def bucket_of(minutes: int) -> str:
    return next((name for limit, name in ((15, "le15"), (30, "le30"), (60, "le60")) if minutes <= limit), "gt60")


def query_tokens(text: str) -> list[str]:
    return [t for t in re.sub(r"[^a-z0-9\s]", " ", text.lower()).split() if len(t) >= 2]


def parse(query: str | None) -> Parsed:
    """Named diets and appliances (as substrings, in their order), `under N` as one time bucket,
    category:<slug>, and the rest as text terms."""
    out, rest = Parsed(), (query or "").strip().lower()
    for names, into in ((DIETS, out.dietary), (APPLIANCES, out.appliance)):
        for name in names:
            if name in rest:
                into.append(name)
                rest = rest.replace(name, " ")
    if limit := re.search(r"under\s+(\d+)\s*(?:minutes|minute|mins|min)?", rest):
        out.timebucket.append(bucket_of(int(limit[1])))
        rest = rest.replace(limit[0], " ", 1)
    for found in re.finditer(r"category:([a-z0-9-]+)", rest):
        out.category.append(found[1])
        rest = rest.replace(found[0], " ", 1)
    out.terms = [t for t in query_tokens(rest) if t not in STOP_TERMS]
    return out


def _local(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A table of (query_id, names...) inside the plan, for which no job runs."""
    columns = list(zip(*rows, strict=True)) or [()] * (1 + len(names))
    kinds = [pa.int32(), *[pa.int32() if n == "top" else pa.string() for n in names]]
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query_id", *names]))


def _frames(spark: SparkSession, parsed: dict[int, Parsed], limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    terms = [(i, t) for i, p in parsed.items() for t in dict.fromkeys(p.terms)]
    facets = [(i, k, v) for i, p in parsed.items() for k, v in p.facets()]
    return tuple(_local(spark, *t) for t in ((terms, ("term",)), (facets, ("attr_type", "attr_key")), ([(i, limit) for i in parsed], ("top",))))


def batch(spark: SparkSession, index: Index, queries: list[str], limit: int = 20) -> DataFrame:
    """(query_id, rank, doc_id, score) of many queries in one job; query_id counts from 0."""
    return ranking.search(index, *_frames(spark, {i: parse(q) for i, q in enumerate(queries)}, limit))


def run(spark: SparkSession, index: Index, query: str, limit: int = 20) -> dict:
    """One query with hits, and a suggestion where text terms find nothing."""
    parsed = parse(query)
    hits = ranking.with_meta(ranking.search(index, *_frames(spark, {0: parsed}, limit)), index)
    rows = [r.asDict() for r in hits.orderBy("rank").drop("query_id", "rank").collect()]  # at most `limit` rows
    out = {"query": query, "parsed": asdict(parsed), "total_hits": len(rows), "hits": rows}
    if not rows and parsed.terms and (better := did_you_mean(spark, index, query, parsed)):
        out["did_you_mean"] = better
    return out


def run_corrected(spark: SparkSession, index: Index, query: str, limit: int = 20) -> dict:
    """run(), and once more with the suggested query where there is one."""
    out = run(spark, index, query, limit)
    if "did_you_mean" not in out:
        return out
    again = run(spark, index, out["did_you_mean"]["suggested_query"], limit)
    return again | {"spell_check_original_query": query, "spell_check_applied": out["did_you_mean"]}


def did_you_mean(spark: SparkSession, index: Index, query: str, parsed: Parsed) -> dict | None:
    """Replace terms without postings by the best known word one or two edits away, else by a known tag."""
    terms = parsed.terms
    known = {r["term"] for r in index.df.join(F.broadcast(spark.createDataFrame([(t,) for t in set(terms)], "term string")), "term", "left_semi").collect()}
    missing = [t for t in dict.fromkeys(terms) if t not in known]
    if not missing:
        return None
    best = spell.best_words(spark, missing, index.df.select("term", F.col("df").alias("score")))
    left = [t for t in missing if t not in best]
    if left:
        tags = index.attrs.filter(F.col("attr_key").isin(*DIETS, *APPLIANCES) & F.col("attr_type").isin("dietary", "appliance")).groupBy("attr_key").agg(F.count("*").alias("score"))
        shown = {spell.tag_token(t): t for t in (*DIETS, *APPLIANCES)}
        scores = tags.select(spell.tag_tokens(F.col("attr_key")).alias("term"), "score")
        best |= {t: shown[w] for t, w in spell.best_words(spark, [spell.tag_token(t) for t in left], scores).items() if w in shown}
    after = [best.get(t, t) for t in terms]
    if after == terms:
        return None
    return {"text_terms_before": terms, "text_terms_after": after, "suggested_query": spell.corrected(query, terms, after)}
