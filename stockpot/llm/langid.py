"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed byte n-grams scaled to length 1. Every language
has several centroids from clustering its training texts; a text takes the language of
the centroid with the largest cosine and is marked rejected where that cosine is below
what the language's own training texts show.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, release, released, small_batches, staged
from .wordhash import text_buffer

UNKNOWN = "und"
DIM = 4096
#: ASCII bytes that are not letters separate words; A-Z become a-z.
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[128:] = np.arange(128, 256)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of length 1
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # cosine below which a language rejects


def counts(texts: pa.Array, window: int = 1 << 18) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of bytes in each whole text; blanks alone don't count."""
    data, at = text_buffer(texts)
    out = np.zeros((len(texts), DIM), np.float64)
    pos = 0
    while pos < len(data):  # long texts pass in windows that overlap by two bytes
        end = min(pos + window, len(data))
        b = _CLEAN[data[pos : min(end + 2, len(data))]].astype(np.uint32)
        doc = np.searchsorted(at, np.arange(pos, pos + len(b)), "right") - 1
        first = doc[0]
        code = np.zeros(len(b), np.uint32)
        for n in range(3):
            code = (code[: len(b) - n] if n else code) + b[n:] * _FACTORS[n]
            if not len(code):
                break
            mixed = code * np.uint32(0x2C1B3C6D)
            slot = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x297A2D39)) >> np.uint32(20)
            use = (doc[: len(code)] == doc[n:]) & ((b[: len(code)] != 32) | (b[n:] != 32))
            use[max(0, end - pos) :] = False
            rows = (doc[: len(code)] - first)[use]
            out[first : doc[-1] + 1] += np.bincount(rows * DIM + slot[use], minlength=(doc[-1] - first + 1) * DIM).reshape(-1, DIM)
        pos = end
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.sqrt(tf) * idf)


def train(texts: pa.Array, langs: list[str], **options) -> Model:
    """learn() from texts at hand."""
    return learn(np.concatenate([counts(texts.slice(i, 256)).astype(np.float32) for i in range(0, len(texts), 256)]) if len(texts) else np.zeros((0, DIM), np.float32), langs, **options)


def learn(tf: np.ndarray, langs: list[str], clusters: int = 3, rounds: int = 8, quantile: float = 0.005, seed: int = 3) -> Model:
    """Centroids by spherical k-means inside each language; distances for rejection by quantile.

    tf: n-gram counts, a float32 row a text; it is overwritten.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    at = {n: j for j, n in enumerate(names)}
    y = np.array([at[x] for x in langs], int)
    idf = np.log((1 + len(tf)) / (1 + np.count_nonzero(tf, axis=0))) + 1
    x = np.sqrt(tf, out=tf)
    x *= idf.astype(np.float32)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    order = np.argsort(y, kind="stable")
    cuts = np.searchsorted(y[order], np.arange(len(names) + 1))
    centroids, owner, least = [], [], []
    for j in range(len(names)):
        own = x[order[cuts[j] : cuts[j + 1]]]
        c = own[rng.choice(len(own), min(clusters, len(own)), replace=False)]
        for _ in range(rounds if len(own) > len(c) else 0):
            near = (own @ c.T).argmax(1)
            c = np.stack([_unit(own[near == i].sum(0, keepdims=True))[0] if (near == i).any() else c[i] for i in range(len(c))])
        centroids.append(c)
        owner += [j] * len(c)
        least.append(float(np.quantile((own @ c.T).max(1), quantile)))
    return Model(names, idf, np.concatenate(centroids) if centroids else np.zeros((0, DIM)), np.array(owner, int), np.array(least))


def fit(docs: DataFrame, per_language: int = 1_200, most: int = 12_000, held_out: tuple[int, int] = (5, 0)) -> Model:
    """Train on the first `per_language` texts of each language in hash order, and on at most `most` in all, from rows not held out.

    Every language has the same bound, so a rare one keeps all of its rows. If there are more than
    `most` languages, the most frequent ones are learned, one text each. Ids are chosen before texts
    are read: the texts are filtered where they lie by a broadcast of at most `most` ids, and only
    their n-gram counts, of a bounded size however long the text, reach the driver.
    """
    part, rest = held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("doc_id").alias("h")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % part != rest))
    languages = staged(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most))
    each = min(per_language, most // max(1, languages.count()))
    few = languages.select("lang", (F.lit(1e6 * (each + 6 * each**0.5 + 6)) / F.col("count")).alias("share"))
    thin = join_small(rows, few, "lang").filter(F.pmod("h", F.lit(1_000_000)) < F.col("share")).select("doc_id", F.col("lang").alias("_lang"), "h").distinct()
    ids = thin.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("h", "doc_id"))).filter(F.col("_n") <= each).drop("_n")
    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(staged(ids)), "doc_id").filter("lang = _lang")
    got = _counted(texts.groupBy("h", "lang").agg(F.min("text").alias("text"))).toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    tf = np.zeros((got.num_rows, DIM), np.float32)
    for i, (slots, n) in enumerate(zip(got["slots"], got["n"], strict=True)):
        tf[i, slots.values.to_numpy()] = n.values.to_numpy()
    langs = got["lang"].to_pylist()
    del got
    model = learn(tf, langs)
    del tf
    release()
    return model


def _counted(texts: DataFrame) -> DataFrame:
    """(h, lang, slots, n): the n-gram counts of texts(h, lang, text) that are not zero."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                tf = counts(part.column("text"))
                row, slot = np.nonzero(tf)
                offsets = pa.array(np.searchsorted(row, np.arange(len(tf) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("lang"), pa.ListArray.from_arrays(offsets, pa.array(slot.astype(np.int16))), pa.ListArray.from_arrays(offsets, pa.array(tf[row, slot].astype(np.float32)))], names=["h", "lang", "slots", "n"])

    return texts.select("h", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(released(run), "h long, lang string, slots array<smallint>, n array<float>")


def _any_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are looked at one by one."""
    data, at = text_buffer(texts)
    ascii_letter = np.concatenate([[0], np.cumsum((_CLEAN[data] != 32) & (data < 128))])
    has = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for i in np.flatnonzero(~has & (at[1:] > at[:-1])):
        has[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return has


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score (cosine, 0 to 1) and rejected to every row of docs.

    Null texts and texts without a letter are UNKNOWN with score 0 and rejected; so is
    every text if nothing was learned. Ties go to the centroid first in language order. Narrow: no shuffle.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def values(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for texts in series:
            lang, score, rejected = [], [], []
            for i in range(0, len(texts), 64):
                part = texts.slice(i, 64)
                letters = _any_letter(part)
                if not len(m.owner):
                    letters[:] = False
                cosine = _vectors(counts(part), m.idf) @ m.centroids.T if len(m.owner) else np.zeros((len(part), 1))
                best = cosine.argmax(1)
                top = np.where(letters, np.clip(cosine[np.arange(len(part)), best], 0, 1), 0.0)
                lang += [m.langs[m.owner[b]] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                rejected += [bool(not ok or t < m.least[m.owner[b]]) for b, ok, t in zip(best, letters, top, strict=True)]
                score += top.tolist()
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])

    udf = F.arrow_udf(values, "lang_pred string, score double, rejected boolean")
    out = docs.withColumn("_id", udf(F.col(text).cast("string")))
    return out.withColumns({c: F.col(f"_id.{c}") for c in ("lang_pred", "score", "rejected")}).drop("_id")


def language_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row per input row."""
    rows = identify(docs.select("doc_id", "text"), fit(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
