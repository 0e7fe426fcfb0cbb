"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings, one of the word and one of its first bytes.
Filters of widths 1, 2 and 3 slide over whole texts, each keeps its maximum, and a
logistic layer reads the maxima. Thresholds are calibrated by language, which is told
from the text alone by votes of function words, and shifted so that a score of 0.3 is
the threshold in every language.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, release, released, small_batches, staged
from .minhash import by_ids
from .wordhash import hash_of, word_hashes

#: Score from which a document counts as toxic.
CUT = 0.3
PREFIX = 4
#: Embedding rows as a power of two; at most 16, as two bytes a row are sent to the driver.
BITS = 15
#: One row in FOLDS is kept for choosing the epoch and the thresholds.
FOLDS = 5
#: Rows and words of a shard that learns in one task, about.
SHARD_ROWS, SHARD_WORDS = 5_000, 3_000_000
#: Steps of summed weights and of logits counted for thresholds, both as parts of 1.
_UNIT, _BINS = 1 << 24, 100
_WEIGHTS = ("words", "prefixes", "filters", "bias", "out")
#: Function words that vote for a language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as this be by from",
    "de": "der die und das den von zu mit sich des auf nicht ein eine als im dem ist",
    "fr": "le les des et du une est que dans pour qui pas sur au par de la un",
    "es": "el los las y del que se por con para una su al lo como de la en",
}


@dataclass
class Model:
    """Weights of the network; `thresholds` holds a logit for each language and the rest last."""

    bits: int
    words: np.ndarray
    prefixes: np.ndarray
    filters: np.ndarray  # (3 * dim, filters): a filter of width k uses the first k blocks
    bias: np.ndarray
    out: np.ndarray
    shift: float
    known_words: np.ndarray
    known_prefixes: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))


def _votes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and, for each, one vote per language that has the word."""
    table: dict[int, np.ndarray] = {}
    for j, text in enumerate(FUNCTION_WORDS.values()):
        for w in text.split():
            table.setdefault(hash_of(w), np.zeros(len(FUNCTION_WORDS), np.int64))[j] = 1
    keys = np.array(sorted(table), np.uint64)
    return keys, np.array([table[int(k)] for k in keys])


def languages(hashes: np.ndarray, counts: np.ndarray, votes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index of the language with most function words in each text; the last index if there are none."""
    keys, table = votes
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == hashes)
    doc = np.repeat(np.arange(len(counts)), counts)[hit]
    sums = np.stack([np.bincount(doc, table[at[hit], j], len(counts)) for j in range(table.shape[1])], 1)
    return np.where(sums.max(1) > 0, sums.argmax(1), table.shape[1])


def _ids(hashes: np.ndarray, parts: np.ndarray, bits: int, known_words: np.ndarray, known_prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows; words and prefixes too rare in training share the zero row 2**bits."""
    mask = np.uint64((1 << bits) - 1)
    a, b = (hashes & mask).astype(np.int64), (parts & mask).astype(np.int64)
    return np.where(known_words[a], a, 1 << bits), np.where(known_prefixes[b], b, 1 << bits)


def _padded(ids: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with two pads after each text, and where each text starts."""
    starts = np.concatenate([[0], np.cumsum(counts + 2)])
    out = np.full(starts[-1] + 2, pad, np.int64)
    out[np.arange(len(ids)) + 2 * np.repeat(np.arange(len(counts)), counts)] = ids
    return out, starts


def _windows(m: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = m.words[a] + m.prefixes[b]
    return np.concatenate([x[:-2], x[1:-1], x[2:]], 1)


def logits(m: Model, a: np.ndarray, b: np.ndarray, counts: np.ndarray, tokens: int = 32_768) -> np.ndarray:
    """The network's output for each text; a long text is passed in blocks of `tokens`."""
    pad = 1 << m.bits
    (a, starts), (b, _) = _padded(a, counts, pad), _padded(b, counts, pad)
    best = np.full((len(counts), len(m.bias)), -np.inf, np.float32)
    total, pos = int(starts[-1]), 0
    while pos < total:
        end = min(pos + tokens, total)
        r = _windows(m, a[pos : end + 2], b[pos : end + 2]) @ m.filters
        last = starts[1:] - 1
        last = last[(last >= pos) & (last < end)] - pos
        r[last] = -np.inf  # a window that starts on the second pad reaches into the next text
        first = np.searchsorted(starts, pos, "right") - 1
        cuts = np.maximum(starts[first : np.searchsorted(starts, end, "left")], pos) - pos
        rows = slice(first, first + len(cuts))
        best[rows] = np.maximum(best[rows], np.maximum.reduceat(r, cuts, 0))
        pos = end
    return np.maximum(best + m.bias, 0) @ m.out + m.shift


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def encoded(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(embedding row of each word, of its prefix, words of each text, language of each text)."""
    hashes, counts, parts = word_hashes(texts, prefix=PREFIX)
    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.int32), (parts & mask).astype(np.int32), counts, languages(hashes, counts, _votes())


def train(texts: pa.Array, labels: np.ndarray, **options) -> Model:
    """learn() from texts at hand."""
    return learn(*encoded(texts), labels, **options)


def counted(a: np.ndarray, b: np.ndarray, counts: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Texts with each embedding row, by table (words, prefixes) and label (not toxic, toxic)."""
    pad, out = 1 << bits, np.zeros((2, 2, 1 << bits), np.int64)
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    for k, h in enumerate((a, b)):
        pairs = np.unique(doc * np.int64(pad) + h)
        for label in (0, 1):
            out[k, label] = np.bincount(pairs[y[pairs // pad] == label] % pad, minlength=pad)
    return out


def start(found: np.ndarray, sizes: np.ndarray, base: float, rng: np.random.Generator, dim: int = 16, per_width: int = 8, rare: int = 3) -> Model:
    """The network before training, from counted() and the number of texts of each label.

    The first coordinate of an embedding is the smoothed log-odds of its word, the others are random.
    """
    pad, nf = found.shape[2], 3 * per_width
    known, tables = [], []
    for neg, pos in found:
        known.append(pos + neg >= rare)
        lift = np.log((pos + 0.5) / (sizes[1] + 1)) - np.log((neg + 0.5) / (sizes[0] + 1))
        e = rng.normal(0, 0.1, (pad + 1, dim)).astype(np.float32)
        e[:pad, 0] = np.clip(lift, -4, 4) * known[-1] * 0.5
        e[pad] = 0
        tables.append(e)
    filters = rng.normal(0, 0.1, (3 * dim, nf)).astype(np.float32) * _live(dim, nf)
    filters[0, :per_width] = np.linspace(0.5, 1.5, per_width)
    base = np.clip(base, 1e-3, 1 - 1e-3)
    return Model(pad.bit_length() - 1, tables[0], tables[1], filters, np.full(nf, -0.5, np.float32), np.where(np.arange(nf) < per_width, 0.3, 0.05).astype(np.float32), float(np.log(base / (1 - base))), *known)


def _live(dim: int, nf: int) -> np.ndarray:
    """1 for the weights that a filter of its width has."""
    live = np.zeros((3 * dim, nf), np.float32)
    for k in range(3):
        live[: (k + 1) * dim, k * (nf // 3) : (k + 1) * (nf // 3)] = 1
    return live


def learn(a: np.ndarray, b: np.ndarray, counts: np.ndarray, lang: np.ndarray, labels: np.ndarray, bits: int = BITS, epochs: int = 5, seed: int = 5, **options) -> Model:
    """Fit the network to texts at hand; one in five is kept for choosing the epoch and the thresholds."""
    rng, y = np.random.default_rng(seed), np.asarray(labels)
    fold = np.arange(len(y)) % FOLDS == FOLDS - 1
    some = np.repeat(~fold, counts)
    found = counted(a[some], b[some], counts[~fold], y[~fold], bits)
    m = start(found, np.bincount(y[~fold], minlength=2), y.mean() if len(y) else 0.5, rng, **options)
    a, b = _known(m, a, b)
    descend(m, a, b, counts, y, fold, rng, epochs)
    some = np.repeat(fold, counts)
    _calibrate(m, logits(m, a[some], b[some], counts[fold]), y[fold], np.ones(int(fold.sum())), lang[fold])
    return m


def _known(m: Model, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pad = np.int32(1 << m.bits)
    return np.where(m.known_words[a], a, pad), np.where(m.known_prefixes[b], b, pad)


def descend(m: Model, a: np.ndarray, b: np.ndarray, counts: np.ndarray, labels: np.ndarray, fold: np.ndarray, rng: np.random.Generator, epochs: int, rate: float = 0.05) -> None:
    """Train m in place with Adagrad on the texts outside `fold`, which chooses the epoch.

    Gradients flow through each filter's best window only.
    """
    pad, y, live = 1 << m.bits, labels.astype(np.float64), _live(m.words.shape[1], len(m.bias))
    ends = np.cumsum(counts)
    seen = {k: np.full(v.shape, 1e-3, np.float32) for k, v in (("words", m.words), ("prefixes", m.prefixes), ("filters", m.filters), ("bias", m.bias), ("out", m.out))}
    shift_seen, best = 1e-3, (np.inf, None)
    trained = np.flatnonzero(~fold)

    def part(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spots = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in docs]) if len(docs) else np.zeros(0, int)
        return a[spots], b[spots], counts[docs]

    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(trained), max(1, len(trained) // 64)):
            if not len(batch):
                continue
            (pa_, starts), (pb, _) = _padded(*part(batch)[::2], pad), _padded(*part(batch)[1:], pad)
            x = _windows(m, pa_, pb)
            r = x @ m.filters
            where = np.stack([s + r[s : e - 1].argmax(0) for s, e in zip(starts[:-1], starts[1:], strict=True)])
            z = np.take_along_axis(r, where, 0) + m.bias
            act = np.maximum(z, 0)
            g = ((_sigmoid(act @ m.out + m.shift) - y[batch]) / len(batch)).astype(np.float32)
            gz = g[:, None] * m.out * (z > 0)
            grads = {"out": act.T @ g + 1e-4 * m.out, "bias": gz.sum(0)}
            picked = x[where]  # batch, filter, 3 * dim
            grads["filters"] = np.einsum("bfd,bf->df", picked, gz, optimize=True) * live
            gx = (gz[:, :, None] * m.filters.T).reshape(-1, 3, m.words.shape[1])
            at = where.reshape(-1)
            on = np.flatnonzero(np.abs(gz.reshape(-1)) > 1e-9)
            for name, ids in (("words", pa_), ("prefixes", pb)):
                rows = np.concatenate([ids[at[on] + j] for j in range(3)])
                values = np.concatenate([gx[on, j] for j in range(3)])
                some, inverse = np.unique(rows, return_inverse=True)
                total = np.zeros((len(some), values.shape[1]), np.float32)
                np.add.at(total, inverse, values)
                total[some == pad] = 0
                seen[name][some] += total**2
                getattr(m, name)[some] -= rate * total / np.sqrt(seen[name][some])
            for name, grad in grads.items():
                seen[name] += grad**2
                getattr(m, name)[...] -= rate * grad / np.sqrt(seen[name])
            shift_seen += float(g.sum()) ** 2
            m.shift -= rate * float(g.sum()) / shift_seen**0.5
        held = np.flatnonzero(fold)
        p = np.clip(_sigmoid(logits(m, *part(held))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)) if len(held) else 0.0
        if loss < best[0]:
            best = (loss, {k: np.copy(getattr(m, k)) for k in seen} | {"shift": m.shift})
    for k, v in (best[1] or {}).items():
        setattr(m, k, v)


def _calibrate(m: Model, scores: np.ndarray, y: np.ndarray, n: np.ndarray, lang: np.ndarray, least: int = 15) -> None:
    """Per language the logit with the best F1 on kept-back texts; one for all where positives are few.

    A score stands for n texts, y of them toxic.
    """

    def cut(s: np.ndarray, t: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        hits = np.cumsum(t[order])
        f1 = 2 * hits / (np.cumsum(n[order]) + t.sum())
        k = int(np.argmax(f1))
        below = s[order[k + 1]] if k + 1 < len(s) else s[order[k]] - 1
        return float((s[order[k]] + below) / 2)

    whole = cut(scores, y, n) if y.sum() else float(np.log(CUT / (1 - CUT)))
    for j in range(len(m.thresholds)):
        mine = lang == j
        m.thresholds[j] = cut(scores[mine], y[mine], n[mine]) if y[mine].sum() >= least else whole


def fit(docs: DataFrame, labels: DataFrame, most: int | None = None, most_words: int | None = None, held_out: tuple[int, int] = (4, 2), epochs: int = 5, seed: int = 5) -> Model:
    """Train on all labelled rows that are not held out; only counts and weights reach the driver.

    Word counts come from all rows outside a fold of one in FOLDS, and thresholds from all rows
    of that fold. Shards of about SHARD_ROWS rows and SHARD_WORDS words grow in number with the
    input: one gives all the same start, then all learn side by side and the changes are
    averaged, each weight over the shards that changed it. A doc_id with several labels is
    toxic if one says so. A caller may bound the rows (by hash) or the words, texts that go over
    `most_words` being left out; the queries do not.
    """
    part, rest = held_out
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("_toxic")).filter(F.col("_toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % part != rest))
    known = staged(known.groupBy("doc_id").agg(F.max("_toxic").alias("_toxic")))
    if most is not None:
        hashed = known.withColumn("_h", F.xxhash64("doc_id"))
        known = staged(hashed.join(F.broadcast(hash_sample(hashed, "_h", most)), "_h", "left_semi").drop("_h"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    texts = by_ids(texts, known)[0].groupBy("doc_id").agg(F.max((F.col("_toxic") == 1).cast("int")).alias("_toxic"), F.min("text").alias("text"))
    rows = staged(_encoded(texts.select(F.xxhash64("doc_id").alias("_h"), "_toxic", "text")))
    if most_words is not None:
        sizes = rows.select("_h", "n").toArrow().sort_by("_h")
        n, total, fits = sizes["n"].to_numpy(), 0, []
        for i in range(len(n)):
            if total + n[i] <= most_words:
                total += int(n[i])
                fits.append(i)
        rows = staged(rows.join(F.broadcast(docs.sparkSession.createDataFrame(sizes.select(["_h"]).take(pa.array(fits, pa.int64())))), "_h", "left_semi")) if fits else rows.limit(0)
    fold = F.pmod("_h", F.lit(FOLDS)) == FOLDS - 1
    sums = {(r["fold"], r["_toxic"]): (r["rows"], r["words"]) for r in rows.groupBy(fold.alias("fold"), "_toxic").agg(F.count("*").alias("rows"), F.sum("n").alias("words")).collect()}
    every, words = (sum(x[i] for x in sums.values()) for i in (0, 1))
    sizes = np.array([sums.get((False, t), (0, 0))[0] for t in (0, 1)])
    toxic = sum(x[0] for (_, t), x in sums.items() if t)
    m = start(_counts(rows.filter(~fold)), sizes, toxic / every if every else 0.5, np.random.default_rng(seed))
    shards = max(1, math.ceil(every / SHARD_ROWS), math.ceil(words / SHARD_WORDS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("_h"), F.lit(shards)).cast("int"))
    m = _pass(dealt.filter("shard = 0"), m, 1, epochs, 0.05, seed)
    if shards > 1:
        m = _pass(dealt, m, shards, 2, 0.02, seed + 1)
    found = _histogram(rows.filter(fold), m)
    _calibrate(m, found["bin"].to_numpy() / _BINS, found["t"].to_numpy(), found["n"].to_numpy(), found["lang"].to_numpy())
    return m


def _texts(part: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(embedding rows of words, of prefixes, words of each text, label) of rows of _encoded."""
    joined = lambda c: np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).astype(np.int32)
    return joined("words"), joined("prefixes"), part.column("n").to_numpy(), part.column("_toxic").to_numpy()


def _counts(rows: DataFrame) -> np.ndarray:
    """counted() of all rows: each task adds up its own, the driver gets a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, 1 << BITS), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                total += counted(*_texts(batch.slice(i, 128)))
        flat = total.reshape(-1)
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], names=["at", "n"])

    got = rows.select("words", "prefixes", "n", "_toxic").mapInArrow(released(run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 << BITS, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(2, 2, 1 << BITS)


def _flat(m: Model) -> np.ndarray:
    return np.concatenate([*[np.asarray(getattr(m, k), np.float64).reshape(-1) for k in _WEIGHTS], [m.shift]])


def _pass(rows: DataFrame, m: Model, shards: int, epochs: int, rate: float, seed: int) -> Model:
    """m after each shard has learnt from it, every weight by the mean change of the shards that changed it.

    Shards and their order follow from the rows and sums are of integers, so equal rows give equal weights.
    """
    sent = rows.sparkSession.sparkContext.broadcast(m)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_h").combine_chunks()
        mine, before = copy.deepcopy(sent.value), _flat(sent.value)
        a, b, counts, y = _texts(table)
        fold = table["_h"].to_numpy() % FOLDS == FOLDS - 1
        descend(mine, *_known(mine, a, b), counts, y, fold, np.random.default_rng(seed * 1_000_003 + table["shard"][0].as_py()), epochs, rate)
        n = int((~fold).sum())
        change = np.rint((_flat(mine) - before) * n * _UNIT).astype(np.int64)
        some = np.flatnonzero(change)
        release()
        return pa.table({"at": pa.array(some, pa.int32()), "total": change[some], "n": np.full(len(some), n, np.int64)})

    done = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "at int, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    flat = _flat(m)
    flat[done["at"].to_numpy()] += done["total"].to_numpy() / (done["n"].to_numpy() * float(_UNIT))
    out, at = copy.copy(m), 0
    for k in _WEIGHTS:
        shape = getattr(m, k).shape
        setattr(out, k, flat[at : at + math.prod(shape)].reshape(shape).astype(np.float32))
        at += math.prod(shape)
    out.shift, out.thresholds = float(flat[-1]), m.thresholds.copy()
    return out


def _histogram(rows: DataFrame, m: Model) -> pa.Table:
    """(lang, bin, n, t): texts and toxic texts by language and logit, in steps of 1 / _BINS from -40 to 40."""
    sent = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                a, b, counts, y = _texts(part)
                bins = np.rint(np.clip(logits(sent.value, *_known(sent.value, a, b), counts), -40, 40) * _BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(bins), pa.array(y, pa.int32())], names=["lang", "bin", "y"])

    found = rows.select("lang", "words", "prefixes", "n", "_toxic").mapInArrow(released(run), "lang tinyint, bin int, y int")
    return found.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("t")).toArrow()


def _encoded(texts: DataFrame) -> DataFrame:
    """(_h, _toxic, n, lang, words, prefixes) of texts(_h, _toxic, text): two bytes an embedding row."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                a, b, counts, lang = encoded(part.column("text"))
                ends = np.cumsum(counts)
                packed = lambda x: pa.array([x[e - n : e].astype(np.uint16).tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column("_h"), part.column("_toxic"), pa.array(counts.astype(np.int64)), pa.array(lang.astype(np.int8)), packed(a), packed(b)], names=["_h", "_toxic", "n", "lang", "words", "prefixes"])

    return texts.select("_h", "_toxic", "text").mapInArrow(released(run), "_h long, _toxic int, n long, lang tinyint, words binary, prefixes binary")


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Add a double `column` from 0 to 1 to every row of docs, read from the whole text alone.

    A null text counts as empty. Narrow: no shuffle; the broadcast model has a fixed size.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    offset = float(np.log(CUT / (1 - CUT)))

    def values(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, votes = sent.value, _votes()
        for texts in series:
            done = []
            for i in range(0, len(texts), 256):
                hashes, counts, parts = word_hashes(texts.slice(i, 256), prefix=PREFIX)
                shift = m.thresholds[languages(hashes, counts, votes)]
                done.append(_sigmoid(logits(m, *_ids(hashes, parts, m.bits, m.known_words, m.known_prefixes), counts) - shift + offset))
            yield pa.array(np.concatenate(done) if done else np.zeros(0), pa.float64())
        release()

    return docs.withColumn(column, F.arrow_udf(values, "double")(F.col(text).cast("string")))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
