"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts the next of `OUTPUTS` symbols from the last three: the most frequent
words of the whole training corpus, the end of a text, and classes of all other words by
their last bytes. Batched matrix products score every symbol and give normalised
log-probabilities; a word of a class gets its share of the class by its corpus count.

Counts and weights cover all training documents. Words of a bounded head (chosen on a sample, counted
on everything) are counted in dense tables; every other word is a row of a shuffle that
brings its occurrences together, so what is gathered grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, hash_sample, release, released, small_batches, staged
from .wordhash import word_hashes

OUTPUTS, CLASSES, ORDER, SUFFIX = 256, 32, 3, 2
#: Words in the dense head at most.
HEAD = 1 << 18
_SLOTS = 1 << 19
#: Training positions of a shard, in expectation; symbols of a piece of a text; fractions of a weight in sums.
SHARD, PIECE, _UNIT = 1 << 20, 1 << 16, 1 << 20
#: Kinds of counted rows: an occurrence of a tail word, the count of a head word.
_TAIL, _HEAD = 0, 1


@dataclass
class Lookup:
    """Index of head words by hash, in two tables of fixed size; a word that finds both slots taken is a tail word."""

    keys: np.ndarray
    one: np.ndarray
    two: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Lookup:
        one, two, keys = np.full(_SLOTS, -1, np.int32), np.full(_SLOTS, -1, np.int32), []
        left = hashes
        for table, shift in ((one, 0), (two, 20)):
            slots = ((left >> np.uint64(shift)) & np.uint64(_SLOTS - 1)).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            table[slots[first]] = np.arange(len(first)) + sum(map(len, keys))
            keys.append(left[first])
            left = np.delete(left, first)
        return cls(np.concatenate([*keys, np.zeros(1, np.uint64)]), one, two)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word, -1 for tail words."""
        mask = np.uint64(_SLOTS - 1)
        i = self.one[(hashes & mask).astype(np.int64)]
        j = self.two[((hashes >> np.uint64(20)) & mask).astype(np.int64)]
        return np.where(self.keys[i] == hashes, i, np.where(self.keys[j] == hashes, j, -1))

    @property
    def size(self) -> int:
        return len(self.keys) - 1


def _classes(parts: np.ndarray) -> np.ndarray:
    return (parts % np.uint64(CLASSES)).astype(np.int64)


@dataclass
class Model:
    """Tables of the log-bilinear model: ORDER context tables, output vectors and biases."""

    context: np.ndarray  # (ORDER, OUTPUTS + 1, dim), the last symbol being the start of a text
    out: np.ndarray
    bias: np.ndarray

    def log_probabilities(self, symbols: np.ndarray, history: np.ndarray, block: int = 8_192) -> np.ndarray:
        """Normalised natural log-probability of each symbol after its history (ORDER columns)."""
        found = np.empty(len(symbols), np.float64)
        for i in range(0, len(symbols), block):
            h = history[i : i + block]
            q = self.context[0][h[:, 0]]
            for o in range(1, ORDER):
                q = q + self.context[o][h[:, o]]
            s = q @ self.out.T
            s += self.bias
            picked = s[np.arange(len(s)), symbols[i : i + block]].astype(np.float64)
            top = s.max(1, keepdims=True)
            s -= top
            np.exp(s, out=s)
            found[i : i + block] = picked - top[:, 0] - np.log(s.sum(1, dtype=np.float64))
        return found


def histories(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The last ORDER symbols before each, nearest first; OUTPUTS before the start of a text."""
    at = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((len(symbols), ORDER), OUTPUTS, np.int64)
    for o in range(ORDER):
        out[o + 1 :, o] = symbols[: max(0, len(symbols) - o - 1)]
        out[at <= o, o] = OUTPUTS
    return out


def start(unigram: np.ndarray, dim: int = 16, seed: int = 23) -> dict[str, np.ndarray]:
    """Weights before training: symbol vectors, a matrix for each place of the context, output vectors, biases."""
    rng = np.random.default_rng(seed)
    return {"r": rng.normal(0, 0.1, (OUTPUTS + 1, dim)), "c": np.stack([np.eye(dim)] * ORDER) / ORDER, "q": rng.normal(0, 0.1, (OUTPUTS, dim)), "b": np.log(unigram)}


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([v.size for v in like.values()])
    return {k: x.reshape(v.shape) for (k, v), x in zip(like.items(), np.split(flat, ends[:-1]), strict=True)}


def _sums(keys: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of each key."""
    dim = rows.shape[1]
    return np.bincount((keys[:, None] * dim + np.arange(dim)).ravel(), rows.ravel(), size * dim).reshape(size, dim).astype(np.float32)


def learn(p: dict[str, np.ndarray], unigram: np.ndarray, symbols: np.ndarray, lengths: np.ndarray, skip: np.ndarray | None = None, noise: int = 12, shared: int = 32, batch: int = 512, rate: float = 0.1, seed: int = 23) -> dict[str, np.ndarray]:
    """One pass of noise-contrastive estimation with Adagrad over all positions, in random order.

    The positions of a batch share its noise: `shared` draws, which weigh as `noise` draws for
    each position; at these sizes no product is large enough for BLAS threads. The first `skip` symbols of each text are context only.
    """
    rng = np.random.default_rng(seed)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    seen = {k: np.full(v.shape, 1e-2, np.float32) for k, v in p.items()}
    history, symbols = histories(symbols, lengths) + np.arange(ORDER) * (OUTPUTS + 1), symbols.astype(np.int64)
    log_noise, cumulative = np.log(noise * unigram).astype(np.float32), np.cumsum(unigram)
    order = np.arange(len(symbols))
    if skip is not None:
        order = order[order - np.repeat(np.cumsum(lengths) - lengths, lengths) >= np.repeat(skip, lengths)]
    order = rng.permutation(order)
    for i in range(0, len(order), batch):
        at = order[i : i + batch]
        h, w, n = history[at], symbols[at], len(at)
        tables = np.concatenate(p["r"] @ p["c"])
        q = tables[h[:, 0]]
        for o in range(1, ORDER):
            q += tables[h[:, o]]
        fake = np.minimum(np.searchsorted(cumulative, rng.random(shared)), OUTPUTS - 1)
        own, others, bias = p["q"][w], p["q"][fake], p["b"] - log_noise
        g = np.float32(-1 / n) / (1 + np.exp(np.einsum("nd,nd->n", q, own) + bias[w]))
        k = np.float32(noise / shared / n) / (1 + np.exp(q @ -others.T - bias[fake]))
        gq = g[:, None] * own + k @ others
        moved = _sums(h.T.ravel(), np.concatenate([gq] * ORDER), ORDER * (OUTPUTS + 1)).reshape(ORDER, OUTPUTS + 1, -1)
        grad = {"r": (moved @ p["c"].transpose(0, 2, 1)).sum(0), "c": p["r"].T @ moved, "q": _sums(w, g[:, None] * q, OUTPUTS), "b": np.bincount(w, g, OUTPUTS) + np.bincount(fake, k.sum(0), OUTPUTS)}
        np.add.at(grad["q"], fake, k.T @ q)
        for name, v in grad.items():
            seen[name] += (v * v).astype(np.float32)
            p[name] -= (rate * v / np.sqrt(seen[name])).astype(np.float32)
    return p


def _model(p: dict[str, np.ndarray]) -> Model:
    context = np.stack([p["r"] @ p["c"][o] for o in range(ORDER)])
    return Model(context.astype(np.float32), p["q"].astype(np.float32), p["b"].astype(np.float32))


def train(symbols: np.ndarray, lengths: np.ndarray, dim: int = 16, epochs: int = 2, seed: int = 23) -> Model:
    """The model of texts at hand: `epochs` passes over all their positions."""
    unigram = np.bincount(symbols, minlength=OUTPUTS) + 1.0
    unigram /= unigram.sum()
    p = start(unigram, dim, seed)
    for e in range(epochs):
        p = learn(p, unigram, symbols, lengths, seed=seed + e)
    return _model(p)


def _pieces(rows: DataFrame, shards: int, symbols_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], size: int = PIECE) -> DataFrame:
    """(shard, row, piece, symbols): the training texts as symbols, a byte each, dealt by hash.

    A long text is cut; every piece but the first starts with the ORDER symbols before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                s, lengths = symbols_of(part.column("text"))
                s, ends = s.astype(np.uint8), np.cumsum(lengths)
                pieces = [(row, k, s[max(a, a + k * size - ORDER) : min(b, a + (k + 1) * size)].tobytes()) for row, a, b in zip(part.column("row").to_pylist(), ends - lengths, ends, strict=True) for k in range(-(-(b - a) // size))]
                columns = list(zip(*pieces, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["row", "piece", "symbols"])

    found = rows.filter("NOT held_out").select("row", "text").mapInArrow(released(run), "row long, piece int, symbols binary")
    return found.select(F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int").alias("shard"), "*")


def _pass(pieces: DataFrame, p: dict[str, np.ndarray], unigram: np.ndarray, shards: int, seed: int) -> dict[str, np.ndarray]:
    """Weights after a pass over all pieces: each shard learns from p, and its weights count by its positions.

    Shards and the order inside them follow from the rows alone and sums are of integers, so
    equal rows give equal weights however they lie.
    """
    sent = pieces.sparkSession.sparkContext.broadcast((p, unigram))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending"), ("symbols", "ascending")])
        texts, piece = table["symbols"].to_pylist(), table["piece"].to_numpy()
        lengths, skip = np.array([len(t) for t in texts], np.int64), np.where(piece > 0, ORDER, 0)
        found = learn(*sent.value, np.frombuffer(b"".join(texts), np.uint8), lengths, skip, seed=seed * 1_000_003 + table["shard"][0].as_py())
        n = int((lengths - skip).sum())
        flat = np.append(np.rint(_flat(found).astype(np.float64) * n * _UNIT).astype(np.int64), n)
        release()
        return pa.table({"at": pa.array(np.arange(len(flat)), pa.int32()), "total": flat})

    done = pieces.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    if not done.num_rows:
        return p
    total = done.sort_by("at")["total"].to_numpy()
    return _shaped(total[:-1] / (float(total[-1]) * _UNIT), p)


def fit(rows: DataFrame, symbols_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], unigram: np.ndarray, tokens: int) -> Model:
    """The model learnt from every training position, each at least once.

    Shards of about SHARD positions grow in number with the input. One of them gives all
    the same start; then all learn side by side and their weights are averaged.
    """
    shards = max(1, round(tokens / SHARD))
    pieces = staged(_pieces(rows, shards, symbols_of))
    p = _pass(pieces.filter("shard = 0"), start(unigram), unigram, 1, 1)
    return _model(_pass(pieces, p, unigram, shards, 2))


def _rows(docs: DataFrame, held_out: tuple[int, int]) -> DataFrame:
    part, rest = held_out
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % part == rest, F.lit(False))
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"held_out": held, "row": F.xxhash64("doc_id", "text")})


def _head(rows: DataFrame, most: int) -> tuple[Lookup, np.ndarray]:
    """Words that occur more than once in `most` training rows, at most HEAD, and their classes.

    Rows are chosen by hash and counted where they lie; only words and counts move.
    """
    train_rows = rows.filter("NOT held_out").select("row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                hashes, _, parts = word_hashes(batch.column("text").slice(i, 128), suffix=SUFFIX)
                words, first, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(_classes(parts[first])), pa.array(n.astype(np.int64))], names=["word", "class", "n"])

    sample = train_rows.join(F.broadcast(hash_sample(train_rows, "row", most)), "row", "left_semi").select("text")
    found = sample.mapInArrow(released(run), "word long, class long, n long").groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))
    got = found.filter("n > 1").orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    words, classes = got["word"].to_numpy().view(np.uint64), got["class"].to_numpy()
    lookup = Lookup.of(words)
    order = np.argsort(words)
    return lookup, classes[order][np.searchsorted(words[order], lookup.keys[:-1])]


def _counted(rows: DataFrame, lookup: Lookup) -> DataFrame:
    """(kind, key, s, known, distinct): one row per document row hash (kind 0), tail class (1), head word (2)
    and tail word that occurs more than once (3, with its class as distinct).

    One pass over all texts: tail occurrences meet by word, get the word's training count
    and are summed per document; head counts are added up by each task first.
    """
    sent = rows.sparkSession.sparkContext.broadcast(lookup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        dense = np.zeros(table.size, np.int64)
        for batch in batches:
            row, train = batch.column("row").to_numpy(), ~np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
            for i in range(0, batch.num_rows, 128):
                hashes, counts, parts = word_hashes(batch.column("text").slice(i, 128), suffix=SUFFIX)
                doc = np.repeat(np.arange(i, i + len(counts)), counts)
                at = table.find(hashes)
                head = at >= 0
                dense += np.bincount(at[head & train[doc]], minlength=table.size)
                tail = ~head
                tag = _classes(parts[tail]) * 2 + train[doc[tail]]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(int(tail.sum()), np.int8)), pa.array(hashes[tail].view(np.int64)), pa.array(row[doc[tail]]), pa.array(tag.astype(np.int8))], names=["kind", "word", "row", "tag"])
        some = np.flatnonzero(dense)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), _HEAD, np.int8)), pa.array(some), pa.array(dense[some]), pa.array(np.zeros(len(some), np.int8))], names=["kind", "word", "row", "tag"])

    found = rows.select("row", "held_out", "text").mapInArrow(released(run), "kind tinyint, word long, row long, tag tinyint")
    together = Window.partitionBy("kind", "word")
    number = F.when(F.col("kind") == _HEAD, F.col("row")).otherwise((F.col("tag") % 2).cast("long"))
    found = found.withColumn("c", F.sum(number).over(together)).withColumn("nth", F.row_number().over(together.orderBy("row", "tag")))
    first = ((F.col("nth") == 1) & (F.col("c") > 0)).cast("long")
    tail = F.struct(F.lit(0).alias("kind"), F.col("row").alias("key"), F.log10(F.col("c") + 1.0).alias("s"), (F.col("c") > 0).cast("long").alias("known"), F.lit(0).cast("long").alias("distinct"))
    of_class = F.struct(F.lit(1).alias("kind"), F.expr("tag div 2").cast("long").alias("key"), F.lit(0.0).alias("s"), F.when(F.col("nth") == 1, F.col("c")).otherwise(0).cast("long").alias("known"), first.alias("distinct"))
    head = F.struct(F.lit(2).alias("kind"), F.col("word").alias("key"), F.lit(0.0).alias("s"), F.col("c").alias("known"), F.lit(0).cast("long").alias("distinct"))
    word = F.struct(F.lit(3).alias("kind"), F.col("word").alias("key"), F.lit(0.0).alias("s"), F.col("c").alias("known"), F.expr("tag div 2").cast("long").alias("distinct"))
    rows_of = F.when(F.col("kind") == _HEAD, F.when(F.col("nth") == 1, F.array(head))).when((F.col("nth") == 1) & (F.col("c") > 1), F.array(tail, of_class, word)).when(F.col("nth") == 1, F.array(tail, of_class)).otherwise(F.array(tail))
    return found.select(F.explode(rows_of).alias("x")).select("x.*").groupBy("kind", "key").agg(F.sum("s").alias("s"), F.sum("known").alias("known"), F.sum("distinct").alias("distinct"))


def score(docs: DataFrame, sample: int = 6_000, held_out: tuple[int, int] = (7, 2)) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    A text's tokens are its words, A-Z lower-cased, and one end. base_score uses add-one
    unigram counts of all training documents, score the model, whose symbols and weights come
    from all of them too; `sample` documents only tell which words are counted in dense tables.
    A null text is empty: only its end is scored. Equal rows get equal scores.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs, held_out)
    lookup, classes = _head(rows, sample)
    counted = staged(_counted(rows, lookup))
    c = np.zeros(lookup.size, np.int64)
    tail_count, tail_distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counted.filter("kind IN (1, 2)").select("kind", "key", "known", "distinct").toLocalIterator():
        if r["kind"] == 2:
            c[r["key"]] = r["known"]
        else:
            tail_count[r["key"]], tail_distinct[r["key"]] = r["known"], r["distinct"]
    ends = rows.filter("NOT held_out").count()
    total = int(c.sum() + tail_count.sum()) + ends
    vocabulary = int((c > 0).sum() + tail_distinct.sum()) + int(ends > 0)
    # Symbols: the most counted head words, then the end of a text, then the classes.
    words = OUTPUTS - CLASSES - 1
    found = counted.filter("kind = 3").orderBy(F.desc("known"), "key").limit(words).toArrow()
    key, count, group = (found[x].to_numpy() for x in ("key", "known", "distinct"))
    symbol = OUTPUTS - CLASSES + classes
    every, keys = np.append(c, count), np.append(lookup.keys[:-1].view(np.int64), key)
    top = np.lexsort((keys, -every))[:words]
    top = top[every[top] > 1]
    place = np.full(len(every), -1)
    place[top] = np.arange(len(top))
    symbol = np.where(place[: len(c)] >= 0, place[: len(c)], symbol)
    own = place[len(c) :] >= 0
    order = np.argsort(key[own].view(np.uint64))
    promoted = Promoted(key[own].view(np.uint64)[order], place[len(c) :][own][order], np.log10(count[own][order] + 1.0))
    tail_count -= np.bincount(group[own], count[own], CLASSES).astype(np.int64)
    tail_distinct -= np.bincount(group[own], minlength=CLASSES)
    rest = symbol >= words
    inside = tail_count + np.bincount(classes[rest], c[rest], CLASSES)
    mass = inside + tail_distinct + 1 + np.bincount(classes[rest], c[rest] > 0, CLASSES)
    unigram = np.ones(OUTPUTS)
    unigram[: len(top)] += every[top]
    unigram[words:] += np.append(ends, inside)
    vocabulary_sent = spark.sparkContext.broadcast((lookup, symbol, promoted))
    model = fit(rows, lambda texts: _symbols(texts, *vocabulary_sent.value)[:2], unigram / unigram.sum(), total)
    sent = spark.sparkContext.broadcast((c, np.log10(mass), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (n, log_mass, m), vocabulary = sent.value, vocabulary_sent.value
        log_count = np.log10(n + 1.0)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                s, lengths, at, share, extra = _symbols(part.column("text"), *vocabulary)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                head = at >= 0
                known = np.bincount(doc[head], n[at[head]] > 0, len(lengths))
                base = np.bincount(doc[head], log_count[at[head]], len(lengths)).astype(np.float64)
                lm = m.log_probabilities(s, histories(s, lengths)) / np.log(10)
                lm -= np.where(share >= 0, log_mass[share], 0)
                inside = head & (share >= 0)
                lm[inside] += log_count[at[inside]]
                lm -= extra  # added again with the sums of tail words
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), part.column("row"), pa.array(lengths.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(np.bincount(doc, lm, len(lengths)).astype(np.float64))], names=["doc_id", "held_out", "row", "n_tokens", "head_known", "head_base", "head_lm"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = checkpointed(rows.mapInArrow(released(run), f"doc_id {kind}, held_out boolean, row long, n_tokens long, head_known long, head_base double, head_lm double"))
    # Equal rows met in one sum: each takes its part of it.
    same = scored.groupBy("row").count()
    sums = counted.filter("kind = 0").select(F.col("key").alias("row"), "s", "known").join(same, "row").select("row", (F.col("s") / F.col("count")).alias("s"), F.expr("known div count").alias("known"))
    out = scored.join(sums, "row", "left").na.fill({"s": 0.0, "known": 0})
    end = float(np.log10(ends + 1.0))
    base = F.col("head_base") + F.col("s") + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(total + vocabulary + 1.0)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.col("known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("head_lm") + F.col("s")).alias("score"))


@dataclass
class Promoted:
    """Tail words with a symbol of their own: sorted hashes, symbols, logarithms of counts plus one."""

    hashes: np.ndarray
    symbol: np.ndarray
    log_count: np.ndarray


def _symbols(texts: pa.Array, lookup: Lookup, symbol: np.ndarray, promoted: Promoted) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol of each token with ends, tokens of each text, head index or -1, class or -1 of tokens without own symbol, log count of promoted words or 0)."""
    hashes, counts, parts = word_hashes(texts, suffix=SUFFIX)
    at = lookup.find(hashes)
    group = _classes(parts)
    own = np.where(at >= 0, symbol[at] if lookup.size else 0, OUTPUTS - CLASSES + group)
    where = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
    size = len(hashes) + len(counts)
    s, index, share, extra = np.full(size, OUTPUTS - CLASSES - 1), np.full(size, -1), np.full(size, -1), np.zeros(size)
    if len(promoted.hashes):
        tail = np.flatnonzero(at < 0)
        i = np.minimum(np.searchsorted(promoted.hashes, hashes[tail]), len(promoted.hashes) - 1)
        same = promoted.hashes[i] == hashes[tail]
        own[tail[same]], extra[where[tail[same]]] = promoted.symbol[i[same]], promoted.log_count[i[same]]
    s[where], index[where] = own, at
    share[where] = np.where(own >= OUTPUTS - CLASSES, own - (OUTPUTS - CLASSES), -1)
    return s, counts + 1, index, share, extra
