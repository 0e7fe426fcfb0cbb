"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document's word shingles give a MinHash signature; each (coordinate, value) pair is
a token under which the document is posted. Two signatures that agree on at least T of K
coordinates must share one of the K - T + 1 first tokens of either in any common order,
so only that prefix, rarest tokens first, is posted, and a document with fewer than T
tokens that others have is skipped altogether. Pairs from a list are kept if they agree
on T coordinates and are then confirmed on the full shingle sets. Lists whose
documents are already connected are skipped, so a group of copies costs about one pair
a document, and what is left is compared exhaustively across components. Clusters too
large for one task go through the same join once more, with longer signatures whose
match threshold lies closer to the similarity asked for, before whole sets meet.

Tables that grow with the input carry a merge hint in every join: their staged files are so
well compressed that the planner would take all rows of a corpus for a table to broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, release, released, small_batches, staged
from .components import components
from .wordhash import mix, word_hashes

_STEPS = np.random.default_rng(909).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 8192
#: Bits of the map that passes over rows before a join: 1 MB, whatever the input.
_BITS = 1 << 23


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of n words; fewer words are one run, none give none."""
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(0x100000001B3) + hashes[j : j + len(out)] + np.uint64(j + 1))
    return np.unique(out)


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    for i in range(0, len(texts), 64):
        hashes, counts, _ = word_hashes(texts.slice(i, 64))
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            yield shingles(hashes[a:b], n)


def signature(s: np.ndarray, k: int) -> np.ndarray:
    """K tokens: hashes of each coordinate and its minimum over the set."""
    low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    x = mix(s)[:, None]
    for i in range(0, len(s), _BLOCK):
        low = np.minimum(low, (x[i : i + _BLOCK] * _steps(k)).min(0))
    return mix(low + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _steps(k: int) -> np.ndarray:
    return _STEPS[:k] if k <= 64 else np.random.default_rng(909).integers(1, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def agreement(k: int, similarity: float, deviations: float = 5) -> int:
    """Coordinates on which a pair of this similarity agrees but with a chance of a few in a million (6: in 10 million)."""
    return max(1, math.floor(k * similarity - deviations * math.sqrt(k * similarity * (1 - similarity))))


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketch(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, tokens): set_a and set_b are a 128-bit hash of the set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, tokens = [], [], [], []
            for s in _sets(batch.column("text"), n):
                sizes.append(len(s))
                first.append(int(_longs(mix(s + np.uint64(11)).sum(keepdims=True, dtype=np.uint64))[0]))
                second.append(int(_longs(mix(s * np.uint64(0x2545F4914F6CDD1D) + np.uint64(7)).sum(keepdims=True, dtype=np.uint64))[0]))
                tokens.append(_longs(signature(s, k)) if len(s) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n_shingles", "set_a", "set_b", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(released(run), "doc_id long, n_shingles long, set_a long, set_b long, tokens array<long>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles): the whole sorted shingle set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                found = [_longs(s) for s in _sets(part.column("text"), n)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(released(run), "doc_id long, shingles array<long>")


def _resigned(sets: DataFrame, k: int) -> DataFrame:
    """(node, n, tokens): signatures of k coordinates of whole sets (node, n, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            flat, cut = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            tokens = [_longs(signature(flat[a:b], k)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            offsets = np.arange(len(tokens) + 1, dtype=np.int32) * k
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))], names=["node", "n", "tokens"])

    return sets.select("node", "n", "shingles").mapInArrow(released(run), "node long, n long, tokens array<long>")


def _postings(classes: DataFrame, k: int, least: int) -> DataFrame:
    """(token, node): the prefix of each class in the order of token frequency.

    Tokens that only one class has come first in that order and need no posting, so a class
    with n shared tokens is posted under its n - least + 1 rarest ones, or not at all.
    Frequencies are summed by the tasks first; the join that brings them back is one that
    adaptive execution splits where a token is hot.
    """
    tokens = classes.select("node", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    mine = Window.partitionBy("node")
    rows = tokens.join(shared.hint("merge"), "token")
    rows = rows.withColumn("own", F.count("*").over(mine)).filter(F.col("own") >= least)
    rows = rows.withColumn("rank", F.row_number().over(mine.orderBy("n", "token")))
    return rows.filter(F.col("rank") <= F.col("own") - least + 1).select("token", "node")


def _lists(classes: DataFrame, k: int, least: int) -> DataFrame:
    """(group, node): the posting lists of at least two classes."""
    postings = staged(_postings(classes, k, least))
    heads = postings.groupBy("token").agg(F.min("node").alias("head"), F.max("node").alias("tail")).filter("head < tail").select("token", "head")
    return staged(postings.join(heads.hint("merge"), "token").select(F.col("token").alias("group"), "node"))


def _marks() -> Column:
    """Two bytes a coordinate: agreement on tokens is never undercounted."""
    return F.transform("tokens", lambda t: F.pmod(t, F.lit(32749)).cast("short")).alias("marks")


#: Coordinates of the longer signatures of large clusters, and the standard deviations their threshold allows.
FINE, FINE_DEVIATIONS = 128, 6


def refined(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """clusters(group, node), those that fill more than a part cut along longer signatures.

    Documents of a common template agree with one another in chains, far below `percent`;
    only those whose FINE coordinates agree stay in a cluster, found by their posting
    lists, so whole sets of the others never meet. Members without a partner left go.
    """
    sums = clusters.join(sets.select("node", "n").hint("merge"), "node").groupBy("group").agg(F.sum("n").alias("total"))
    large = staged(clusters.join(sums.filter(F.col("total") > SET_PART).hint("merge"), "group", "left_semi"))
    if large.isEmpty():
        return clusters
    least = agreement(FINE, percent / 100, FINE_DEVIATIONS)
    fine = staged(_resigned(sets.join(large.select("node").hint("merge"), "node", "left_semi"), FINE))
    alike = components(connect(_lists(fine, FINE, least), fine.select("node", "n", _marks()), "1", SIGNATURE_PART, least, percent))
    small = clusters.join(large.select("node").hint("merge"), "node", "left_anti").select("group", "node")
    return small.unionByName(alike.select(F.col("root").alias("group"), "node"))


#: What one part of a group holds at most: shingles where whole sets are compared, else signatures.
SET_PART, SIGNATURE_PART = 600_000, 4_096
#: Documents of one component of a part that stand for it when parts meet.
SPEAKERS = 4


#: Members from which whole sets of a group are counted together, and what a tile of their counts holds at most.
MANY, _TILE = 64, 1 << 20


def linked(flat: np.ndarray, cut: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """For each of the sets flat[cut[i] : cut[i + 1]], in order, which of the later sets it is linked with.

    Elements that an eighth of the sets have are columns of a 0/1 matrix, whose products count
    exactly below 2**24; the others are counted along their lists. So a pair costs a few
    multiplications in place of a search in its whole sets, and the result is the same.
    """
    size = np.diff(cut)
    m = len(size)
    order = np.argsort(flat, kind="stable")
    posts = np.repeat(np.arange(m, dtype=np.int32), size)[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]]))
    count = np.diff(np.append(starts, len(flat)))
    hot = count > max(8, m // 8)
    column, ends = np.cumsum(hot) - 1, np.repeat(starts + count, count)
    dense = np.zeros((m, int(hot.sum())), np.float32)
    often = np.repeat(hot, count)
    dense[posts[often], np.repeat(column, count)[often]] = 1
    # Places in the lists of the other elements, by set; each meets those that follow in its list.
    seldom = np.flatnonzero(~often)
    seldom = seldom[ends[seldom] - seldom > 1]
    seldom = seldom[np.argsort(posts[seldom], kind="stable")]
    after = ends[seldom] - seldom - 1
    at = np.searchsorted(posts[seldom], np.arange(m + 1))
    work = np.concatenate([[0], np.cumsum(after)])[at] + np.arange(m + 1) * m
    i = 0
    while i < m:
        j = min(m, i + 256, max(i + 1, int(np.searchsorted(work, work[i] + _TILE, "right")) - 1))
        both = (dense[i:j] @ dense[i:].T).astype(np.int32)
        mine, n = seldom[at[i] : at[j]], after[at[i] : at[j]]
        if len(mine):
            where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(mine + 1, n)
            both += np.bincount(np.repeat((posts[mine] - i).astype(np.int64) * (m - i), n) + posts[where] - i, minlength=both.size).reshape(both.shape).astype(np.int32)
        hit = both.astype(np.int64) * (100 + percent) >= (size[i:j, None] + size[None, i:]) * percent
        for x in range(j - i):
            yield hit[x, x + 1 :]
        i = j


def _links(least: int, percent: int):
    """Compares the members of each group and returns pairs that connect what was not yet connected.

    Members that have a root in common, at the start or by an earlier pair, are not compared.
    The others must be of similar size and agree on `least` coordinates; where shingles
    are there, their whole sets decide, in groups of MANY members all together.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("group", "ascending"), ("node", "ascending")])
        column = lambda c: table[c].to_numpy()
        group, node, root, part, size = (column(c) for c in ("group", "node", "root", "part", "n"))
        cross = bool(table["i"][0].as_py() != table["j"][0].as_py())
        marks = pa.concat_arrays(table["marks"].chunks).flatten().to_numpy().reshape(len(node), -1)
        exact = "shingles" in table.column_names
        if exact:
            lists = pa.concat_arrays(table["shingles"].chunks)
            flat, cut = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(size)])
        borders = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        a, b = [], []
        for low, high in zip(borders[:-1], borders[1:], strict=True):
            if high - low < 2:
                continue
            label = root[low:high].copy()
            many = exact and high - low >= MANY
            hits = linked(flat[cut[low] : cut[high]], cut[low : high + 1] - cut[low], percent) if many else None
            for x in range(low, high - 1):
                y = np.flatnonzero(label[x - low + 1 :] != label[x - low]) + x + 1
                if cross:
                    y = y[part[y] != part[x]]
                if many:
                    y = y[next(hits)[y - x - 1]]
                else:
                    y = y[np.minimum(size[y], size[x]) * 100 >= np.maximum(size[y], size[x]) * percent]
                    if len(y):
                        y = y[(marks[y] == marks[x]).sum(1) >= least]
                if exact and not many and len(y):
                    mine = flat[cut[x] : cut[x + 1]]
                    theirs = np.concatenate([flat[cut[i] : cut[i + 1]] for i in y])
                    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                    both = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.concatenate([[0], np.cumsum(size[y])[:-1]]))
                    y = y[both * 100 >= (size[y] + size[x] - both) * percent]
                if len(y):
                    joined, first = np.unique(label[y - low], return_index=True)
                    a += [int(node[x])] * len(first)
                    b += node[y[first]].tolist()
                    label[np.isin(label, joined)] = label[x - low]
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _compared(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """The linking pairs of rows(pack, group, i, j, part, node, root, n, marks[, shingles])."""
    return rows.groupBy("pack", "i", "j").applyInArrow(_links(least, percent), "a long, b long")


def _rooted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    roots = labels.select("node", F.col("root").alias("_root"))
    return rows.drop("root").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")


def connect(members: DataFrame, payload: DataFrame, weight: str, cap: int, least: int, percent: int) -> DataFrame:
    """The pairs that connect all members(group, node) of a group that can be linked in it.

    payload(node, n, marks[, shingles]). A group is dealt in parts of at most about `cap`
    by weight; small groups share a part. First each part is connected in itself, which is
    all for a group of one part. Of larger groups a few speakers of each component then meet.
    What still lies in several components is compared in full: large components in parts of
    their own, which never meet each other, small ones together.
    """
    weights = payload.select("node", F.col(weight).cast("long").alias("w")) if weight != "1" else payload.select("node", F.lit(1).cast("long").alias("w"))
    rows = staged(members.join(weights.hint("merge"), "node"))
    sums = rows.groupBy("group").agg(F.sum("w").alias("total"))
    parts = F.ceil(F.col("total") / cap).cast("int")
    total = rows.agg(F.sum("w")).first()[0] or 0
    packs = max(1, math.ceil(total * 8 / cap))  # small groups are dealt finer, for more tasks
    dealt = rows.join(sums.hint("merge"), "group").withColumn("parts", parts)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = staged(dealt.withColumn("pack", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("group"), F.lit(packs))).otherwise(F.xxhash64("group", "part"))).drop("total"))
    inside = dealt.drop("w").withColumns({"root": F.col("node"), "i": F.lit(0), "j": F.lit(0)})
    found = checkpointed(_compared(inside.join(payload.hint("merge"), "node"), least, percent))
    large = dealt.filter("parts > 1").select("group", "node", "part", "w")
    if large.isEmpty():
        return found
    rows = _rooted(large, components(found))
    speaks = Window.partitionBy("group", "part", "root").orderBy(F.xxhash64("node"))
    meeting = rows.withColumn("rank", F.row_number().over(speaks)).filter(F.col("rank") <= SPEAKERS).drop("rank")
    seats = meeting.groupBy("group").agg(F.ceil(F.sum("w") / cap).cast("int").alias("seats"))
    meeting = meeting.join(seats.hint("merge"), "group").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("seats")).cast("int"))
    meeting = meeting.withColumns({"pack": F.xxhash64("group", "part"), "i": F.lit(0), "j": F.lit(0)}).drop("seats", "w")
    found = checkpointed(found.union(_compared(meeting.join(payload.hint("merge"), "node"), least, percent)))
    rows = _rooted(large, components(found))
    # Several components in a group: blocks of large ones by themselves, of small ones together.
    held = staged(rows.groupBy("group", "root").agg(F.sum("w").alias("held")))
    mixed = held.groupBy("group").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("held") * 2 <= cap, F.col("held")).otherwise(0)).alias("rest")).filter("roots > 1")
    rows = rows.join(mixed.hint("merge"), "group").join(held.hint("merge"), ["group", "root"])
    own = F.col("held") * 2 > cap
    block = F.when(own, F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / cap)))).otherwise(F.pmod(F.xxhash64("root"), F.greatest(F.lit(1), F.ceil(F.col("rest") / cap))))
    rows = staged(rows.select("group", "node", "root", block.alias("block"), F.when(own, F.col("root")).alias("single")))
    blocks = rows.select("group", "block", "single").distinct()
    other = blocks.select("group", F.col("block").alias("other"), F.col("single").alias("other_single"))
    pairs = blocks.join(other.hint("merge"), "group").filter("single IS NULL OR other_single IS NULL OR single <> other_single").select("group", "block", "other")
    rows = rows.join(pairs.hint("merge"), ["group", "block"]).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "part": F.pmod("block", F.lit(2147483647)).cast("int")})
    rows = rows.withColumn("pack", F.xxhash64("group", "i", "j")).select("pack", "group", "i", "j", "part", "node", "root")
    return checkpointed(found.union(_compared(rows.join(payload.hint("merge"), "node"), least, percent)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = 40) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Two documents are linked if their sets of `words`-word shingles have a Jaccard
    similarity of at least `percent` / 100, confirmed on the whole sets (as 64-bit hashes);
    component_id is the smallest doc_id reachable. A document without words has an empty
    set and is linked with nothing; one with fewer words than a shingle is one shingle. Rows
    that share a doc_id are one document. A null doc_id is linked with nothing and kept.
    """
    return _components(docs, staged(sketch(docs, words, k)), words, percent, k)


def _components(docs: DataFrame, rows: DataFrame, words: int, percent: int, k: int) -> DataFrame:
    least = agreement(k, percent / 100)
    linked = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets are one class, named by its smallest doc_id; copies are never paired with each other.
    classes = staged(linked.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")))
    lists = _lists(classes, k, least)
    inside = lists.select("node").distinct()
    signatures = staged(classes.join(inside.hint("merge"), "node", "left_semi").select("node", F.col("n_shingles").alias("n"), _marks()))
    # Lists give clusters of documents whose signatures agree; whole sets are compared inside a cluster only.
    alike = components(connect(lists, signatures, "1", SIGNATURE_PART, least, percent))
    clusters = alike.select(F.col("root").alias("group"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = staged(full_sets(by_ids(texts, clusters.select(F.col("node").alias("doc_id")))[0], words).withColumnRenamed("doc_id", "node"))
    whole = staged(signatures.join(sets.hint("merge"), "node").withColumn("n", F.size("shingles").cast("long")))
    labels = components(connect(refined(clusters, whole, percent), whole, "n", SET_PART, least, percent))
    # From classes to rows.
    named = classes.select("set_a", "set_b", F.col("node").alias("class")).join(labels.select(F.col("node").alias("class"), "root").hint("merge"), "class", "left")
    named = named.select("set_a", "set_b", F.coalesce("root", "class").alias("component_id"))
    out = linked.select("doc_id", "n_shingles", "set_a", "set_b").join(named.hint("merge"), ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def by_ids(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows joined with the columns of ids, all other rows), by doc_id.

    A bitmap of fixed size, built from the ids and broadcast, passes over most rows before
    the exact join, so that texts of other rows are not shuffled while ids are few.
    """
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(_BITS))
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    bits = ids.select(slot.alias("_slot")).groupBy(F.expr("_slot div 64").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    rows = rows.withColumn("_slot", slot).withColumn("_word", F.expr("_slot div 64")).join(F.broadcast(staged(bits)), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    maybe, never = rows.filter(hit).drop("_slot", "_word", "_bits"), rows.filter(~hit).drop("_slot", "_word", "_bits")
    found = maybe.join(ids.hint("merge"), "doc_id")
    return found, never.unionByName(maybe.join(ids.select("doc_id").hint("merge"), "doc_id", "left_anti"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, k: int = 40) -> DataFrame:
    """The rows of docs that stay: one document of each component, the one with the smallest doc_id.

    Of rows that repeat a doc_id one stays: the one with the smallest text, null and empty
    texts last; rows without doc_id all stay. Rows that are neither linked nor repeated are not shuffled.
    """
    rows = staged(sketch(docs, words, k))
    gone = _components(docs, rows, words, percent, k).filter("NOT kept").select("doc_id", F.lit(True).alias("_gone"))
    again = rows.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id", F.lit(False).alias("_gone"))
    special = staged(gone.union(again).groupBy("doc_id").agg(F.max("_gone").alias("_gone")))
    keyed = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    found, rest = by_ids(keyed, special)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = found.filter("NOT _gone").groupBy("doc_id").agg(F.min_by(row, F.struct(text == "", text)).alias("_row")).select("_row.*")
    return rest.select(*docs.columns).unionByName(one)
