import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import prose, split_words

from stockpot.llm import common, embdedup, minhash, wordhash
from stockpot.llm.components import components


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def shingle_sets(docs, n):
    out = {}
    for doc, text in docs:
        w = split_words(text)
        out[doc] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    return out


def brute(sets, percent):
    """Components by comparing every pair that shares a shingle."""
    holders, found = defaultdict(list), Union()
    for doc, s in sets.items():
        for x in s:
            holders[x].append(doc)
    for doc, s in sets.items():
        common_count = defaultdict(int)
        for x in s:
            for other in holders[x]:
                if other < doc:
                    common_count[other] += 1
        for other, both in common_count.items():
            if both * 100 >= percent * (len(s) + len(sets[other]) - both):
                found.join(doc, other)
    return {doc: found.root(doc) for doc in sets}


def check(docs, n, percent):
    known = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    sets = shingle_sets(known, n)
    want = brute(sets, percent)
    got = minhash.near_duplicates(docs, n, percent).collect()
    assert len(got) == len(known)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    return want


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, data, n, percent):
    assert len(set(check(spark.read.parquet(f"{data}/documents.parquet"), n, percent).values())) < 200


def family(rng, size, edits, words=120):
    base = prose(rng, words).split()
    for _ in range(size):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(words)] = prose(rng, 1)
        yield " ".join(copy)


def test_large_groups_near_the_threshold(spark, monkeypatch):
    rng = random.Random(3)
    texts = [*family(rng, 150, 1), *family(rng, 150, 3), *family(rng, 60, 6), *["same text over and over"] * 300, *[prose(rng, 80) for _ in range(200)]]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    want = check(docs, 3, 85)
    # Small parts force the rounds between parts; the result stays the same.
    monkeypatch.setattr(minhash, "SET_PART", 3_000)
    monkeypatch.setattr(minhash, "SIGNATURE_PART", 40)
    assert check(docs, 3, 85) == want


def test_clusters_of_a_template_are_cut_along_longer_signatures(spark, monkeypatch):
    rng = random.Random(8)
    # 200 documents that share 85 of 120 words in place, far below the threshold with one another, and one copy of each tenth.
    template, texts = prose(rng, 85), []
    for i in range(200):
        own = prose(rng, 35)
        texts.append(f"{template} {own}")
        if i % 10 == 0:
            texts.append(f"{template} {own} end")
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    met = []
    compared = minhash.connect
    monkeypatch.setattr(minhash, "connect", lambda members, *rest: met.append(members.count()) or compared(members, *rest))
    monkeypatch.setattr(minhash, "SET_PART", 3_000)
    check(docs, 3, 85)
    lists, fine, whole = met  # the coarse lists, the longer signatures' lists, the clusters whose whole sets meet
    assert lists and fine and 40 <= whole < 120, met


def test_longer_signatures_lose_no_pair_at_the_threshold():
    rng, lost = np.random.default_rng(5), 0
    for _ in range(400):
        s = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = minhash.signature(s[:185], minhash.FINE), minhash.signature(s[15:], minhash.FINE)  # 170 of 200 in common: 0.85
        lost += int((a == b).sum()) < minhash.agreement(minhash.FINE, 0.85, minhash.FINE_DEVIATIONS)
    assert lost == 0


def test_short_texts_ties_and_shared_passages(spark):
    rng = random.Random(4)
    passage = prose(rng, 60)
    texts = ["a", "A", "a b", "a  b", "a b c", "", None, " ", *[f"{prose(rng, 90)} {passage}" for _ in range(80)], passage, passage + " end"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85)


def test_duplicates_odd_rows(spark, odd, odd_rows, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["kept"] and by[3]["n_shingles"] == 0 and by[3]["kept"]
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 1
    assert minhash.deduplicate(empty).count() == 0
    again = spark.createDataFrame([(1, None), (1, "b c d"), (1, ""), (1, "b c"), (2, None), (2, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"] or "") for r in minhash.deduplicate(again).collect()) == [(1, "b c"), (2, "")]


def test_deduplicate_keeps_one_of_each(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = brute(shingle_sets([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], 5), 80)
    kept = minhash.deduplicate(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert kept.exceptAll(docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 1)]
    found = Union()
    for a, b in edges:
        if a is not None and a != b:
            found.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: found.root(n) for n in list(found)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes(monkeypatch):
    texts = ["A b\tc", None, "", "  x", "É é", "ab" * 40, "tail "]
    column = pa.array(texts)
    words = [w for t in texts for w in split_words(t)]
    hashes, counts, first = wordhash.word_hashes(column, prefix=2)
    assert counts.tolist() == [len(split_words(t)) for t in texts] and len(hashes) == len(words)
    assert [wordhash.hash_of(w) for w in words] == hashes.tolist() and len(set(hashes.tolist())) == len(set(words))
    _, _, last = wordhash.word_hashes(column, suffix=2)
    monkeypatch.setattr(wordhash, "WINDOW", 5)
    again, counts2, first2 = wordhash.word_hashes(column, prefix=2)
    assert (again == hashes).all() and (counts2 == counts).all() and (first2 == first).all()
    assert (wordhash.word_hashes(column, suffix=2)[2] == last).all()
    sliced = wordhash.word_hashes(column.slice(4, 2))[0]
    assert sliced.tolist() == [wordhash.hash_of(w) for w in ("É", "é", "ab" * 40)]


def test_ordered_prefix(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i, i % 5) for i in range(500)], "k string, i int, v int")
    got = {(r["k"], r["i"]): r["v_before"] for r in common.ordered_prefix(rows, ["k", "i"], ["v"]).collect()}
    total = 0
    for k, i, v in sorted(map(tuple, rows.collect())):
        assert got[(k, i)] == total
        total += v
    assert common.ordered_prefix(rows.limit(0), ["k", "i"], ["v"]).count() == 0


def test_join_small_salts(spark, monkeypatch):
    rows = spark.range(300).select((F.col("id") % 7).cast("string").alias("k"), "id")
    side = spark.createDataFrame([(str(i), i) for i in range(5)], "k string, x int")
    want = sorted(common.join_small(rows, side, "k").select("id", "x").collect(), key=lambda r: r["id"])
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert sorted(common.join_small(rows, side, "k").select("id", "x").collect(), key=lambda r: r["id"]) == want


# vectors


def brute_vectors(rows, cosine=0.93):
    """Links and components of (vec_id, embedding, label)."""
    fit = [(i, np.array(v, float), la) for i, v, la in rows if i is not None and v is not None and la is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    found, links = Union(), defaultdict(int)
    for a in range(len(fit)):
        for b in range(a):
            (i, x, la), (j, y, lb) = fit[a], fit[b]
            if la == lb and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                links[i] += 1
                links[j] += 1
                found.join(i, j)
    return {i: (links[i], found.root(i)) for i, _, _ in rows if i is not None}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit(1), "bucket": F.lit(2), "copies": F.lit(3)})


def cloud(seed, n=240, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    out = []
    for i in range(n):
        v = centres[i % 12] + rng.normal(0, 0.12 + 0.02 * (i % 9), dim) if i % 3 else rng.normal(size=dim)
        out.append((i, [float(np.float32(x)) for x in v * (1 + i % 4)], int(i % 12 % 2)))
    return out


ODD_VECTORS = [(900, None, 0), (901, [0.0] * 16, 0), (902, [None] + [1.0] * 15, 0), (903, [float("nan")] * 16, 0), (904, [float("inf")] + [1.0] * 15, 0), (905, [1.0] * 16, None), (906, [1.0] * 8, 0), (907, [2.0] * 8, 0), (908, [], 1)]


def test_near_vectors_against_brute_force(spark):
    rows = [*cloud(1), *ODD_VECTORS, *[(1000 + i, [1.0, *[0.5] * 15], 1) for i in range(5)]]
    want = brute_vectors(rows)
    got = embdedup.near_vectors(vectors(spark, rows)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_large_bucket_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "BLOCK", 20)
    monkeypatch.setattr(embdedup, "SKETCHES", 30)
    monkeypatch.setattr(embdedup, "SKETCH", 9)
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(0, 0.05 + 0.4 * (i % 3 == 0), 16)], 1) for i in range(150)]
    # Parameters are made into the function that is sent, so block sizes hold on all workers.
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_vectors(vectors(spark, rows)).collect()} == brute_vectors(rows)


def test_near_vectors_without_rows(spark):
    assert embdedup.near_vectors(vectors(spark, [])).count() == 0
    got = embdedup.near_vectors(vectors(spark, ODD_VECTORS[:3] + [(None, [1.0] * 16, 0)])).collect()
    assert all(r["n_links"] == 0 and r["kept"] for r in got)


def test_parameters_keep_recall():
    for n in (100, 10_000, 1_000_000):
        k, tables, width = embdedup.parameters(n, 0.93)
        near = embdedup.collision(np.sqrt(2 - 2 * 0.93), width) ** k
        assert (1 - near) ** tables <= embdedup.MISS


def test_sketches_are_never_farther_apart_than_their_vectors():
    rng = np.random.default_rng(2)
    for dim in (3, 40, 200):
        x = rng.normal(size=(300, dim))
        x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.2])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = embdedup._sketches(x).astype(float)
        far = np.sqrt(((s[:, None] - s[None]) ** 2).sum(2))
        assert (far <= 127 * np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) + np.sqrt(s.shape[1]) + 1e-3).all()


def template_sets(copies, size, most, seed=8):
    """Sorted sets of copies of one template, each with up to `most` of its elements replaced."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, size, dtype=np.uint64)
    return [np.unique(np.where(rng.random(size) < rng.uniform(0, most), rng.integers(0, 5_000, size).astype(np.uint64), base)) for _ in range(copies)]


@pytest.mark.parametrize("tile", [300, 1 << 20])
@pytest.mark.parametrize("percent", [50, 85, 100])
def test_sets_counted_together_link_as_one_by_one(monkeypatch, tile, percent):
    monkeypatch.setattr(minhash, "_TILE", tile)
    sets = [*template_sets(90, 60, 0.2), *[np.array([i], np.uint64) for i in (3, 4, 3)]]
    got = list(minhash.linked(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), percent))
    for i, row in enumerate(got):
        both = [len(np.intersect1d(sets[i], s)) for s in sets[i + 1 :]]
        assert row.tolist() == [b * 100 >= (len(sets[i]) + len(s) - b) * percent for b, s in zip(both, sets[i + 1 :], strict=True)]


@pytest.mark.parametrize(("least", "percent"), [(22, 85), (19, 80)])  # of op9 and of the pipeline
def test_template_copies_that_stay_apart_are_compared_in_seconds(least, percent):
    """A group of 1,200 copies of which most link with none: one search a pair took the CPU time below many times over."""
    sets = template_sets(1_200, 390, 0.25)
    sizes = [len(s) for s in sets]
    marks = [[0] * 40] * len(sets)
    zero = [0] * len(sets)
    table = pa.table({"group": zero, "node": range(len(sets)), "root": range(len(sets)), "part": zero, "i": zero, "j": zero, "n": sizes, "marks": pa.array(marks, pa.list_(pa.int16())), "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})
    began = time.process_time()
    pairs = minhash._links(least, percent)(table).to_pylist()
    assert time.process_time() - began < 3
    root = list(range(len(sets)))
    for p in pairs:
        a, b = root[p["a"]], root[p["b"]]
        assert a != b and len(np.intersect1d(sets[p["a"]], sets[p["b"]])) * (100 + percent) >= (sizes[p["a"]] + sizes[p["b"]]) * percent
        root = [a if r == b else r for r in root]
    assert 1 < len(set(root)) < len(sets)


def test_no_table_that_grows_is_broadcast(spark, data, monkeypatch):
    """Staged tables are small files of many rows; only the bitmap of fixed size and sides that were counted (join_small) may be broadcast."""
    import re

    from stockpot.llm import components as linked

    plans = []

    def watch(module, name):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df))[1])

    for module, name in ((minhash, "staged"), (minhash, "checkpointed"), (linked, "checkpointed"), (embdedup, "staged")):
        watch(module, name)
    monkeypatch.setattr(minhash, "SIGNATURE_PART", 8)
    monkeypatch.setattr(minhash, "SET_PART", 2000)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for out in (minhash.near_duplicates(docs, 3, 85), embdedup.near_vectors(spark.read.parquet(f"{data}/embeddings.parquet"))):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert plans and [x for x in joins if not re.search(r"BroadcastHashJoin \[(_word|bucket)#", x)] == []
