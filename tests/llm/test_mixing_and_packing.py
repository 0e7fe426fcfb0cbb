import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import split_words

from stockpot.llm import mixing, packing


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """Brute force of the resharing rounds."""
    keys = sorted(sizes, key=lambda k: (k is None, k))
    w = {k: weights[i % 3] for i, k in enumerate(keys)}
    out, live, left = {}, set(keys), float(sum(sizes.values()))
    while live:
        total = sum(w[k] for k in live)
        over = {k for k in live if left * w[k] / total > most * sizes[k]}
        if not over:
            return out | {k: left * w[k] / total for k in live}
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
        live -= over
    return out


def check_mix(docs):
    rows = mixing.mix_digest(docs).collect()
    known = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    source = {}
    for r in known:
        sizes[r["source"]] += len(split_words(r["text"], lower=False))
        source[r["doc_id"]] = r["source"]
    want, taken = targets(sizes), defaultdict(int)
    assert len(rows) == len(known)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    return want, taken, rows


def test_mix_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want, taken, rows = check_mix(docs)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = mixing.mix_digest(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mixed_texts_hold_the_taken_words(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    total = mixing.mix_digest(docs).agg(F.sum("taken")).first()[0]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mixing.words(F.col("text")))).first()[0] == total
    assert mixed.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").filter("NOT startswith(whole, text)").count() == 0


def test_one_source_and_caps(spark):
    rows = [(i, "w " * i, "big" if i > 5 else None) for i in range(1, 40)]
    want, taken, _ = check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert taken == {k: round(v) for k, v in want.items()}
    check_mix(spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string"))


def test_mix_odd_rows(odd, empty):
    check_mix(odd)
    assert mixing.mix_digest(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_equal_rows_get_equal_shares(spark):
    rows = [(1, "a b c d e", "s")] * 4 + [(2, "a", "t")]
    got = {tuple(r) for r in mixing.mix_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("doc_id = 1").collect()}
    assert len(got) == 1


# packing


def encode(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def check_pack(docs):
    rows = [r.asDict() for r in packing.pack(docs).collect()]
    texts = docs.select("doc_id", "text").collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for (doc, _), ids in zip(texts, encode([t for _, t in texts]), strict=True):
        mine, at = sorted(pieces[doc], key=lambda r: r["start"]), 0
        if len({r["doc_id"] for r in texts if r["doc_id"] == doc}) == 1 and sum(r["doc_id"] == doc for r in texts) == 1:
            for r in mine:
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
            assert at == len(ids)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    filled = 0
    for where in places.values():
        at = 0
        for offset, length in sorted(where):
            assert offset == at
            at += length
        assert at <= 2048
        filled += at
    return filled / (2048 * max(1, len(places)))


def test_pack_keeps_every_id(spark, data):
    assert check_pack(spark.read.parquet(f"{data}/documents.parquet")) > 0.95


def test_pack_odd_rows(odd, empty):
    check_pack(odd)
    assert packing.pack(empty).count() == 0


def test_fast_encoder_gives_the_same_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, fast = Tokenizer.from_file(path), packing._encoder(path)
    chars = [chr(i) for i in range(0x250)]
    texts = [f"a{c}b {c} {c}{c}1{c}x  {c}\n{c}" for c in chars] + ["<|endoftext|> it's we'LL 12ab  \n\n x", "漢字 Ω", "".join(chars), "ab <|endoftext|> cd", "<|endoftext|>" * 3, "wide words " * (packing.LONG // 10)]
    assert fast("ab <|endoftext|> cd") == [397, 220, 50256, 22927]
    assert [fast(t) for t in texts] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_nnls_and_solve():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 30)), np.zeros(30)
    x[[2, 9, 20]] = (3, 1, 2)
    found = packing.nnls(a, a @ x)
    assert found.min() >= 0 and np.allclose(a @ found, a @ x, atol=1e-6)
    for histogram in (np.r_[0, rng.integers(0, 500, 32)], np.r_[0, np.zeros(19, int), 1000, np.zeros(12, int)], np.r_[0, 7, np.zeros(31, int)], np.zeros(33, int)):
        placed = np.zeros(33, int)
        for parts, n in packing.solve(histogram):
            assert sum(parts) <= 32 and n > 0
            for p in parts:
                placed[p] += n
        assert (placed == histogram).all()
