import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import prose, split_words

from stockpot.llm import ann, common, langid, lm, toxicity


def crc(doc, mod):
    return zlib.crc32(str(doc).encode()) % mod


def toxic_corpus(spark, n=900):
    rng = random.Random(8)
    bad = ["idiot", "moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = prose(rng, rng.randint(5, 80)), int(rng.random() < 0.3)
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
            text = " ".join(w)
        rows.append((i, "the of and " + text, "en", "s"))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity.toxicity_digest(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    right = sum(r["predicted"] == r["toxic"] for r in held)
    assert len(got) == 900 and right / len(held) > 0.95


def test_toxicity_of_the_tables(spark, data):
    from pathlib import Path

    folder = str(Path(data).parent / "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = toxicity.toxicity_digest(docs, labels).filter("held_out").join(labels, "doc_id")
    hit = held.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert hit[0] / hit[1] > 0.85 and hit[0] / hit[2] > 0.75


def test_toxicity_reads_only_the_text(spark):
    docs, labels = toxic_corpus(spark, 300)
    model = toxicity.fit(docs, labels)
    moved = docs.select((F.col("doc_id") + 5).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit(None).cast("string").alias("source"))
    one = sorted(r["score"] for r in toxicity.score(docs, model).collect())
    assert one == pytest.approx(sorted(r["score"] for r in toxicity.score(moved.repartition(3), model).collect()))


def test_blocks_of_a_long_text_give_the_same_logit():
    rng = random.Random(2)
    model = toxicity.train(pa.array([prose(rng, 30) for _ in range(80)]), np.arange(80) % 2, epochs=1)
    a = np.arange(999) % 500
    counts = np.array([0, 3, 990, 6])
    whole = toxicity.logits(model, a, a, counts)
    assert np.allclose(whole, toxicity.logits(model, a, a, counts, tokens=7))


def test_toxicity_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 1, 1), (5, 0, 0), (5, 0, 1), (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_digest(odd, labels).count() == len(odd_rows)
    assert toxicity.toxicity_digest(empty, labels.limit(0)).count() == 0
    assert toxicity.toxicity_digest(odd, labels.limit(0)).count() == len(odd_rows)


# language


def test_language_on_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95


def test_language_odd_rows(odd, odd_rows, empty):
    got = langid.language_digest(odd).collect()
    by = {r["doc_id"]: r for r in got}
    learned = {la for i, t, la, *_ in odd_rows if la and i is not None and t is not None and crc(i, 5)}
    assert len(got) == len(odd_rows) and {by[i]["lang_pred"] for i in (2, 3, 4, 7)} == {"und"}
    assert all(by[i]["lang_pred"] in learned for i in (1, 5, 6, 8, 9, 10))
    assert langid.language_digest(empty).count() == 0


def test_windows_of_a_long_text_give_the_same_counts():
    texts = pa.array(["abc déf. ghi" * 9, "", None, "x", "Zwei Wörter"])
    assert (langid.counts(texts) == langid.counts(texts, window=5)).all()
    assert langid.counts(texts)[1].sum() == 0


def test_distance_rejects_foreign_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "zzzz qqqq xxxx jjjj " * 20), (2, "漢字仮名交じり文" * 10)], "doc_id long, text string")
    assert [r["rejected"] for r in langid.identify(odd, model).orderBy("doc_id").collect()] == [True, True]
    assert langid.identify(docs, model).filter("rejected").count() < 0.1 * docs.count()


# language model


def check_lm(docs):
    known = docs.select("doc_id", "text").collect()
    got = lm.score(docs).collect()
    assert len(got) == len(known)
    tokens = {r["doc_id"]: [*split_words(r["text"]), "\n"] for r in known}
    c = Counter()
    for r in known:
        if r["doc_id"] is None or crc(r["doc_id"], 7) != 2:
            c.update(tokens[r["doc_id"]])
    n, v = sum(c.values()), len(c)
    for r in got:
        words = tokens[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel=1e-9, abs=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(c[w] > 0 for w in words), n)
        assert r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"], 7) == 2)
    return got


def test_scores_against_brute_force(spark, data):
    held = [r for r in check_lm(spark.read.parquet(f"{data}/documents.parquet")) if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_tail_words_meet_by_shuffle(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    monkeypatch.setattr(lm, "HEAD", 50)
    check_lm(docs)


def test_lm_learns_from_all_training_rows(spark, data, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 5_000)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    scores = lambda d, sample: {r["doc_id"]: r["score"] for r in lm.score(d, sample=sample).collect()}
    whole = scores(docs, 6_000)
    assert scores(docs.repartition(3), 5) == pytest.approx(whole, rel=1e-9)


def test_pieces_hold_every_training_position_once(spark):
    rows = spark.createDataFrame([(1, False, "a b c d e f g h i j k l m n o p"), (2, False, ""), (3, True, "x"), (4, False, "a b c")], "row long, held_out boolean, text string")

    def symbols_of(texts):
        words = [len(t.split()) + 1 for t in texts.to_pylist()]
        return np.concatenate([np.arange(n) for n in words]), np.array(words)

    pieces = {(r["row"], r["piece"]): list(r["symbols"]) for r in lm._pieces(rows, 3, symbols_of, 7).collect()}
    assert pieces == {(1, 0): [*range(7)], (1, 1): [*range(4, 14)], (1, 2): [*range(11, 17)], (2, 0): [0], (4, 0): [*range(4)]}
    u = np.full(lm.OUTPUTS, 1 / lm.OUTPUTS)
    p = lm.start(u)
    moved = lm.learn(p, u, np.array([4, 5, 6, 7]), np.array([4]), np.array([3]))
    assert (moved["q"] != p["q"].astype(np.float32)).any(1)[7] and not np.allclose(moved["b"][7], p["b"][7])


def test_lm_odd_rows(odd, empty):
    check_lm(odd)
    assert lm.score(empty).count() == 0


def test_probabilities_are_normalised():
    rng = np.random.default_rng(0)
    lengths = np.array([400, 600])
    symbols = rng.integers(0, lm.OUTPUTS, 1000)
    m = lm.train(symbols, lengths, epochs=1)
    history = np.repeat(lm.histories(symbols, lengths)[7:8], lm.OUTPUTS, 0)
    assert np.exp(m.log_probabilities(np.arange(lm.OUTPUTS), history)).sum() == pytest.approx(1, abs=1e-5)
    assert lm.histories(np.array([4, 5, 6, 7]), np.array([3, 1])).tolist() == [[256, 256, 256], [4, 256, 256], [5, 4, 256], [256, 256, 256]]


def test_model_learns_what_follows():
    symbols = np.tile([1, 2, 3], 3000)
    m = lm.train(symbols, np.array([9000]))
    follow = m.log_probabilities(np.array([2, 1]), np.array([[1, 3, 2], [1, 3, 2]]))
    assert follow[0] > np.log(0.5) > follow[1]


def test_lookup():
    words = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    table = lm.Lookup.of(words)
    at = table.find(words)
    assert (table.keys[at[at >= 0]] == words[at >= 0]).all() and (at >= 0).mean() > 0.99
    assert (table.find(words + np.uint64(1)) == -1).mean() > 0.99


# neighbours


def brute_nearest(rows, top=5):
    fit = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in fit.items():
        if q % 50 == 0:
            scored = [(-(x @ y) / np.sqrt(x @ x) / np.sqrt(y @ y), j) for j, y in fit.items() if j != q]
            out[q] = [(j, -s) for s, j in sorted(scored)[:top]]
    return out


def nearest(spark, rows, **options):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "cell": F.lit(2), "block": F.lit(3)})
    got = {}
    for r in ann.nearest(v, v.filter("vec_id % 50 = 0"), **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def random_rows(n, dim=16, seed=3):
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, dim)))]


def test_exact_where_all_cells_are_visited(spark):
    rows = [*random_rows(400), (1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), *[(2000 + i, [1.0] * 16) for i in range(10)]]
    got, want = nearest(spark, rows, share=1.0), brute_nearest(rows)
    assert {q: [(j, pytest.approx(s, abs=1e-12)) for j, s in hits] for q, hits in want.items()} == {q: [(j, s) for _, j, s in hits] for q, hits in got.items()}
    # equal vectors come in order of their ids
    assert [j for _, j, _ in got[2000]] == [2001, 2002, 2003, 2004, 2005]


def test_toxicity_sample_is_bounded_by_words(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 5_000 if i % 7 == 0 else 30) + (" vile" if i % 3 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, most_words=9_000)
    # At most one of the long texts fits into the bound, so hardly any of their words is known.
    assert model.known_words.sum() < 0.2 * toxicity.fit(docs, labels).known_words.sum()
    assert toxicity.score(docs, toxicity.fit(docs, labels, most_words=0)).filter("score BETWEEN 0 AND 1").count() == 120


def test_more_languages_than_the_sample_holds(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 8) + f" w{i % 40}w" * 9, f"l{i % 40:02}") for i in range(400)] + [(1000 + i, "zzz yyy", "l00") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(langid.fit(docs, most=10).langs)[0] == "l00" and len(langid.fit(docs, most=10).langs) == 10
    many = langid.fit(docs, per_language=5, most=200)
    assert len(many.langs) == 40 and len(many.owner) == 120


def recall(spark, rows):
    got, want = nearest(spark, rows), brute_nearest(rows)
    return sum(len({j for j, _ in want[q]} & {j for _, j, _ in got[q]}) for q in want) / sum(map(len, want.values()))


def test_recall_with_the_parameters_of_the_query(spark, data):
    """Random vectors are the hardest case: their neighbours lie in cells far apart."""
    from pathlib import Path

    v = spark.read.parquet(str(Path(data).parent / "sf0.1/embeddings.parquet"))
    assert recall(spark, [(r["vec_id"], list(r["embedding"])) for r in v.collect()]) >= 0.93
    assert recall(spark, random_rows(6_000, 48)) >= 0.93 and ann.SHARE < 0.7


def test_each_length_has_its_own_index(spark):
    few = [(10_000 + i, [float(i % 7), 1.0, float(i % 3)]) for i in range(120)]
    rows = [*random_rows(300), *few]
    got, want = nearest(spark, rows, share=1.0), brute_nearest(rows[:300]) | brute_nearest(few)
    assert len(want) == 9 and {q: [j for j, _ in hits] for q, hits in want.items()} == {q: [j for _, j, _ in hits] for q, hits in got.items()}


def test_repeated_ids_are_one_candidate_with_its_best_score(spark):
    rows = [(50, [1.0, 0.0]), (51, [0.0, 1.0]), (51, [1.0, 0.1]), (52, [1.0, 1.0])]
    assert [j for _, j, _ in nearest(spark, rows)[50]] == [51, 52]


def test_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 30)
    monkeypatch.setattr(ann, "CHUNK", 2)
    rows = [*random_rows(300), *[(3000 + i, [1.0] * 15 + [1.5]) for i in range(100)]]
    got, want = nearest(spark, rows, share=1.0), brute_nearest(rows)
    assert {q: [j for j, _ in hits] for q, hits in want.items()} == {q: [j for _, j, _ in hits] for q, hits in got.items()}


def test_few_or_no_vectors(spark):
    assert nearest(spark, []) == {} and nearest(spark, [(50, None)]) == {}
    assert [j for _, j, _ in nearest(spark, [(50, [1.0, 0.0]), (51, [1.0, 1.0]), (52, [0.0, 1.0]), (53, [1.0])])[50]] == [51, 52]


def test_traverse_goes_by_summed_distance():
    a, b = np.array([0.3, 0.1, 0.9]), np.array([0.2, 0.0])
    order = ann.traverse(a, b, np.ones(6, np.int64), 6)
    sums = [a[c // 2] + b[c % 2] for c in order]
    assert sums == sorted(sums) and len(set(order.tolist())) == 6


def test_toxicity_learns_from_rows_beyond_any_bound(spark):
    """A word of toxic rows that a hash sample of 5,000 leaves out is learnt too."""
    rng = random.Random(6)
    ids = spark.range(9_000).filter("crc32(string(id)) % 4 <> 2").withColumn("_h", F.xxhash64("id"))
    later = {r["id"] for r in ids.join(common.hash_sample(ids, "_h", 5_000), "_h", "left_anti").collect()}
    rows = [(i, prose(rng, 6) + ((" gorp" if i in later else " vile") if i % 4 == 0 else "")) for i in range(9_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    asked = spark.createDataFrame([(i, prose(rng, 6) + end) for i, end in enumerate([" gorp", " vile", ""] * 20)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] >= toxicity.CUT for r in toxicity.score(asked, toxicity.fit(docs, labels)).collect()}
    assert sum(got[i] == (i % 3 != 2) for i in got) >= 58


def test_toxicity_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 120)
    test_toxicity_on_held_out_rows(spark)
