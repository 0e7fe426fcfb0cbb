import pytest
from test_duplicates import brute, shingle_sets
from test_mixing_and_packing import check_mix, check_pack

from stockpot.llm import toxicity


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    import corpus_pipeline

    folder, out = tmp_path_factory.mktemp("pipeline"), {}
    docs = out["input"] = spark.read.parquet(f"{data}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, data).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_order_and_columns(stages):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    names = stages["input"].columns
    assert all(stages[n].columns == names for n in ("toxicity", "near_dedup", "pii", "mixing"))


def test_toxic_documents_go(spark, data, stages):
    docs = stages["input"]
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    want = {r["doc_id"] for r in toxicity.score(docs, model).filter(f"score < {toxicity.CUT}").collect()}
    assert {r["doc_id"] for r in stages["toxicity"].collect()} == want


def test_one_of_each_group_stays(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["toxicity"].collect()]
    assert sorted(r["doc_id"] for r in stages["near_dedup"].collect()) == sorted(set(brute(shingle_sets(before, 5), 80).values()))


def test_personal_data_is_replaced(stages):
    old = {r["doc_id"]: r["text"] for r in stages["near_dedup"].collect()}
    new = {r["doc_id"]: r for r in stages["pii"].collect()}
    assert old.keys() == new.keys()
    changed = [d for d in old if old[d] != new[d]["text"]]
    assert changed and all(len(new[d]["text"]) == new[d]["n_chars"] for d in changed)


def test_mix_and_pack(stages):
    check_mix(stages["pii"])
    check_pack(stages["mixing"].dropDuplicates(["doc_id"]))
    assert stages["packing"].count() >= stages["mixing"].count()


def test_run(spark, data):
    import corpus_pipeline

    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, data).count() > 0


def test_stages_take_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd, empty):
        docs = start
        for _, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, str(tmp_path))
        docs.count()
