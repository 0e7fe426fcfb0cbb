import math

import pytest
from pyspark.sql import functions as F

from stockpot.functions import recipes
from stockpot.operators import enrich, frontier, index, mapreduce, ngrams, ranking, spell, stats
from stockpot.plans import crawl, hybrid
from stockpot.sources import sitemaps, store, tables, web
from stockpot.streaming import grams, urls as queue

INGREDIENTS = {
    "1/2 cup milk": ("milk", 0.5, "cup"), "1 1/2 cups flour": ("1/2 cups flour", 1.0, None), "1 / 2 cup oil": ("/ 2 cup oil", 1.0, None),
    "2 large eggs": ("large eggs", 2.0, None), "salt": ("salt", None, None), "0/2 x y": ("x y", None, None), "2 Cups (big) Sifted, Flour": ("sifted flour", 2.0, "cups"),
}


def test_ingredients(spark):
    rows = spark.createDataFrame([(k,) for k in [*INGREDIENTS, " "]], "line string").select("line", recipes.ingredient(F.col("line")).alias("i")).collect()
    got = {r["line"]: r["i"] for r in rows}
    assert {k: (i["name"], i["quantity"], i["unit"]) for k, i in got.items() if k != " "} == INGREDIENTS
    assert got["1/2 cup milk"]["confidence"] == pytest.approx(0.95) and got["salt"]["confidence"] == 0.75
    assert (got[" "]["raw"], got[" "]["confidence"]) == ("", 0.0)


CRAWLED = [
    ("u1", "Bake in oven.\nServe.", "Veggie Pie", (30, None, None), ["2 cups flour", "1 cup milk"], ["Dessert"]),
    ("u2", "Simmer chicken slowly.", "Chicken Stew", (90, None, None), ["1 lb chicken", "graham crackers"], []),
    ("u3", "", None, None, None, None),
    ("u4", "Use an air fryer. Chicken again.", "Gluten-free chicken", (10, None, None), ["flour", "egg"], ["dessert"]),
]
SHAPE = "url string, text string, title string, times struct<totalMinutes:int,prepMinutes:int,cookMinutes:int>, ingredients array<string>, categories array<string>"


@pytest.fixture(scope="module")
def canonical(spark):
    return recipes.normalise(spark.createDataFrame(CRAWLED, SHAPE)).cache()


def test_normalise(canonical):
    got = {r["source_url"]: r for r in canonical.collect()}
    one, two, three, four = (got[f"u{i}"] for i in range(1, 5))
    assert one["recipe_id"].startswith("veggie-pie-") and len(one["recipe_id"]) == len("veggie-pie-") + 12
    assert one["dietary_tags"] == ["vegetarian", "contains-gluten"] and one["appliance_tags"] == ["oven"]
    assert one["steps_raw"] == ["Bake in oven.", "Serve."] and one["ingredient_tokens"] == ["flour", "milk"]
    # "graham" holds "ham"
    assert "vegetarian" not in two["dietary_tags"] and two["dietary_tags"] == ["dairy-free"]
    assert three["title"] == "Untitled Recipe" and three["quality_flags"] == ["low_ingredient_confidence", "missing_appliance_tags", "missing_dietary_tags", "missing_time_fields"]
    assert set(three["extraction_meta"]["missing_field_reasons"]) == {"ingredients", "times", "appliance_tags"}
    assert "gluten-free" in four["dietary_tags"] and "contains-gluten" not in four["dietary_tags"]
    assert four["extraction_confidence"]["dietary_tags"] == 0.72 and three["extraction_confidence"]["dietary_tags"] == 0.35


def test_index_and_hybrid_query(spark, canonical, tmp_path):
    index.build(canonical).write(str(tmp_path / "ix"))
    ix = index.Index.read(spark, str(tmp_path / "ix"))
    assert ix.stats.first()["doc_count"] == 4
    out = hybrid.run(spark, ix, "chicken")
    assert {h["source_url"] for h in out["hits"]} == {"u2", "u4"} and out["total_hits"] == 2
    assert [h["source_url"] for h in hybrid.run(spark, ix, "chicken under 10 minutes")["hits"]] == ["u4"]
    # facets alone score 1; under 30 is the bucket 16-30; an unknown facet leaves nothing
    only = hybrid.run(spark, ix, "vegetarian under 30")
    assert [(h["source_url"], h["score"]) for h in only["hits"]] == [("u1", 1.0)]
    assert hybrid.run(spark, ix, "category:soup chicken")["hits"] == []
    assert len(hybrid.run(spark, ix, "category:dessert")["hits"]) == 2
    assert hybrid.run(spark, ix, "")["hits"] == []
    wrong = hybrid.run(spark, ix, "chikcen")
    assert wrong["did_you_mean"]["suggested_query"] == "chicken"
    fixed = hybrid.run_corrected(spark, ix, "chikcen")
    assert fixed["total_hits"] == 2 and fixed["spell_check_original_query"] == "chikcen"
    # a batch gives what single queries give
    batch = hybrid.batch(spark, ix, ["chicken", "vegetarian under 30"]).collect()
    assert sorted((r["query_id"], r["rank"]) for r in batch) == [(0, 1), (0, 2), (1, 1)]


def test_bm25_by_hand(spark):
    rows = spark.createDataFrame([(2, 1, 3, 4, 3.0), (0, 1, 3, 4, 3.0), (2, 0, 3, 4, 3.0), (1, 3, 3, 0, 0.0)], "tf int, df int, n int, dl int, avg double")
    got = [r[0] for r in rows.select(ranking.bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avg"))).collect()]
    idf = math.log(1 + 2.5 / 1.5)
    assert got[0] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / 3)))
    assert got[1:3] == [0.0, 2.0] and got[3] == pytest.approx(math.log(1 + 0.5 / 3.5) * 2.2 / (1 + 1.2))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("vegetarian under 30 minutes", (["vegetarian"], [], [], ["le30"], [])),
        ("chicken air fryer", ([], ["air fryer"], [], [], ["chicken"])),
        ("category:dessert", ([], [], ["dessert"], [], [])),
        ("under 45", ([], [], [], ["le60"], [])),
        ("vegan recipe", (["vegan"], [], [], [], [])),
        ("under 61 mins tofu", ([], [], [], ["gt60"], ["tofu"])),
        ("", ([], [], [], [], [])),
    ],
)
def test_parse(text, want):
    p = hybrid.parse(text)
    assert (p.dietary, p.appliance, p.category, p.timebucket, p.terms) == want


def test_edits():
    assert len(list(spell._edits("abcd"))) == 74 * 4 + 35
    assert {"bcd", "bacd", "xbcd", "abcdx"} <= set(spell.edits("abcd")) and spell.edits("") == []
    assert len(spell.double_edits("abcdef", 600)) == 600


def test_spelling(spark):
    lines = spark.createDataFrame([("stuff | https://a 500",), ("stuffy | https://b 2",), ("",), ("alone",)], "value string")
    rows = ngrams.from_lines(lines)
    assert {r["gram"]: (r["words"], r["freq_sum"]) for r in rows.collect()} == {"stuff": (["stuff"], 500), "stuffy": (["stuffy"], 2), "alone": ([], 0)}
    scores = ngrams.vocabulary(rows.select("gram", F.col("freq_sum").alias("freq")))
    assert spell.suggest(spark, ["stufx"], scores) == ["stuff"]
    assert spell.suggest(spark, ["stuff"], scores) is None
    assert spell.corrected("Stufx and stufxy", ["stufx"], ["stuff"]) == "stuff and stufxy"


def test_ngram_chain(spark):
    text = "Welcome to CS simple links. Check stuff level check stuff level rights"
    stop = spark.createDataFrame([("welcome",), ("to",), ("cs",)], "word string")
    pages = spark.createDataFrame([("u", text)], "url string, text string")
    got = {r["gram"]: r["freq"] for r in ngrams.local_index(pages, stop).collect()}
    assert len(got) == 18 and sum(got.values()) == 24
    assert got["check"] == 2 and got["check stuff"] == 2 and got["level check"] == 1 and got["simpl link check"] == 1
    flat = spark.createDataFrame([(g, n, "u") for g, n in got.items()], "gram string, freq long, url string")
    assert ngrams.phrase_query(flat, ["stuff"]).count() == 8
    assert ngrams.phrase_query(flat, ["check", "stuff"]).count() == 4
    assert ngrams.phrase_query(flat, []).count() == 0
    assert ngrams.query_stems("Simple links, the stuff!") == ["simpl", "link", "stuff"]


def test_merge(spark):
    old = spark.createDataFrame([("stuff level", 2, "urlB")], "gram string, freq long, url string")
    new = spark.createDataFrame([("stuff level", 3, "urlA"), ("simpl link", 1, "urlA")], "gram string, freq long, url string")
    lines = ngrams.to_lines(ngrams.posting_lists(ngrams.merge(old, new)))
    assert sorted(r["value"] for r in lines.collect()) == ["simpl link | urlA 1", "stuff level | urlA 3 urlB 2"]
    hot = spark.range(50).select(F.lit("a b").alias("gram"), (F.col("id") % 3 + 1).alias("freq"), F.concat(F.lit("u"), F.col("id")).alias("url"))
    several = ngrams.posting_lists(hot.union(old), most=8).collect()
    assert max(len(r["postings"]) for r in several) < 20 and len(several) > 5
    assert sorted(p["url"] for r in several if r["gram"] == "a b" for p in r["postings"]) == sorted(f"u{i}" for i in range(50))
    assert all(r["postings"] == sorted(r["postings"], key=lambda p: (-p["freq"], p["url"])) for r in several)
    twice = ngrams.merge(ngrams.merge(old, new), new).filter("gram = 'simpl link'").first()
    assert twice["freq"] == 2


def test_frontier(spark):
    links = spark.createDataFrame([("x", 2, "b"), ("x", 1, "z"), ("x", 1, "c"), ("seen", 1, "a"), ("deep", 9, "a")], "url string, depth int, parent string")
    visited = spark.createDataFrame([("seen",)], "url string")
    got = frontier.to_visit(frontier.merge_frontier(links), visited).collect()
    assert [(r["url"], r["depth"], r["parent"]) for r in got] == [("x", 1, "c")]


def _web(spark):
    link = lambda *to: "".join(f'<a href="{u}">l</a>' for u in to) + "<p>text</p>"
    pages = [("https://s/1", link("https://s/2", "https://s/3")), ("https://s/2", link("https://s/3", "https://s/4")), ("https://s/3", link("https://s/1")), ("https://s/4", link("https://s/5")), ("https://s/5", "<p>end</p>")]
    return spark.createDataFrame(pages, "url string, html string")


def test_crawl(spark):
    seeds = spark.createDataFrame([("https://s/1",)], "url string")
    fetch, allow = web.from_table(_web(spark)), lambda u: F.lit(True)
    done = crawl.run(spark, seeds, fetch, allow, max_rounds=10)
    assert sorted(r["url"] for r in done.visited.collect()) == [f"https://s/{i}" for i in range(1, 6)]
    assert done.rounds == 4 and done.summary(doc_stats=True)["totalDocs"] == 5
    assert [p[4] for p in done.profiles] == [1, 2, 1, 1]
    assert done.profile_rows(spark).count() == 4
    assert crawl.run(spark, seeds, fetch, allow, max_depth=1).visited.count() == 3
    assert crawl.run(spark, seeds, fetch, allow, max_pages=2).rounds == 2
    assert crawl.run(spark, seeds, fetch, allow, should_abort=lambda: True).stopped_early


def test_fetch_rules(spark):
    answers = {"a": web.Response(301, "", "b"), "b": web.Response(200, "ok"), "big": web.Response(200, "x" * 50), "gone": web.Response(404, "no"), "loop": web.Response(302, "", "loop")}
    get = answers.get
    assert web.fetch_page(get, "a") == ("b", 200, "ok")
    assert web.fetch_page(get, "big", max_bytes=10) is None and web.fetch_page(get, "loop") is None and web.fetch_page(get, "none") is None
    assert web.fetch_page(get, "gone") == ("gone", 404, "")
    rows = web.fetcher(lambda: answers.get)(spark.createDataFrame([("a",), ("none",)], "url string"))
    assert sorted((r["url"], r["html"]) for r in rows.collect() if r["html"]) == [("a", "ok")]


def test_sitemaps(spark):
    bodies = {"r": "<sitemapindex><loc> m1 </loc><loc>m2</loc></sitemapindex>", "m1": "<urlset><loc>p1</loc><loc>p2</loc></urlset>", "m2": "<html>no", "p1": "x"}
    table = spark.createDataFrame(list(bodies.items()), "url string, html string")
    robots = spark.createDataFrame([("User-agent: *\r\n sitemap: r \nDisallow: /",)], "body string")
    got = sitemaps.seeds(robots, web.from_table(table), lambda u: u != "p2")
    assert [r["url"] for r in got.collect()] == ["p1"]


def test_seed_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# hubs\nhttps://a\n\n  https://b \n")
    urls = sitemaps.seeds_file(spark, str(tmp_path / "s.txt"))
    assert sorted(r["url"] for r in urls.collect()) == ["https://a", "https://b"]
    sitemaps.write_seeds(urls, str(tmp_path / "out"))
    assert sitemaps.seeds_file(spark, str(tmp_path / "out")).count() == 2


def test_store(spark, tmp_path):
    kv = store.Store(spark, str(tmp_path / "kv"))
    rows = lambda *r: spark.createDataFrame(list(r), store.SCHEMA)
    with pytest.raises(KeyError):
        kv.get("g", "a")
    kv.put("g", rows(("a", "1"), ("b", "2")))
    kv.put("g", rows(("a", "9")))
    assert kv.get("g", "a") == "9" and kv.keys("g").count() == 2
    kv.append("g", rows(("a", "10"), ("c", "7")))
    assert kv.get("g", "a") == '["9","10"]' and kv.get("g", "c") == '["7"]' and kv.get("g", "b") == "2"
    assert kv.delete("g", "b") == "2" and kv.keys("g").count() == 2


def test_tables(spark, canonical, tmp_path):
    assert tables.write(canonical, str(tmp_path / "v1")) == {"written": 4}
    changed = canonical.filter("source_url = 'u1'").withColumn("recipe_id", F.lit("new-id"))
    tables.write(changed, str(tmp_path / "v2"), old=str(tmp_path / "v1"))
    got = {n: spark.read.parquet(f"{tmp_path}/v2/{n}") for n in tables.TABLES}
    counts = {r["table_name"]: r["row_count"] for r in tables.row_counts(got).collect()}
    assert counts["recipes"] == 4 and counts["recipe_extraction_meta"] == 4
    assert got["recipe_steps"].filter("recipe_id = 'new-id'").count() == 2
    assert got["recipes"].filter("source_url = 'u1'").count() == 1
    assert tables.recent(got["recipes"], "updated_at", "recipe_id", 2).count() == 2
    with pytest.raises(ValueError):
        tables.check_tags(got["recipe_tags"].withColumn("tag_type", F.lit("odd")))


def test_enrich(spark, canonical):
    def client():
        return lambda prompt: {"appliance_tags": [" Grill ", "grill", ""], "dietary_tags": ["Keto"], "ingredient_normalizations": [{"raw": "Flour", "name": "Rye Flour", "quantity": 3}, {"raw": "x"}]}

    out, cache = enrich.enrich(canonical, client)
    got = {r["source_url"]: r for r in out.collect()}
    assert got["u3"]["appliance_tags"] == ["grill"] and "keto" in got["u3"]["dietary_tags"]
    assert got["u3"]["extraction_confidence"]["appliance_tags"] == 0.82
    assert got["u1"]["appliance_tags"] == ["oven"] and got["u1"]["extraction_meta"]["fallback_status"]["validated"]
    again, fresh = enrich.enrich(canonical, client, cache)
    assert fresh.count() == 0 and all(r["extraction_meta"]["fallback_status"]["cache_hit"] for r in again.collect() if r["extraction_meta"]["fallback_status"]["required"])
    plain, none = enrich.enrich(canonical)
    assert none.count() == 0 and {r["source_url"]: r["dietary_tags"] for r in plain.collect()} == {r["source_url"]: r["dietary_tags"] for r in canonical.collect()}
    assert enrich.validated("x") is None and enrich.validated({"other": 1}) is None


def test_stats(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 11)] + [("b", 5.0)], "k string, v double")
    got = {r["k"]: r for r in stats.latency(rows, "v", ["k"]).collect()}
    assert (got["a"]["p50"], got["a"]["p95"], got["a"]["p99"], got["a"]["mean"], got["b"]["p50"]) == (5.0, 10.0, 10.0, 5.5, 5.0)
    rounds = spark.createDataFrame([(0, 3), (1, 10)], "round int, visited int")
    assert [r["visited_delta"] for r in stats.deltas(rounds, "round", "visited").orderBy("round").collect()] == [3, 7]


def test_map_reduce(spark):
    rows = spark.createDataFrame([("d1", '"a b a"'), ("d2", '"b"')], "key string, value string")
    got = mapreduce.map_reduce(rows, lambda k, v: [{w: 1} for w in v.split()], lambda k, vs: sum(vs) if k != "x" else None)
    assert sorted((r["key"], r["value"]) for r in got.collect()) == [("a", "2"), ("b", "2")]
    assert mapreduce.run_job(rows, lambda k, v: [{k: 1}], lambda k, vs: None).count() == 0


def test_streams(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "stuff level stuff"), ("u2", "level")], "url string, text string")
    pages.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = grams.read_pages(spark, str(tmp_path / "in"), files_per_batch=1)
    grams.start_merge(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["gram"], r["url"]): r["freq"] for r in grams.read_index(spark, str(tmp_path / "ix")).collect()}
    assert got[("stuff", "u1")] == 2 and got[("level", "u2")] == 1 and got[("stuff level", "u1")] == 1
    grams.compact(spark, str(tmp_path / "ix"), str(tmp_path / "ix2"))
    assert grams.read_index(spark, str(tmp_path / "ix2")).count() == len(got)
    (tmp_path / "q").mkdir()
    (tmp_path / "q/1.txt").write_text("https://a\nhttps://a\nstop\n")
    handled = []
    queue.start_queue(queue.read_queue(spark, str(tmp_path / "q")), lambda b: handled.extend(r["url"] for r in b.collect()), str(tmp_path / "qc")).awaitTermination()
    assert handled == ["https://a"]


def test_tailed_queue_stops_and_loses_nothing(spark, tmp_path):
    from stockpot.streaming import urls as queue

    (tmp_path / "t").mkdir()
    (tmp_path / "t/1.txt").write_text("https://a\nstop\n")
    handled = []
    start = lambda: queue.start_queue(queue.read_queue(spark, str(tmp_path / "t")), lambda b: handled.extend(r["url"] for r in b.collect()), str(tmp_path / "tc"), every="200 milliseconds")
    assert queue.tail(start(), timeout=60)
    (tmp_path / "t/2.txt").write_text("https://b\nstop\n")
    assert queue.tail(start(), timeout=60) and handled == ["https://a", "https://b"]


def test_exports():
    import stockpot

    assert stockpot.normalise is recipes.normalise and stockpot.Index is index.Index
    assert all(getattr(stockpot, name) for name in stockpot.EXPORTS_NAMES)


def test_weighted_postings(canonical):
    got = {(r["term"], r["weight"]) for r in index.weighted_postings(canonical).collect()}
    assert {("pie", "A"), ("flour", "B"), ("oven", "C")} <= got
