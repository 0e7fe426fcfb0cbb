from pyspark.sql import functions as F

from stockpot.functions import html, ids, text, urls
from stockpot.functions.porter import stem, stem_column

HOME = """<!DOCTYPE html><html><head><title>Home</title><style>h1 { color: red; }</style></head><body>
<h1>Welcome to X1 simple links</h1><p>Check out <a href="level_2a/index.html">Some stuff</a>.</p>
<p>Check out <a href="level_2b/index.html">Some more
 stuff</a>.</p><a>no href</a><div class="f"><p>&copy; 2023 X1. All rights reserved.</p></div></body></html>"""


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_tokens_and_words(spark):
    assert one(spark, "A b2-cd, É x  Pie!", "string", text.tokens) == ["b2", "cd", "pie"]
    assert one(spark, "A b2-cd, x", "string", text.words) == ["a", "b2", "cd", "x"]
    assert one(spark, None, "string", text.tokens) == []
    assert one(spark, "Café 9lives", "string", text.letter_runs) == ["caf", "lives"]
    assert one(spark, "  ", "string", text.clean_nullable) is None


def test_positions_count_across_sections(spark):
    rows = spark.createDataFrame([(1, "ab cd", "x ef")], "doc_id int, a string, b string")
    got = text.positions([F.col("a"), F.col("b")], rows).orderBy("position").collect()
    assert [(r["position"], r["term"]) for r in got] == [(0, "ab"), (1, "cd"), (2, "ef")]


def test_porter_words():
    pairs = {
        "caresses": "caress", "flies": "fli", "dies": "di", "mules": "mule", "denied": "deni", "agreed": "agre", "owned": "own",
        "humbled": "humbl", "sized": "size", "meeting": "meet", "stating": "state", "relational": "relat", "hopefulness": "hope",
        "happy": "happi", "sky": "sky", "controlling": "control", "falling": "fall", "adoption": "adopt", "is": "is", "probate": "probat", "cease": "ceas",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_stem_column_keeps_rows(spark):
    rows = spark.createDataFrame([("links",), ("links",), ("stuff",), (None,)], "word string")
    assert sorted((r["word"] or "", r["stem"] or "") for r in stem_column(rows, "word").collect()) == [("", ""), ("links", "link"), ("links", "link"), ("stuff", "stuff")]


def test_html_to_text():
    assert html.html_to_text(HOME) == "WELCOME TO X1 SIMPLE LINKS\n\nCheck out Some stuff [level_2a/index.html].\n\nCheck out Some more stuff [level_2b/index.html].\n\nno href\n\n© 2023 X1. All rights reserved."
    assert html.html_to_text(None) == "" and html.html_to_text("<p>unclosed <b>x") == "unclosed x"


def test_links_and_json_ld():
    page = """<script type="application/ld+json">{"@graph":[{"@type":["ItemList"],"itemListElement":[{"url":"https://a/1"},{"item":"https://a/2"},{"item":{"@id":"https://a/3"}},"https://a/4"]}]}</script>
    <script type="application/ld+json">{broken</script><a href="b?x#y">t</a><a href="http://[bad">t</a>"""
    assert html.page_links(page, "https://s/dir") == (["https://a/1", "https://a/2", "https://a/3", "https://a/4"], ["https://s/dir/b"])
    assert urls.resolve("c", "https://s/a/index.html") == "https://s/a/c"


def test_crawl_record(spark):
    rows = [
        ("u1", '<title> A &amp; B </title><p>Prep time: 12 minutes</p><script type="application/ld+json">{"@graph":[{"@type":["Recipe"],"name":"Pie","timeRequired":"PT1H","recipeIngredient":"1 cup x","recipeCategory":["D"]}]}</script>'),
        ("u2", "<title>T</title>cook time 5 min"),
        ("u3", None),
    ]
    got = {r["url"]: r for r in html.crawl_docs(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert (got["u1"]["title"], got["u1"]["times"]["totalMinutes"], got["u1"]["ingredients"], got["u1"]["categories"]) == ("Pie", 60, ["1 cup x"], ["D"])
    assert (got["u2"]["title"], got["u2"]["times"]["totalMinutes"]) == ("T", 5)
    assert got["u3"]["times"] is None


def test_rich(spark):
    rows = spark.createDataFrame([(1, ["a"], None), (2, None, (None, 5, None)), (3, [], None), (4, None, None)], "i int, ingredients array<string>, times struct<totalMinutes:int,prepMinutes:int,cookMinutes:int>")
    assert [r[0] for r in rows.orderBy("i").select(html.is_rich(F.col("ingredients"), F.col("times"))).collect()] == [True, True, False, False]


def test_durations(spark):
    want = {"PT25M": 25, "PT1H30M": 90, "PT90S": 2, "PT": 0, "P1DT2H": None, "pt5m": 5}
    rows = spark.createDataFrame([(k,) for k in want], "d string").select("d", html.duration_minutes(F.col("d")).alias("m")).collect()
    assert {r["d"]: r["m"] for r in rows} == want


def test_url_policies(spark):
    want = {
        "https://www.allrecipes.com/pie-recipe-7556": True, "https://www.allrecipes.com/recipe/1/x/": True, "https://www.allrecipes.com/gallery/bad": False,
        "https://www.seriouseats.com/recipes/x": True, "https://www.seriouseats.com/about": False, "https://www.seriouseats.com/page-12": False,
        "https://www.budgetbytes.com/creamy-pasta/": True, "https://www.budgetbytes.com/category/chicken/": False, "https://www.budgetbytes.com/meal-plans/": False,
        "https://www.food.com/recipe/a-1": True, "https://www.food.com/x/recipe/1": False, "not a url": False, "https://other.org/recipe/1": False,
    }
    rows = spark.createDataFrame([(u,) for u in want], "url string").select("url", urls.policy("multisite")(F.col("url")).alias("ok")).collect()
    assert {r["url"]: r["ok"] for r in rows} == want


def test_ids(spark):
    assert one(spark, 'a"b', "string", ids.content_id) == ids.get_id('a"b')
    nodes = [ids.node_id("127.0.0.1", p) for p in (1, 2, 3)]
    key = ids.get_id("k")
    assert ids.modulo_node(key, nodes) == sorted(nodes)[int(key, 16) % 3]
    assert ids.ring_node(key, nodes) == min((n for n in nodes if int(n, 16) >= int(key, 16)), key=lambda n: int(n, 16), default=min(nodes, key=lambda n: int(n, 16)))
    assert ids.rendezvous_node(key, nodes) in nodes and len(ids.short_id("127.0.0.1", 1)) == 5
