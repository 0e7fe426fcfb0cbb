"""Registered queries of whole chains: pages and records made from table rows go through the engine's own functions."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html, ids, recipes, text, urls
from .lineage import folder_for, staged
from .operators import enrich, frontier, index, ngrams, ranking, spell, stats
from .plans import corpus, crawl, hybrid, pages
from .queries import _AMOUNT_SQL, _ATTRS, _BUCKET, _DOC_GRAMS, _LINES, _POSTS, _ask, _bm25_sql, _contains, _edits_sql, _doc_grams, _pairs, _read, _records, query, stored_index
from .shipping import ship
from .sources import sitemaps, store, tables, web

_SITE = "https://www.food.com/recipe/"


def _number(column: str = "page_id") -> Column:
    return F.col(column).cast("string")


def _join(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# pages


def _recipe_pages(spark: SparkSession, d: str) -> DataFrame:
    """pages(url, html) of four kinds: a whole JSON-LD recipe, one with times only, times in the text, nothing."""
    n = _number()
    minutes = (F.col("page_id") % 90).cast("string")
    whole = _join('{"@context":"x","@graph":[{"@type":"WebSite","name":"no"},{"@type":["Thing","Recipe"],"name":"Soup ', n, '","totalTime":"PT', minutes, 'M","prepTime":"PT1H5M","recipeIngredient":["1 cup a', n, '","salt"],"recipeCategory":"Dinner"}]}')
    times = F.lit('[{"@type":"Recipe","cookTime":"pt1h30m"}]')
    script = lambda body: _join("<script type='application/ld+json'>", body, "</script>")
    kind = F.col("page_id") % 4
    head = F.when(kind == 0, script(whole)).when(kind == 1, _join("<script type='application/ld+json'>{broken</script>", script(times))).otherwise("")
    body = F.when(kind == 2, _join("<p>Total time: ", minutes, " minutes</p>")).otherwise("<p>nothing</p>")
    page = _join("<html><head><TITLE lang=x> Page ", n, " &amp; co\n</TITLE>", head, "</head><body>", body, "</body></html>")
    return _read(spark, d, "pages").select(_join(_SITE, n).alias("url"), page.alias("html"))


@query(f"""SELECT '{_SITE}' || page_id AS url, CASE WHEN page_id % 4 = 0 THEN 'Soup ' || page_id ELSE 'Page ' || page_id || ' &amp; co' END AS title,
  CASE WHEN page_id % 4 IN (0, 2) THEN (page_id % 90)::INTEGER END AS total, CASE WHEN page_id % 4 = 0 THEN 65 END AS prep, CASE WHEN page_id % 4 = 1 THEN 90 END AS cook,
  CASE WHEN page_id % 4 = 0 THEN '1 cup a' || page_id || ';salt' ELSE '' END AS ingredients, CASE WHEN page_id % 4 = 0 THEN 'Dinner' ELSE '' END AS categories, page_id % 4 <> 3 AS rich FROM pages""")
def recipe_pages(spark: SparkSession, d: str) -> DataFrame:
    listed = lambda c: F.coalesce(F.array_join(c, ";"), F.lit(""))
    rows = html.crawl_docs(_recipe_pages(spark, d))
    return rows.select("url", "title", F.col("times.totalMinutes").alias("total"), F.col("times.prepMinutes").alias("prep"), F.col("times.cookMinutes").alias("cook"), listed("ingredients").alias("ingredients"), listed("categories").alias("categories"), html.is_rich(F.col("ingredients"), F.col("times")).alias("rich"))


@query("SELECT count(*) AS total_docs, count(*) FILTER (page_id % 4 <> 3) AS rich_docs FROM pages")
def rich_counts(spark: SparkSession, d: str) -> DataFrame:
    return crawl.rich_stats(html.crawl_docs(_recipe_pages(spark, d)))


@query(f"SELECT '{_SITE}' || page_id AS source_url, CASE WHEN page_id % 4 = 0 THEN 'soup-' || page_id ELSE 'page-' || page_id || '-amp-co' END AS slug, CASE WHEN page_id % 4 = 0 THEN 2 ELSE 0 END AS n_ingredients, {_BUCKET.format(m='CASE WHEN page_id % 4 IN (0, 2) THEN page_id % 90 END')} AS bucket FROM pages")
def page_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages to canonical recipes in one call."""
    rows = pages.canonical(_recipe_pages(spark, d))
    return rows.select("source_url", F.regexp_replace("recipe_id", "-[0-9a-f]{12}$", "").alias("slug"), F.size("normalized_ingredients").alias("n_ingredients"), recipes.time_bucket(F.col("times.total_minutes")).alias("bucket"))


@query("SELECT page_id, 'TITLE ' || page_id || chr(10) || chr(10) || 'one ' || page_id || ' two three' || chr(10) || chr(10) || '* first' || chr(10) || '* second' || chr(10) || chr(10) || 'link [/x' || page_id || '] end & more' AS text FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    n = _number()
    body = _join("<html><head><title>x</title><style>p{}</style></head><body><h1>Title ", n, "</h1><p>one ", n, " <b>two</b>\n  three</p><ul><li>first</li><li>second</li></ul><p><a href='/x", n, "'>link</a> end &amp; more</p><script>var a;</script></body></html>")
    return html.parse_pages(_read(spark, d, "pages").select("page_id", F.lit("u").alias("url"), body.alias("html"))).select("page_id", "page.text")


@query("SELECT page_id, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower('Simple ' || page_id || ' Links: the stuff'), '[^a-z]+', ' ', 'g'), ' '), lambda w: w NOT IN ('the', '', 'links', 'simple', 'stuff')))) = [] AS clean, 3::BIGINT AS n_grams FROM pages")
def page_grams(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages to the n-gram index in one call; counts the single words of each page."""
    body = _join("<p>Simple ", _number(), " Links: the stuff</p>")
    rows = pages.gram_index(_read(spark, d, "pages").select(_number().alias("url"), body.alias("html")))
    return rows.filter("NOT contains(gram, ' ')").groupBy(F.col("url").cast("long").alias("page_id")).agg(F.lit(True).alias("clean"), F.count("*").alias("n_grams"))


_LINK_PAGE = "https://www.food.com/p"


def _link_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with an item list of three entries (one refused), a link twice and 250 more links."""
    n = _number()
    item_list = _join('{"@type":["X","ItemList"],"itemListElement":[{"url":"', _SITE, "a", n, '"},{"item":{"@id":"', _SITE, "b", n, '"}},"https://www.food.com/about/x"]}')
    anchors = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(249)), lambda i: _join("<a href='../recipe/n", i.cast("string"), "'>x</a>")), "")
    body = _join("<script type='application/ld+json'>", item_list, "</script><a>none</a><a href='/recipe/c", n, "?q=1'>c</a><a href='/recipe/c", n, "#t'>c</a><a href='http://['>bad</a>", anchors)
    return _read(spark, d, "pages").select(_join(_LINK_PAGE, n, "/index.html").alias("url"), body.alias("html"), F.lit(2).alias("depth"))


@query(f"SELECT '{_SITE}' || unnest(list_concat(['a' || page_id, 'b' || page_id, 'c' || page_id], list_transform(range(0, {frontier.MAX_OUTLINKS - 3}), lambda i: 'n' || i))) AS url, 3 AS depth, '{_LINK_PAGE}' || page_id || '/index.html' AS parent FROM pages")
def frontier_links(spark: SparkSession, d: str) -> DataFrame:
    return frontier.expand(html.parse_pages(_link_pages(spark, d)), urls.policy("multisite"))


@query(f"""SELECT url, 3 AS depth, min(parent) AS parent FROM (SELECT '{_SITE}' || unnest(list_concat(['a' || page_id, 'b' || page_id, 'c' || page_id], list_transform(range(0, {frontier.MAX_OUTLINKS - 3}), lambda i: 'n' || i))) AS url, '{_LINK_PAGE}' || page_id || '/index.html' AS parent FROM pages) GROUP BY url""")
def frontier_round(spark: SparkSession, d: str) -> DataFrame:
    return frontier.merge_frontier(frontier_links(spark, d))


@query(f"SELECT '{_SITE}c' || page_id AS url FROM pages UNION ALL SELECT 'https://www.food.com/recipe/n' || i FROM (SELECT unnest(range(10, 250)) AS i)")
def crawl_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that the n-gram crawl follows, ten of them being visited."""
    seen = spark.createDataFrame([(f"{_SITE}n{i}",) for i in range(10)], "url string")
    return pages.crawl_links(_link_pages(spark, d), seen)


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """The pages as a tree: each links to ten others and back to its parent."""
    children = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: _join("<a href='/recipe/", (F.col("page_id") * 10 + k).cast("string"), "'>x</a>")), "")
    parent = _join("<a href='/recipe/", F.floor(F.greatest(F.col("page_id") - 1, F.lit(0)) / 10).cast("string"), "'>up</a>")
    return _read(spark, d, "pages").select(_join(_SITE, _number()).alias("url"), _join(parent, children).alias("html"))


_REACHED = "WITH RECURSIVE r AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT p.page_id, depth + 1 FROM r JOIN pages p ON p.page_id BETWEEN 10 * r.id + 1 AND 10 * r.id + 10 WHERE depth < 6)"


def _crawled(spark: SparkSession, d: str) -> crawl.Crawl:
    return crawl.run(spark, spark.createDataFrame([(f"{_SITE}0",)], "url string"), web.from_table(_tree(spark, d)))


@query(f"{_REACHED} SELECT '{_SITE}' || id AS url FROM r")
def bfs_crawl(spark: SparkSession, d: str) -> DataFrame:
    """A crawl from one seed along links, with the default limits, until no page is left."""
    return _crawled(spark, d).visited


@query(f"""{_REACHED}, c AS (SELECT depth, count(*) AS n FROM r GROUP BY depth), f AS (SELECT 0 AS round, 1::BIGINT AS frontier_in UNION ALL SELECT depth + 1, 10 * n FROM c WHERE depth < 6)
  SELECT round, frontier_in, (SELECT sum(n) FROM c WHERE depth <= round)::BIGINT AS visited_after, coalesce((SELECT n FROM c WHERE depth = round), 0)::BIGINT AS visited_delta, coalesce((SELECT g.frontier_in FROM f g WHERE g.round = f.round + 1), 0)::BIGINT AS frontier_adds FROM f""")
def crawl_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _crawled(spark, d).profile_rows(spark).select("round", "frontier_in", "visited_after", "visited_delta", "frontier_adds")


@query("""SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'https://h/to' || page_id WHEN page_id % 4 = 3 AND page_id % 8 = 7 THEN NULL ELSE 'https://h/' || page_id END AS final_url,
  CASE WHEN page_id % 4 = 2 THEN 404 WHEN page_id % 8 = 7 THEN NULL ELSE 200 END AS status, CASE WHEN page_id % 4 = 2 THEN '' WHEN page_id % 8 = 7 THEN NULL ELSE 'ok' END AS html FROM pages""")
def fetched_pages(spark: SparkSession, d: str) -> DataFrame:
    """The fetch step over a stand-in for the network: plain answers, redirects, missing pages, and hosts that
    fail twice (tried again) or always."""

    def make():
        tries: dict[str, int] = {}

        def get(url: str):
            name = url.rsplit("/", 1)[1]
            tries[url] = tries.get(url, 0) + 1
            n = int(name) if name.isdigit() else 0
            if n % 8 == 7 or (n % 8 == 3 and tries[url] < 3):
                return None
            if n % 4 == 1:
                return web.Response(302, "", f"/to{n}")
            return web.Response(404, "gone") if n % 4 == 2 else web.Response(200, "ok")

        return web.retrying(get, tries=3, wait=0.0)

    rows = _read(spark, d, "pages").select("page_id", _join("https://h/", _number()).alias("url"))
    return web.fetcher(make)(rows).select("page_id", "final_url", "status", "html")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]+/') THEN regexp_replace(url, '[?#].*$', '') ELSE regexp_replace(url, '[?#].*$', '') || '/' END AS stripped, 'https://h/a/x' AS relative, 'https://h/x' AS rooted FROM pages")
def url_resolve(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)

    def run(batch: pa.Array) -> pa.Array:
        return pa.array([{"a": urls.resolve(u, u), "b": urls.resolve("x?q#f", "https://h/a"), "c": urls.resolve("/x#f", "https://h/a/index.html")} for u in batch.to_pylist()], pa.struct([(k, pa.string()) for k in "abc"]))

    got = _read(spark, d, "pages").select("page_id", F.arrow_udf(run, "a string, b string, c string")("url").alias("r"))
    return got.select("page_id", F.col("r.a").alias("stripped"), F.col("r.b").alias("relative"), F.col("r.c").alias("rooted"))


# records


_LINE_SQL = f"{_AMOUNT_SQL} || 'x' || l || ' flour, (fresh)'"
_BODY = "CASE WHEN doc_id % 6 IN (0, 1, 4) THEN array_to_string(regexp_split_to_array(lower('x' || l || ' flour, (fresh)'), '\\s+'), ' ') ELSE 'x' || l || ' flour, (fresh)' END"
_NAME = f"trim(regexp_replace(regexp_replace(regexp_replace({_BODY}, '\\([^)]*\\)', ' ', 'g'), '[,;]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""SELECT doc_id, p AS position, {_LINE_SQL} AS raw, {_NAME} AS name, [2.0, 0.5, 3.0, NULL, 1.5, NULL][doc_id % 6 + 1]::DOUBLE AS quantity,
  ['cups', 'cup', NULL, NULL, 'tbsp', NULL][doc_id % 6 + 1] AS unit, [0.95, 0.95, 0.85, 0.75, 0.95, 0.75][doc_id % 6 + 1]::DOUBLE AS confidence
  FROM (SELECT doc_id, unnest(v) AS l, generate_subscripts(v, 1) - 1 AS p FROM (SELECT doc_id, {_LINES} AS v FROM documents))""")
def ingredient_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).select("doc_id", F.posexplode(recipes.ingredients(F.col("ingredients"))).alias("position", "i"))
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), "i.raw", "i.name", "i.quantity", "i.unit", F.round("i.confidence", 6).alias("confidence"))


def _canonical_sql() -> str:
    """CTE canonical: what the normaliser makes of _records."""
    title = f"coalesce(nullif(regexp_replace(coalesce(({_LINES})[1], ''), '^\\s+|\\s+$', '', 'g'), ''), '{recipes.UNTITLED}')"
    slug = "coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'recipe')"
    times = """CASE WHEN doc_id % 3 = 0 THEN '{"totalMinutes":' || (doc_id % 90) || ',"cookMinutes":5}' ELSE '{}' END"""
    appliances = ", ".join(f"CASE WHEN {_contains('hay', k)} THEN '{t}' END" for t, k in recipes.APPLIANCES.items())
    phrases, single = "|".join(k for k in recipes.GLUTEN if " " in k), "|".join(k for k in recipes.GLUTEN if " " not in k)
    return f"""base AS (SELECT doc_id, lang, 'doc:' || doc_id AS url, coalesce(text, '') AS text, {title} AS title, {_LINES} AS v FROM documents),
    named AS (SELECT doc_id, string_agg({_NAME}, ' ' ORDER BY p) AS names FROM (SELECT doc_id, unnest(v) AS l, generate_subscripts(v, 1) AS p FROM base) GROUP BY doc_id),
    more AS (SELECT base.*, v[1:{recipes.MAX_STEPS}] AS steps, list_transform(v, lambda l: {_LINE_SQL}) AS raws, trim(lower(title) || ' ' || coalesce(lower(lang), '') || ' ' || lower(coalesce(names, ''))) AS t,
      lower(text || ' ' || array_to_string(v[1:{recipes.MAX_STEPS}], ' ') || ' ' || coalesce(lang, '')) AS hay FROM base LEFT JOIN named USING (doc_id)),
    tagged AS (SELECT *, sha256(concat_ws(chr(10), url, title, array_to_string(raws, '|'), array_to_string(steps, '|'), {times})) AS hash, list_filter([{appliances}], lambda x: x IS NOT NULL) AS appliances,
      {_contains('t', recipes.MEAT)} AS meat, {_contains('t', recipes.DAIRY)} AS dairy, regexp_matches(t, '\\begg(s)?\\b') AS egg, contains(t, 'vegetarian') AS veg, contains(t, 'vegan') AS vegan,
      regexp_matches(t, 'dairy[-\\s]?free') AS dfree, {_contains('t', recipes.GLUTEN_FREE)} AS gfree, regexp_matches(t, '{phrases}|\\b(?:{single})\\b') AS gluten FROM more),
    diets AS (SELECT *, list_filter([CASE WHEN veg OR NOT meat THEN 'vegetarian' END, CASE WHEN vegan OR (NOT meat AND NOT dairy AND NOT egg) THEN 'vegan' END, CASE WHEN dfree OR NOT dairy THEN 'dairy-free' END,
      CASE WHEN gfree THEN 'gluten-free' WHEN gluten THEN 'contains-gluten' END], lambda x: x IS NOT NULL) AS diet FROM tagged),
    sure AS (SELECT *, CASE WHEN len(diet) = 0 THEN 0.0 WHEN veg OR vegan OR dfree OR gfree THEN 0.72 ELSE 0.45 END::DOUBLE AS s FROM diets),
    canonical AS (SELECT *, {slug} || '-' || substr(hash, 1, 12) AS recipe_id, CASE WHEN len(v) > 0 THEN s ELSE least(s, 0.35) END::DOUBLE AS diet_confidence, len(appliances) > 0 AS known FROM sure)"""


_CANONICAL = _canonical_sql()


@query(f"""WITH {_CANONICAL} SELECT recipe_id, url AS source_url, title, array_to_string(diet, ',') AS diet, array_to_string(appliances, ',') AS appliances, len(v) AS n_ingredients, round(diet_confidence, 4) AS diet_confidence,
  array_to_string(list_filter([CASE WHEN len(v) = 0 THEN 'low_ingredient_confidence' END, CASE WHEN NOT known THEN 'missing_appliance_tags' END, CASE WHEN diet_confidence < 0.5 THEN 'missing_dietary_tags' END, CASE WHEN doc_id % 3 <> 0 THEN 'missing_time_fields' END], lambda x: x IS NOT NULL), ',') AS flags,
  array_to_string(list_filter([CASE WHEN NOT known THEN 'appliance_tags' END, CASE WHEN len(diet) = 0 THEN 'dietary_tags' END, CASE WHEN len(v) = 0 THEN 'ingredients' END, CASE WHEN doc_id % 3 <> 0 THEN 'times' END], lambda x: x IS NOT NULL), ',') AS missing FROM canonical""")
def canonical_recipes(spark: SparkSession, d: str) -> DataFrame:
    rows = recipes.normalise(_records(spark, d))
    listed = lambda c: F.array_join(c, ",")
    return rows.select("recipe_id", "source_url", "title", listed("dietary_tags").alias("diet"), listed("appliance_tags").alias("appliances"), F.size("normalized_ingredients").cast("long").alias("n_ingredients"), F.round(F.col("extraction_confidence")["dietary_tags"], 4).alias("diet_confidence"), listed("quality_flags").alias("flags"), listed(F.sort_array(F.map_keys("extraction_meta.missing_field_reasons"))).alias("missing"))


_TAGS_SQL = f"""WITH {_CANONICAL} SELECT recipe_id, tag_type, lower(tag) AS tag, round(max(c)::DOUBLE, 4) AS confidence FROM (SELECT recipe_id, 'appliance' AS tag_type, unnest(appliances) AS tag, 0.8 AS c FROM canonical
  UNION ALL SELECT recipe_id, 'dietary', unnest(diet), diet_confidence FROM canonical UNION ALL SELECT recipe_id, 'category', lang, 1.0 FROM canonical WHERE trim(lang) <> '') GROUP BY ALL"""


@query(_TAGS_SQL)
def recipe_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.tags_table(staged(recipes.normalise(_records(spark, d))))
    return rows.select("recipe_id", "tag_type", "tag", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


@query(f"""WITH lines AS (SELECT {_LINES} AS v FROM documents) SELECT 'recipes' AS table_name, count(*) AS row_count FROM documents UNION ALL SELECT 'recipe_extraction_meta', count(*) FROM documents
  UNION ALL SELECT 'recipe_ingredients', sum(len(v))::BIGINT FROM lines UNION ALL SELECT 'recipe_steps', sum(least(len(v), {recipes.MAX_STEPS}))::BIGINT FROM lines UNION ALL SELECT 'recipe_tags', count(*) FROM ({_TAGS_SQL})""")
def replaced_tables(spark: SparkSession, d: str) -> DataFrame:
    """The five tables written to files, and written again under other ids: rows are replaced, children go along."""
    rows = recipes.normalise(_records(spark, d))
    base = folder_for(spark)
    tables.write(rows, f"{base}/one")
    tables.write(rows.withColumn("recipe_id", F.concat(F.lit("new-"), F.col("recipe_id"))), f"{base}/two", f"{base}/one")
    found = {n: spark.read.parquet(f"{base}/two/{n}").filter("startswith(recipe_id, 'new-')") for n in tables.TABLES}
    return tables.row_counts(found)


@query("SELECT 'recipes' AS table_name, least(25, count(*))::BIGINT AS row_count FROM documents UNION ALL SELECT 'recipe_extraction_meta', least(25, count(*))::BIGINT FROM documents")
def sampled_tables(spark: SparkSession, d: str) -> DataFrame:
    """The store-to-relational job over the first 25 records."""
    base = folder_for(spark)
    tables.sample_to_tables(spark, _records(spark, d), base)
    return tables.row_counts({n: spark.read.parquet(f"{base}/{n}") for n in ("recipes", "recipe_extraction_meta")})


@query("SELECT 'doc:' || doc_id AS source_url FROM documents WHERE doc_id % 5 <> 0")
def valid_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).withColumn("url", F.when(F.col("doc_id") % 5 != 0, F.col("url")))
    return recipes.normalise(rows).select("source_url")


@query("SELECT doc_id, nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '   ' ELSE '  ' || lang || ' ' END), '') AS value FROM documents")
def nullable_text(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("doc_id") % 3 == 0, "   ").otherwise(_join("  ", F.col("lang"), " "))
    return _read(spark, d, "documents").select("doc_id", text.clean_nullable(value).alias("value"))


@query(f"""WITH r AS (SELECT doc_id, doc_id % 2 = 0 AS weak FROM documents)
  SELECT doc_id, CASE WHEN weak THEN 'oven,grill' ELSE 'oven' END AS appliances, CASE WHEN weak THEN 'rye mix,ab' ELSE 'long name of flour' END AS names, CASE WHEN weak THEN 'rye,mix' ELSE 'long,name,flour' END AS tokens,
  CASE WHEN weak THEN 2.5 END::DOUBLE AS quantity, weak AS executed FROM r""")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    """Weak records get appliances and ingredient patches from a stand-in model; the last patch of a line counts."""
    weak = F.col("doc_id") % 2 == 0
    one = lambda *lines: F.array(*[F.lit(x) for x in lines])
    docs = _read(spark, d, "documents").select("doc_id", _join("doc:", _number("doc_id")).alias("url"), F.when(weak, "plain").otherwise("vegan bake in the oven").alias("text"), F.when(weak, "t").otherwise("vegan bread").alias("title"), F.lit(None).cast("struct<totalMinutes:int,prepMinutes:int,cookMinutes:int>").alias("times"), F.when(weak, one("xy", "ab")).otherwise(one("2 cups long name of flour")).alias("ingredients"), F.array().cast("array<string>").alias("categories"))

    def client():
        patches = [{"raw": "XY ", "name": "wheat", "quantity": 1}, {"raw": "xy", "name": " Rye Mix", "quantity": 2.5, "unit": "Cup"}, {"raw": "", "name": "dropped"}]
        return lambda prompt: json.dumps({"appliance_tags": [" Oven", "GRILL", "oven", None], "ingredient_normalizations": patches})

    rows, _ = enrich.enrich(recipes.normalise(docs), client)
    number = F.regexp_extract("source_url", "[0-9]+", 0).cast("long")
    names = F.transform("normalized_ingredients", lambda i: i["name"])
    executed = F.array_contains(enrich.needed_fields(recipes.normalise(docs)), "appliance_tags")
    asked = recipes.normalise(docs).select("source_url", executed.alias("executed"))
    return rows.join(asked, "source_url").select(number.alias("doc_id"), F.array_join("appliance_tags", ",").alias("appliances"), F.array_join(names, ",").alias("names"), F.array_join("ingredient_tokens", ",").alias("tokens"), F.when(F.col("executed"), F.col("normalized_ingredients")[0]["quantity"]).alias("quantity"), "executed")


# queries and spelling


_FORMS = ("Vegetarian under {} minutes", "Chicken Air Fryer recipe", "category:dessert-{} cake", "vegan  RECIPE", "under {}", "gluten-free oven pizza x", "slow cooker under {} mins beef", "")
_PARSED = (("", "dietary=vegetarian,timebucket=@"), ("chicken", "appliance=air fryer"), ("cake", "category=dessert-#"), ("", "dietary=vegan"), ("", "timebucket=@"), ("pizza", "dietary=gluten-free,appliance=oven"), ("beef", "appliance=slow cooker,timebucket=@"), ("", ""))


def _parsed_sql(i: int) -> str:
    listed = ", ".join(f"'{p[i]}'" for p in _PARSED)
    return f"replace(replace([{listed}][doc_id % 8 + 1], '@', {_BUCKET.format(m='(doc_id % 77)')}), '#', CAST(doc_id % 77 AS VARCHAR))"


@query(f"SELECT doc_id, {_parsed_sql(0)} AS terms, {_parsed_sql(1)} AS facets FROM documents")
def parsed_queries(spark: SparkSession, d: str) -> DataFrame:
    """The parser over query strings of eight forms."""
    ship(spark)
    form = F.element_at(F.array(*[F.lit(f) for f in _FORMS]), (F.col("doc_id") % 8 + 1).cast("int"))
    asked = F.replace(form, F.lit("{}"), (F.col("doc_id") % 77).cast("string"))

    def run(batch: pa.Array) -> pa.Array:
        found = [hybrid.parse(q) for q in batch.to_pylist()]
        return pa.array([{"terms": " ".join(p.terms), "facets": ",".join(f"{k}={v}" for k, v in p.facets())} for p in found], pa.struct([("terms", pa.string()), ("facets", pa.string())]))

    rows = _read(spark, d, "documents").select("doc_id", F.arrow_udf(run, "terms string, facets string")(asked).alias("p"))
    return rows.select("doc_id", "p.terms", "p.facets")


_ASKED = ("zzqx", "tyhe", "the", "withh", "anf")


def _corrected_sql(words: tuple[str, ...]) -> str:
    """The words with those outside the vocabulary replaced by their best single edit."""
    after = f"SELECT CASE WHEN w.word IN (SELECT term FROM ({_POSTS})) THEN w.word ELSE coalesce(b.suggestion, w.word) END AS word, i FROM (VALUES {', '.join(f'({i}, {w!r})' for i, w in enumerate(words))}) w(i, word) LEFT JOIN ({_edits_sql(words)}) b ON b.token = w.word"
    return f"SELECT string_agg(word, ' ' ORDER BY i) FROM ({after})"


@query(f"SELECT '{' '.join(_ASKED)}' AS query, ({_corrected_sql(_ASKED)}) AS suggested_query")
def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    found = stored_index(spark, d)
    asked = " ".join(_ASKED)
    better = hybrid.did_you_mean(spark, found, asked, hybrid.parse(asked)) or {"suggested_query": asked}
    return spark.createDataFrame([(asked, better["suggested_query"])], "query string, suggested_query string")


@query(f"SELECT ({_corrected_sql(_ASKED)}) AS after")
def suggested_tokens(spark: SparkSession, d: str) -> DataFrame:
    scores = index.document_frequency(index.counted_postings(_read(spark, d, "documents"), F.col("text"))).select("term", F.col("df").alias("score"))
    after = spell.suggest(spark, list(_ASKED), scores) or list(_ASKED)
    return spark.createDataFrame([(" ".join(after),)], "after string")


@query("SELECT doc_id, regexp_replace(lower(source || '-' || lang), '[^a-z0-9]', '', 'g') AS token FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def tag_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    return rows.select("doc_id", spell.tag_tokens(F.concat_ws("-", "source", "lang")).alias("token"))


@query(f"SELECT h.doc_id, 'doc:' || h.doc_id AS source_url, coalesce(({_LINES})[1], '') AS title FROM ({_bm25_sql(chr(83) + 'ELECT 0 AS query_id, unnest([' + chr(39) + 'the' + chr(39) + ', ' + chr(39) + 'and' + chr(39) + ']) AS term', 'SELECT 0 AS query_id, ' + chr(39) * 2 + ' AS attr_type, ' + chr(39) * 2 + ' AS attr_key WHERE false', 20)}) h JOIN documents USING (doc_id)")
def hits_with_meta(spark: SparkSession, d: str) -> DataFrame:
    """Ranked hits joined with their metadata after the cut."""
    return ranking.with_meta(_ask(spark, d, ["the and"]), stored_index(spark, d)).select("doc_id", "source_url", "title")


@query(f"SELECT f.doc_id FROM (SELECT DISTINCT doc_id FROM ({_ATTRS}) WHERE attr_type = 'dietary' AND attr_key = 'en') f JOIN (SELECT DISTINCT doc_id FROM ({_ATTRS}) WHERE attr_type = 'timebucket' AND attr_key = 'le15') USING (doc_id)")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(0, "dietary", "en"), (0, "timebucket", "le15"), (0, "dietary", "en")], "query_id int, attr_type string, attr_key string")
    return ranking.facet_candidates(corpus.attrs(corpus.docmeta(_read(spark, d, "documents"))), wanted, ["query_id"]).select("doc_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return index.first_per_key(_read(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


# the store, files and placement


def _users(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max("event_id").cast("string").alias("value"))


@query("SELECT DISTINCT key FROM (SELECT CAST(user_id AS VARCHAR) AS key FROM events UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def kv_keys(spark: SparkSession, d: str) -> DataFrame:
    """Two puts into a group, then its keys."""
    kept = store.Store(spark, folder_for(spark))
    kept.put("g", _users(spark, d))
    kept.put("g", _pairs(spark, d)[0])
    return kept.keys("g")


@query("SELECT CAST(user_id AS VARCHAR) AS key FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM labels")
def kv_all_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of two groups one after the other, with repeats."""
    kept = store.Store(spark, folder_for(spark))
    kept.put("a", _users(spark, d))
    kept.put("b", _pairs(spark, d)[0])
    return kept.all_keys(["a", "b"])


@query("""WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS key, 'q' || quality AS value, toxic FROM labels), f AS (SELECT min(key) AS key FROM o)
  SELECT key, CASE WHEN toxic = 1 THEN '["' || value || '","toxic"]' ELSE value END AS value FROM o WHERE key <> (SELECT key FROM f) UNION ALL SELECT 'got ' || key, CASE WHEN toxic = 1 THEN '["' || value || '","toxic"]' ELSE value END FROM o WHERE key = (SELECT key FROM f)""")
def kv_group(spark: SparkSession, d: str) -> DataFrame:
    """Put, append, get and delete on one group of the store."""
    kept, (old, new) = store.Store(spark, folder_for(spark)), _pairs(spark, d)
    kept.put("g", old)
    kept.append("g", new)
    first = kept.keys("g").agg(F.min("key")).first()[0]
    seen = kept.get("g", first)
    assert kept.delete("g", first) == seen
    return kept.table("g").unionByName(spark.createDataFrame([(f"got {first}", seen)], "key string, value string"))


@query("SELECT key, value FROM (SELECT CAST(user_id AS VARCHAR) AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY user_id)")
def kv_memory(spark: SparkSession, d: str) -> DataFrame:
    """A group held in executor memory."""
    kept = store.Memory(spark)
    kept.put("g", _users(spark, d))
    return kept.table("g")


@query(f"SELECT gram, CAST(sum(freq) AS BIGINT) AS freq_sum, row_number() OVER (ORDER BY gram) AS line FROM ({_DOC_GRAMS}) GROUP BY gram")
def index_file(spark: SparkSession, d: str) -> DataFrame:
    """The global index written as sorted text lines and read back; `line` is the place in the files."""
    path = f"{folder_for(spark)}/index"
    ngrams.write_lines(ngrams.to_lines(ngrams.posting_lists(_doc_grams(spark, d))), path)
    lines = ngrams.from_lines(ngrams.read_lines(spark, path))
    return lines.groupBy("gram").agg(F.sum("freq_sum").alias("freq_sum"), F.min("line").alias("line"))


@query("SELECT row_number() OVER (ORDER BY source) AS round, n AS visited FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)")
def round_files(spark: SparkSession, d: str) -> DataFrame:
    """Rounds as CSV and metrics as JSON, read back and joined."""
    base = folder_for(spark)
    counts = stats.count_by(_read(spark, d, "documents").filter("source IS NOT NULL"), "source").orderBy("source").collect()
    rounds = spark.createDataFrame([(i + 1, r["n"]) for i, r in enumerate(counts)], "round long, visited long")
    stats.write_rounds(rounds, f"{base}/rounds")
    stats.write_metrics(rounds, f"{base}/metrics")
    csv = spark.read.option("header", True).schema(rounds.schema).csv(f"{base}/rounds")
    return csv.join(spark.read.schema(rounds.schema).json(f"{base}/metrics"), ["round", "visited"])


@query("SELECT DISTINCT 'https://h/' || (page_id % 50) AS url FROM pages WHERE page_id % 50 <> 7")
def seed_files(spark: SparkSession, d: str) -> DataFrame:
    """Seeds written to a file, with a comment in place of one, and read back."""
    path = f"{folder_for(spark)}/seeds"
    rows = _read(spark, d, "pages").select((F.col("page_id") % 50).alias("n")).distinct()
    sitemaps.write_seeds(rows.select(F.when(F.col("n") == 7, "# https://h/7").otherwise(_join(" https://h/", F.col("n").cast("string"))).alias("url")), path)
    return sitemaps.seeds_file(spark, path)


_NODES = tuple(ids.node_id("127.0.0.1", p) for p in (7001, 7002, 7003, 7004))
_NODES_SQL = "[" + ", ".join(f"'{n}'" for n in sorted(_NODES)) + "]"


@query(f"""SELECT doc_id, {_NODES_SQL}[(strpos('0123456789abcdef', right(k, 1)) - 1) % 4 + 1] AS modulo, coalesce(list_filter({_NODES_SQL}, lambda n: n >= k)[1], {_NODES_SQL}[1]) AS ring,
  list_sort(list_transform({_NODES_SQL}, lambda n: sha256('"' || k || n || '"') || n))[4][65:] AS rendezvous FROM (SELECT doc_id, sha256('"' || doc_id || '"') AS k FROM documents)""")
def placement(spark: SparkSession, d: str) -> DataFrame:
    """The node of each key by the three placement hashes."""
    ship(spark)

    def run(batch: pa.Array) -> pa.Array:
        nodes, keys = list(_NODES), [ids.get_id(k) for k in batch.to_pylist()]
        return pa.array([{"modulo": ids.modulo_node(k, nodes), "ring": ids.ring_node(k, nodes), "rendezvous": ids.rendezvous_node(k, nodes)} for k in keys], pa.struct([(c, pa.string()) for c in ("modulo", "ring", "rendezvous")]))

    rows = _read(spark, d, "documents").select("doc_id", F.arrow_udf(run, "modulo string, ring string, rendezvous string")(_number("doc_id")).alias("n"))
    return rows.select("doc_id", "n.modulo", "n.ring", "n.rendezvous")
