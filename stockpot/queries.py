"""Registered queries over the driver's tables, one or more for each kind of operator, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html, ids, recipes, text, urls
from .functions.porter import stem_column
from .lineage import folder_for
from .operators import enrich, frontier, index, mapreduce, ngrams, ranking, spell, stats
from .plans import corpus, crawl, hybrid
from .sources import sitemaps, store, tables, web
from .streaming import grams as gram_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL fragments: words, tokens and letter runs of a text, as lists.
def _sql_words(t: str = "text", least: int = 1) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= {least})"


def _sql_runs(t: str = "text") -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^a-z]+'), lambda w: length(w) > 0)"


_TOKENS = f"SELECT doc_id, {_sql_words(least=2)} AS t FROM documents"
_POSTS = f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM ({_TOKENS})) GROUP BY term, doc_id"
_LENGTHS = f"SELECT doc_id, len(list_distinct(t)) AS doc_length FROM ({_TOKENS})"
_BUCKET = "CASE WHEN {m} IS NULL THEN 'unknown' WHEN {m} <= 15 THEN 'le15' WHEN {m} <= 30 THEN 'le30' WHEN {m} <= 60 THEN 'le60' ELSE 'gt60' END"
_MINUTES = f"(n_chars // {corpus.CHARS_A_MINUTE})"
_ATTRS = f"""SELECT DISTINCT attr_type, attr_key, doc_id FROM (
  SELECT 'dietary' AS attr_type, lower(lang) AS attr_key, doc_id FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT 'appliance', lower(source), doc_id FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT 'timebucket', {_BUCKET.format(m=_MINUTES)}, doc_id FROM documents)"""


def _bm25_sql(terms: str, facets: str, top: int) -> str:
    """Ranked hits of a batch: terms(query_id, term), facets(query_id, attr_type, attr_key) as VALUES."""
    return f"""WITH posts AS ({_POSTS}), attrs AS ({_ATTRS}), lengths AS ({_LENGTHS}), terms AS ({terms}), facets AS ({facets}),
    need AS (SELECT query_id, count(*) AS n FROM facets GROUP BY query_id),
    cands AS (SELECT f.query_id, a.doc_id FROM facets f JOIN attrs a USING (attr_type, attr_key) GROUP BY f.query_id, a.doc_id HAVING count(*) = (SELECT n FROM need WHERE need.query_id = f.query_id)),
    df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
    st AS (SELECT count(*)::DOUBLE AS n, greatest(1.0::DOUBLE, avg(doc_length)) AS mean FROM lengths),
    scored AS (SELECT t.query_id, p.doc_id, sum(ln(1 + (st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * (p.tf * 2.2::DOUBLE) / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(1, l.doc_length) / st.mean))) AS score
      FROM terms t JOIN posts p USING (term) JOIN df USING (term) JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN st
      WHERE t.query_id NOT IN (SELECT query_id FROM facets) OR EXISTS (SELECT 1 FROM cands c WHERE c.query_id = t.query_id AND c.doc_id = p.doc_id)
      GROUP BY t.query_id, p.doc_id
      UNION ALL SELECT query_id, doc_id, 1.0 FROM cands WHERE query_id NOT IN (SELECT query_id FROM terms)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
    SELECT query_id, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= {top}"""


#: The batch of hybrid queries: languages, sources and lengths as facets.
BATCH = ["the and", "tion de la", "with that of", "under 15 minutes", "the under 30 minutes", "idiot the", "en der und"]


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, coalesce(t[1], '') AS first_token FROM ({_TOKENS})")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.coalesce(F.try_element_at("t", F.lit(1)), F.lit("")).alias("first_token"))


@query(f"SELECT conv_id, turn, len({_sql_words()}) AS n_words FROM conversations")
def token_words(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "conversations").select("conv_id", "turn", F.size(text.words(F.col("text"))).cast("long").alias("n_words"))


@query(f"""SELECT term, doc_id, count(*) AS tf, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions
  FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS p FROM (SELECT doc_id, {_sql_words(least=2)} AS t FROM documents)) GROUP BY term, doc_id""")
def postings_positions(spark: SparkSession, d: str) -> DataFrame:
    found = index.postings(_read(spark, d, "documents"), [F.col("text")], "doc_id")
    return found.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(_POSTS)
def postings(spark: SparkSession, d: str) -> DataFrame:
    return index.counted_postings(_read(spark, d, "documents"), F.col("text")).select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


@query(f"SELECT term, count(*) AS df FROM ({_POSTS}) GROUP BY term")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return index.document_frequency(index.counted_postings(_read(spark, d, "documents"), F.col("text")))


@query(f"SELECT count(*) AS doc_count, CAST(sum(doc_length) AS BIGINT) AS doc_len_sum, round(greatest(1.0::DOUBLE, avg(doc_length)), 6) AS avg_doc_length FROM ({_LENGTHS})")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.corpus_stats(corpus.docmeta(_read(spark, d, "documents"))).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"""SELECT m.doc_id, l.doc_length, substr(array_to_string(b[1:2], ' '), 1, 280) AS snippet, {_BUCKET.format(m=_MINUTES)} AS bucket
  FROM (SELECT doc_id, n_chars, {_LINES} AS b FROM documents) m JOIN ({_LENGTHS}) l USING (doc_id)""")
def doc_meta(spark: SparkSession, d: str) -> DataFrame:
    meta = corpus.docmeta(_read(spark, d, "documents"))
    return meta.select("doc_id", "doc_length", "snippet", recipes.time_bucket(F.col("total_minutes")).alias("bucket"))


@query(_ATTRS)
def attribute_lists(spark: SparkSession, d: str) -> DataFrame:
    return corpus.attrs(corpus.docmeta(_read(spark, d, "documents")))


def _batch_sql() -> str:
    terms, facets = [], []
    for i, q in enumerate(BATCH):
        p = hybrid.parse(q)
        terms += [f"({i}, '{t}')" for t in dict.fromkeys(p.terms)]
        facets += [f"({i}, '{k}', '{v}')" for k, v in p.facets()]
    return _bm25_sql(f"SELECT * FROM (VALUES {', '.join(terms)}) x(query_id, term)", f"SELECT * FROM (VALUES {', '.join(facets)}) y(query_id, attr_type, attr_key)", 20)


_stored: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, d: str) -> index.Index:
    """The index of the documents, written to the shared folder by the first query of a session that asks."""
    name = (spark.sparkContext.applicationId, d)
    if name not in _stored:
        folder = folder_for(spark)
        corpus.index(_read(spark, d, "documents")).write(folder)
        _stored[name] = folder
    return index.Index.read(spark, _stored[name])


def _ask(spark: SparkSession, d: str, asked: list[str]) -> DataFrame:
    return hybrid.batch(spark, stored_index(spark, d), asked)


@query(_bm25_sql("SELECT 0 AS query_id, unnest(['with', 'that']) AS term", "SELECT 0 AS query_id, 'dietary' AS attr_type, 'en' AS attr_key", 20))
def texts_asked(spark: SparkSession, d: str) -> DataFrame:
    """A single batch straight over texts, without a stored index."""
    found = corpus.index_for(_read(spark, d, "documents"), ["with", "that"])
    one = lambda row, schema: spark.createDataFrame([row] if isinstance(row, tuple) else row, schema)
    hits = ranking.search(found, one([(0, "with"), (0, "that")], "query_id int, term string"), one((0, "dietary", "en"), "query_id int, attr_type string, attr_key string"), one((0, 20), "query_id int, top int"))
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(_batch_sql())
def hybrid_batch(spark: SparkSession, d: str) -> DataFrame:
    found = _ask(spark, d, BATCH)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql("SELECT 0 AS query_id, unnest(['the', 'and']) AS term", "SELECT 0 AS query_id, '' AS attr_type, '' AS attr_key WHERE false", 20))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = _ask(spark, d, ["the and"])
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id FROM ({_ATTRS}) WHERE (attr_type, attr_key) IN (('dietary', 'en'), ('timebucket', 'le30')) GROUP BY doc_id HAVING count(*) = 2")
def facet_intersect(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(0, "dietary", "en"), (0, "timebucket", "le30")], "query_id int, attr_type string, attr_key string")
    return ranking.facet_candidates(corpus.attrs(corpus.docmeta(_read(spark, d, "documents"))), wanted, ["query_id"]).select("doc_id")


@query(f"SELECT doc_id, 1.0::DOUBLE AS score FROM ({_ATTRS}) WHERE attr_type = 'timebucket' AND attr_key = 'le60' ORDER BY doc_id LIMIT 20")
def facet_only(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d, ["under 45"]).select("doc_id", "score")


# n-grams

_STOP = ", ".join(f"'{w}'" for w in ngrams.STOPWORDS)


def _grams_sql(table: str, key: str) -> str:
    runs = f"list_filter({_sql_runs()}, lambda w: w NOT IN ({_STOP}))"
    one = "list_transform(range(1, len(w) - {k} + 1), lambda i: array_to_string(w[i:i + {k}], ' '))"
    every = f"list_concat(w, {one.format(k=1)}, {one.format(k=2)})"
    return f"SELECT {key}, gram, count(*) AS freq FROM (SELECT {key}, unnest({every}) AS gram FROM (SELECT {key}, {runs} AS w FROM {table})) GROUP BY {key}, gram"


@query(_grams_sql("documents", "doc_id"))
def ngram_index(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.in_row_grams(_read(spark, d, "documents"), ngrams.STOPWORDS)


@query()
def ngram_stemmed(spark: SparkSession, d: str) -> DataFrame:
    pages = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), "text")
    return ngrams.local_index(pages, ngrams.stopwords(spark))


@query(f"""SELECT gram, url, CAST(sum(freq) AS BIGINT) AS freq FROM (
  SELECT gram, 'doc:' || doc_id AS url, freq FROM ({_grams_sql('documents', 'doc_id')})
  UNION ALL SELECT gram, 'doc:' || doc_id, freq FROM ({_grams_sql('documents', 'doc_id')})
  UNION ALL SELECT gram, 'conv:' || conv_id, freq FROM ({_grams_sql('conversations', 'conv_id')})) GROUP BY gram, url""")
def ngram_merge(spark: SparkSession, d: str) -> DataFrame:
    key = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string")).alias("url")
    docs = ngrams.in_row_grams(_read(spark, d, "documents"), ngrams.STOPWORDS, key="doc_id").select("gram", key("doc:", "doc_id"), "freq")
    talks = ngrams.in_row_grams(_read(spark, d, "conversations"), ngrams.STOPWORDS, key="conv_id").select("gram", key("conv:", "conv_id"), "freq")
    return ngrams.merge(docs, talks, docs).select("gram", "url", "freq")


def _doc_grams(spark: SparkSession, d: str) -> DataFrame:
    found = ngrams.in_row_grams(_read(spark, d, "documents"), ngrams.STOPWORDS, key="doc_id")
    return found.select("gram", F.col("doc_id").cast("string").alias("url"), "freq")


_DOC_GRAMS = f"SELECT gram, CAST(doc_id AS VARCHAR) AS url, freq FROM ({_grams_sql('documents', 'doc_id')})"


@query(f"SELECT gram || ' | ' || string_agg(url || ' ' || freq, ' ' ORDER BY freq DESC, url) AS value FROM ({_DOC_GRAMS}) GROUP BY gram")
def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.to_lines(ngrams.posting_lists(_doc_grams(spark, d)))


@query(f"SELECT gram, CAST(sum(freq) AS BIGINT) AS freq_sum FROM ({_DOC_GRAMS}) GROUP BY gram")
def index_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = ngrams.to_lines(ngrams.posting_lists(_doc_grams(spark, d)))
    return ngrams.from_lines(lines).groupBy("gram").agg(F.sum("freq_sum").alias("freq_sum"))


@query(f"SELECT * FROM ({_DOC_GRAMS}) WHERE contains(' ' || gram || ' ', ' tion ')")
def phrase_query(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.phrase_query(_doc_grams(spark, d), ["tion"])


@query(f"SELECT term, CAST(sum(freq) AS BIGINT) AS score FROM (SELECT freq, unnest(list_distinct(string_split(gram, ' '))) AS term FROM ({_DOC_GRAMS})) GROUP BY term")
def vocab_score(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.vocabulary(_doc_grams(spark, d))


@query()
def stems(spark: SparkSession, d: str) -> DataFrame:
    words = _read(spark, d, "documents").select(F.explode(text.letter_runs(F.col("text"))).alias("word")).distinct()
    return stem_column(words, "word")


# spelling

_TYPOS = ("tha", "withh", "anf", "ofr", "tyhe")


def _edits_sql(typos: tuple[str, ...] = _TYPOS) -> str:
    letters = f"unnest(string_split('{spell.ALPHABET}', ''))"
    words = ", ".join(f"('{t}')" for t in typos)
    return f"""WITH w AS (SELECT token, unnest(range(0, length(token) + 1)) AS i FROM (VALUES {words}) x(token)), c AS (SELECT {letters} AS c),
    e AS (SELECT token, substr(token, 1, i) || substr(token, i + 2) AS term FROM w WHERE i < length(token)
      UNION SELECT token, substr(token, 1, i) || substr(token, i + 2, 1) || substr(token, i + 1, 1) || substr(token, i + 3) FROM w WHERE i < length(token) - 1
      UNION SELECT token, substr(token, 1, i) || c || substr(token, i + 2) FROM w, c WHERE i < length(token)
      UNION SELECT token, substr(token, 1, i) || c || substr(token, i + 1) FROM w, c),
    df AS (SELECT term, count(*) AS score FROM ({_POSTS}) GROUP BY term),
    r AS (SELECT token, term, row_number() OVER (PARTITION BY token ORDER BY score DESC, term) AS n FROM e JOIN df USING (term) WHERE term <> token AND term <> '')
    SELECT token, term AS suggestion FROM r WHERE n = 1"""


@query(_edits_sql())
def spell_suggest(spark: SparkSession, d: str) -> DataFrame:
    scores = doc_freq(spark, d).select("term", F.col("df").alias("score"))
    return spark.createDataFrame(list(spell.best_words(spark, list(_TYPOS), scores).items()), "token string, suggestion string")


# pages and urls


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>([^<]*)</title>') THEN regexp_replace(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1), '^\\s+|\\s+$', '', 'g') END AS title FROM pages")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return html.parse_pages(_read(spark, d, "pages")).select("page_id", "page.text")


_HREFS = "regexp_extract_all(html, '(?i)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"'']', 1)"
_SITE_OF = "regexp_extract(url, '^[a-z]+://[^/?#]+', 0)"


@query(f"SELECT page_id, (i - 1)::INTEGER AS position, CASE WHEN h[i] LIKE 'http%' THEN '' ELSE {_SITE_OF} END || regexp_replace(h[i], '[?#].*$', '') AS link FROM (SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, {_HREFS} AS h FROM pages))")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return html.parse_pages(_read(spark, d, "pages")).select("page_id", F.posexplode("page.anchors").alias("position", "link"))


@query("SELECT url, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>([^<]*)</title>') THEN regexp_replace(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1), '^\\s+|\\s+$', '', 'g') END AS title, true AS some_text FROM pages")
def crawl_records(spark: SparkSession, d: str) -> DataFrame:
    return html.crawl_docs(_read(spark, d, "pages")).select("url", "title", (F.length("text") > 0).alias("some_text"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\\.', '') AS host,
  CASE WHEN url LIKE '%index.html' THEN substr(url, 1, length(url) - 10) WHEN url LIKE '%/' THEN url ELSE url || '/' END AS base FROM pages""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _read(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.adjusted_base(u).alias("base"))


_URL_FORMS = (
    "https://www.food.com/recipe/soup-{}", "https://food.com/about/recipe/{}", "https://www.allrecipes.com/pie-recipe-{}", "https://www.allrecipes.com/gallery/pie-recipe-{}",
    "https://www.allrecipes.com/recipe/{}/", "https://www.seriouseats.com/recipes/{}", "https://www.seriouseats.com/page-{}", "https://www.seriouseats.com/perfect-{}",
    "https://www.budgetbytes.com/stew-{}/", "https://www.budgetbytes.com/category/{}", "ftp://food.com/recipe/{}",
)
_ACCEPTED = (0, 2, 4, 5, 7, 8)


def _url_rows(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(*[F.concat(F.lit(f.split("{}")[0]), F.col("page_id").cast("string"), F.lit(f.split("{}")[1])) for f in _URL_FORMS])
    return _read(spark, d, "pages").select("page_id", F.posexplode(forms).alias("form", "url"))


@query(f"SELECT page_id, form, form IN {_ACCEPTED} AS multisite, form = 0 AS food_only, form IN (0, 1) AS legacy FROM pages, (SELECT unnest(range(0, {len(_URL_FORMS)}))::INTEGER AS form)")
def url_policy(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _url_rows(spark, d).select("page_id", "form", urls.policy("multisite")(u).alias("multisite"), urls.policy("food_only")(u).alias("food_only"), urls.legacy_food_recipe(u).alias("legacy"))


@query("SELECT page_id, i AS position, 'https://x.org/' || page_id || '/' || i AS loc, page_id % 2 = 0 AS is_index, 'https://x.org/s' || page_id || '.xml' AS sitemap FROM pages, (SELECT unnest(range(0, 3))::INTEGER AS i)")
def sitemap_locations(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    locs = F.concat(*[F.concat(F.lit("<url><loc> https://x.org/"), number, F.lit(f"/{i} </loc></url>")) for i in range(3)])
    xml = F.concat(F.when(F.col("page_id") % 2 == 0, "<sitemapindex xmlns='x'>").otherwise("<urlset>"), locs)
    robots = F.concat(F.lit("User-agent: *\nSITEMAP: https://x.org/s"), number, F.lit(".xml \nDisallow: /"))
    rows = _read(spark, d, "pages").select("page_id", F.posexplode(sitemaps.locations(xml)).alias("position", "loc"), sitemaps.is_index(xml).alias("is_index"), sitemaps.robots_sitemaps(robots).alias("s"))
    return rows.select("page_id", "position", "loc", "is_index", F.element_at("s", 1).alias("sitemap"))


# the normaliser


_AMOUNTS = ("2 cups ", "1/2 cup ", "3 ", "0/2 ", "1.5 tbsp ", "")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as crawl records: the first line is the title, every line of the text makes an ingredient line."""
    docs = _read(spark, d, "documents")
    amount = F.element_at(F.array(*[F.lit(x) for x in _AMOUNTS]), (F.col("doc_id") % 6 + 1).cast("int"))
    lines = F.transform(corpus.lines(), lambda x: F.concat(amount, F.lit("x"), x, F.lit(" flour, (fresh)")))
    times = F.when(F.col("doc_id") % 3 == 0, F.struct((F.col("doc_id") % 90).cast("int").alias("totalMinutes"), F.lit(None).cast("int").alias("prepMinutes"), F.lit(5).alias("cookMinutes")))
    return docs.select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), "text", F.try_element_at(corpus.lines(), F.lit(1)).alias("title"), times.alias("times"), lines.alias("ingredients"), F.array("lang").alias("categories"))


_TITLE = f"coalesce(({_LINES})[1], '')"


@query(f"SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower({_TITLE}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'recipe') AS slug FROM documents")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", recipes.slugify(F.coalesce(F.try_element_at(corpus.lines(), F.lit(1)), F.lit(""))).alias("slug"))


@query(f"""SELECT doc_id, sha256(concat_ws(chr(10), 'doc:' || doc_id, coalesce(nullif({_TITLE}, ''), 'Untitled Recipe'), '', array_to_string(({_LINES})[1:30], '|'), '{{}}')) AS source_hash FROM documents""")
def source_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    title = F.coalesce(F.nullif(F.try_element_at(corpus.lines(), F.lit(1)), F.lit("")), F.lit(recipes.UNTITLED))
    url = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", recipes.source_hash(url, title, F.array().cast("array<string>"), F.slice(corpus.lines(), F.lit(1), F.lit(30)), F.lit("{}")).alias("source_hash"))


_AMOUNT_SQL = "[" + ", ".join(f"'{a}'" for a in _AMOUNTS) + "][doc_id % 6 + 1]"


def _contains(column: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({column}, '{'|'.join(words)}')"


@query(f"""SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {_contains('lower(text)', k)} THEN '{t}' END" for t, k in recipes.APPLIANCES.items())}], lambda x: x IS NOT NULL), ',') AS appliances,
  {_contains('lower(text)', recipes.MEAT)} AS meat, regexp_matches(lower(text), '\\begg(s)?\\b') AS egg FROM documents WHERE text IS NOT NULL""")
def tag_detect(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return _read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(recipes.appliance_tags(F.col("text")), ",").alias("appliances"), F.rlike(low, F.lit("|".join(recipes.MEAT))).alias("meat"), F.rlike(low, F.lit("\\begg(s)?\\b")).alias("egg"))


@query(f"SELECT doc_id, n_chars AS seconds, CAST(floor(n_chars / 60.0::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS minutes, {_BUCKET.format(m='floor(n_chars / 60.0::DOUBLE + 0.5::DOUBLE)')} AS bucket FROM documents")
def durations(spark: SparkSession, d: str) -> DataFrame:
    minutes = html.duration_minutes(F.concat(F.lit("PT"), F.col("n_chars").cast("string"), F.lit("S")))
    return _read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("seconds"), minutes.alias("minutes"), recipes.time_bucket(minutes).alias("bucket"))


@query(f"SELECT 'doc:' || doc_id AS source_url, unnest(b) AS step_text, generate_subscripts(b, 1)::INTEGER - 1 AS position FROM (SELECT doc_id, ({_LINES})[1:30] AS b FROM documents)")
def recipe_steps(spark: SparkSession, d: str) -> DataFrame:
    rows = recipes.normalise(_records(spark, d))
    return tables.steps_table(rows).join(rows.select("recipe_id", "source_url"), "recipe_id").select("source_url", "step_text", "position")


@query("SELECT doc_id, sha256('\"' || source || '\"') AS id FROM documents WHERE source IS NOT NULL")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", ids.content_id(F.col("source")).alias("id"))


# crawl


@query("SELECT url, depth, parent FROM (SELECT user_id AS url, event_id % 7 AS depth, event_type AS parent, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7, event_type) AS n FROM events) WHERE n = 1 AND depth <= 6 AND url NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def frontier_merge(spark: SparkSession, d: str) -> DataFrame:
    links = _read(spark, d, "events").select(F.col("user_id").alias("url"), (F.col("event_id") % 7).alias("depth"), F.col("event_type").alias("parent"))
    visited = _read(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("url"))
    return frontier.to_visit(frontier.merge_frontier(links), visited)


# statistics, sets and the store


@query("""SELECT event_type, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99 FROM events GROUP BY event_type""")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.latency(_read(spark, d, "events"), "value", ["event_type"]).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_by(_read(spark, d, "events"), "event_type")


@query("SELECT source, n, n - coalesce(lag(n) OVER (ORDER BY source), 0) AS n_delta FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)")
def round_deltas(spark: SparkSession, d: str) -> DataFrame:
    rounds = stats.count_by(_read(spark, d, "documents").filter("source IS NOT NULL"), "source")
    return stats.deltas(rounds, "source", "n")


_ALL = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _ALL))
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.row_counts({t: _read(spark, d, t) for t in _ALL})


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20")
def recent_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.recent(_read(spark, d, "events"), "ts", "event_id", 20).select("event_id", "user_id", "event_type")


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels = _read(spark, d, "labels")
    old = labels.select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    new = labels.filter("toxic = 1").select(F.col("doc_id").cast("string").alias("key"), F.lit("toxic").alias("value"))
    return old, new


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'q' || quality END AS value FROM labels")
def kv_upsert(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(*_pairs(spark, d))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN toxic = 1 THEN 'q' || quality || ',toxic' ELSE 'q' || quality END AS value FROM labels")
def kv_append(spark: SparkSession, d: str) -> DataFrame:
    return store.append(*_pairs(spark, d)).select("key", F.array_join("values", ",").alias("value"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, 'q' || quality AS value FROM labels WHERE toxic <> 1 OR toxic IS NULL")
def kv_delete(spark: SparkSession, d: str) -> DataFrame:
    return store.delete(*_pairs(spark, d))


@query("SELECT key, value FROM (SELECT CAST(user_id AS VARCHAR) AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY user_id)")
def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), "event_id")
    return store.latest(rows, "event_id").select("key", "value")


@query("SELECT CAST(event_type AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY event_type")
def map_reduce(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.to_json(F.struct("event_type")).alias("value"))
    return mapreduce.map_reduce(rows, lambda key, value: [{value["event_type"]: 1}], lambda key, values: sum(values))


@query(f"SELECT term, doc_id, 'C' AS weight, count(*) AS tf FROM (SELECT doc_id, unnest({_sql_words(least=2)}) AS term FROM documents) GROUP BY term, doc_id")
def weighted_postings(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("recipe_id"), F.lit("").alias("title"), none.alias("ingredients_raw"), F.array("text").alias("steps_raw"))
    return index.weighted_postings(docs)


# streaming


@query(_grams_sql("documents", "doc_id"))
def stream_gram_merge(spark: SparkSession, d: str) -> DataFrame:
    """The n-gram index kept by a stream that reads the documents as files, run until nothing is left."""
    pages = _read(spark, d, "documents")
    base = folder_for(spark)
    files = max(4, pages.rdd.getNumPartitions())
    pages.select("doc_id", "text").repartition(files).write.parquet(f"{base}/in")
    stream = gram_stream.read_pages(spark, f"{base}/in", "doc_id long, text string", files_per_batch=files // 2)
    gram_stream.start_merge(stream, f"{base}/index", f"{base}/checkpoint", key="doc_id").awaitTermination()
    return gram_stream.read_index(spark, f"{base}/index", "doc_id").select("doc_id", "gram", "freq")



# single operators of the text, page and recipe chains


@query(f"SELECT doc_id, term, p AS position FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1)::INTEGER - 1 AS p FROM (SELECT doc_id, {_sql_words(least=2)} AS t FROM documents))")
def token_positions(spark: SparkSession, d: str) -> DataFrame:
    return text.positions([F.col("text")], _read(spark, d, "documents"), "doc_id").select("doc_id", "term", "position")


@query(f"SELECT doc_id, word, p AS position FROM (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1)::INTEGER - 1 AS p FROM (SELECT doc_id, {_sql_runs()} AS t FROM documents)) WHERE word NOT IN ({_STOP})")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.words(_read(spark, d, "documents"), ngrams.stopwords(spark), key="doc_id", stem=False).select("doc_id", "word", "position")


@query(f"SELECT doc_id, w[i] || ' ' || w[i + 1] AS gram, count(*) AS freq FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM (SELECT doc_id, {_sql_runs()} AS w FROM documents)) GROUP BY ALL")
def bigrams(spark: SparkSession, d: str) -> DataFrame:
    found = ngrams.in_row_grams(_read(spark, d, "documents"), [], key="doc_id", longest=2)
    return found.filter(F.contains("gram", F.lit(" ")))


@query("SELECT page_id, (page_id % 90)::INTEGER AS minutes, CASE WHEN page_id % 2 = 0 THEN (page_id % 90)::INTEGER END AS none_without_unit FROM pages")
def body_minutes(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("page_id") % 90).cast("string")
    full = F.concat(F.lit("text Prep  Time : "), n, F.lit(" minutes, total time 999 min"))
    other = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("COOK TIME "), n, F.lit("min"))).otherwise(F.concat(F.lit("cook time "), n, F.lit(" hours")))
    return _read(spark, d, "pages").select("page_id", html.body_minutes(full).alias("minutes"), html.body_minutes(other).alias("none_without_unit"))


@query(_edits_sql().split("df AS (")[0].rstrip().rstrip(",") + " SELECT token, term FROM e")
def edit_candidates(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, e) for t in _TYPOS for e in spell.edits(t)], "token string, term string")


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(({_sql_words()})[1:{enrich.TAG_CAP}])), ',') AS tags FROM documents")
def tag_cap(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(enrich.tag_list(text.words(F.col("text")))), ",").alias("tags"))


@query(f"SELECT doc_id, round(CASE WHEN n > 0 THEN [0.95, 0.95, 0.85, 0.75, 0.95, 0.75][doc_id % 6 + 1]::DOUBLE ELSE 0 END, 6) AS confidence FROM (SELECT doc_id, len({_LINES}) AS n FROM documents)")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = recipes.normalise(_records(spark, d))
    number = F.regexp_extract("source_url", "[0-9]+", 0).cast("long").alias("doc_id")
    return rows.select(number, F.round(F.col("extraction_confidence")["ingredients"], 6).alias("confidence"))


@query("SELECT 'https://www.food.com/recipe/' || (page_id * 3 + i) AS url FROM pages, (SELECT unnest(range(0, 3)) AS i) WHERE i < 2")
def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds through robots, an index of sitemaps and the URL policy; every third URL is of another kind."""
    pages = _read(spark, d, "pages").select("page_id", F.concat(F.lit("https://s/"), F.col("page_id").cast("string"), F.lit(".xml")).alias("map"))
    kinds = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("<loc>https://www.food.com/"), F.when(i < 2, "recipe/").otherwise("about/"), (F.col("page_id") * 3 + i).cast("string"), F.lit("</loc>")))
    maps = pages.select(F.col("map").alias("url"), F.concat(F.lit("<urlset>"), F.array_join(kinds, ""), F.lit("</urlset>")).alias("html"))
    listed = pages.withColumn("root", F.concat(F.lit("https://s/root"), (F.col("page_id") % 4).cast("string"))).groupBy("root").agg(F.collect_list(F.concat(F.lit("<loc>"), F.col("map"), F.lit("</loc>"))).alias("l"))
    roots = listed.select(F.col("root").alias("url"), F.concat(F.lit("<sitemapindex >"), F.array_join("l", " "), F.lit("</sitemapindex>")).alias("html"))
    robots = spark.createDataFrame([("\n".join(f"Sitemap: https://s/root{i}" for i in range(4)),)], "body string")
    return sitemaps.seeds(robots, web.from_table(maps.union(roots)), urls.policy("multisite"))


@query(f"SELECT 'doc:' || doc_id AS source_url, NOT regexp_matches(lower(text), '{'|'.join(k for ks in recipes.APPLIANCES.values() for k in ks)}') AS asks_appliances FROM documents WHERE text IS NOT NULL")
def needed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Which canonical recipes an enrichment would ask about, here for the appliance field."""
    rows = recipes.normalise(_records(spark, d).filter("text IS NOT NULL"))
    return rows.select("source_url", F.array_contains(enrich.needed_fields(rows), "appliance_tags").alias("asks_appliances"))


from . import queries_chains  # noqa: E402, F401  (registers its queries; it needs the helpers above)
