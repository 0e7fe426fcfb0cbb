"""HTML to text, links and recipe fields: one parse of a page in Python, everything after it in SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import small_batches
from .urls import resolve

_SKIP = {"script", "style", "head", "title", "noscript", "template"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Line breaks before and after the blocks that have more than one.
_WIDE = {"p": 2, "ul": 2, "ol": 2, "pre": 2, "table": 2, "blockquote": 2, "hr": 2} | dict.fromkeys(_HEADINGS, 2)
_BLOCKS = {"div", "section", "article", "header", "footer", "main", "nav", "aside", "form", "fieldset", "li", "tr", "address", "figure", "figcaption", "dl", "dt", "dd", "body", "html", "option"} | set(_WIDE)


class _Text(HTMLParser):
    """Collects text with collapsed white space, upper-case headings and links as `text [href]`."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.breaks, self.skip, self.heading, self.space = 0, 0, 0, False
        self.links: list[tuple[str, int]] = []

    def _break(self, n: int) -> None:
        self.breaks, self.space = max(self.breaks, n), False

    def _put(self, text: str) -> None:
        if self.breaks and self.out:
            self.out.append("\n" * self.breaks)
        elif self.space and self.out:
            self.out.append(" ")
        self.breaks, self.space = 0, False
        self.out.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIP:
            self.skip += 1
        if tag in _BLOCKS:
            self._break(_WIDE.get(tag, 1))
        if tag in _HEADINGS:
            self.heading += 1
        if tag == "br":
            self._break(1)
        elif tag == "li" and not self.skip:
            self._put("* ")
        elif tag == "hr" and not self.skip:
            self._put("-" * 40)
            self._break(2)
        elif tag == "img" and not self.skip:
            known = dict(attrs)
            shown = " ".join(x for x in (known.get("alt"), f"[{known['src']}]" if known.get("src") else None) if x)
            if shown:
                self._put(shown)
        elif tag == "a":
            self.links.append((dict(attrs).get("href") or "", len(self.out)))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP and self.skip:
            self.skip -= 1
        if tag == "a" and self.links:
            href, at = self.links.pop()
            shown = "".join(self.out[at:]).strip()
            if href and not self.skip and shown != href:
                self.space = bool(shown)
                self._put(f"[{href}]")
        if tag in _HEADINGS and self.heading:
            self.heading -= 1
        if tag in _BLOCKS:
            self._break(_WIDE.get(tag, 1))

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        text = re.sub(r"\s+", " ", data)
        if text.startswith(" "):
            self.space = not self.breaks
        body = text.strip()
        if body:
            self._put(body.upper() if self.heading else body)
            self.space = text.endswith(" ")


def html_to_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.out).strip()


class _Links(HTMLParser):
    """Collects hrefs of anchors and the bodies of JSON-LD scripts, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []
        self.scripts: list[str] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known = dict(attrs)
        if tag == "a" and known.get("href"):
            self.hrefs.append(known["href"])
        elif tag == "script" and known.get("type") == "application/ld+json":
            self.inside = True
            self.scripts.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.inside = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.scripts[-1] += data


def item_list_urls(data: object) -> Iterator[str]:
    """URLs of a JSON-LD ItemList, through arrays and @graph; not resolved."""
    if isinstance(data, list):
        for x in data:
            yield from item_list_urls(x)
    elif isinstance(data, dict):
        graph, kinds = data.get("@graph"), data.get("@type")
        yield from item_list_urls(graph if isinstance(graph, list) else [])
        named = ",".join(map(str, kinds)) if isinstance(kinds, list) else str(kinds or "")
        elements = data.get("itemListElement")
        for x in elements if "ItemList" in named and isinstance(elements, list) else []:
            yield from _item_urls(x)


def _item_urls(x: object) -> Iterator[str]:
    if isinstance(x, str):
        yield x
    elif isinstance(x, dict):
        item = x.get("item")
        found = [x.get("url"), item] if not isinstance(item, dict) else [x.get("url"), item.get("url"), item.get("@id")]
        yield from (u for u in found if isinstance(u, str))


def _json(text: str) -> object:
    try:
        return json.loads(text.strip())
    except ValueError:
        return None


def page_links(html: str | None, url: str) -> tuple[list[str], list[str]]:
    """(URLs from JSON-LD item lists as they stand, resolved anchors), each in page order."""
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    listed = [u for s in parser.scripts if s.strip() for u in item_list_urls(_json(s))]
    return listed, [r for h in parser.hrefs if (r := resolve(h, url)) is not None]


def find_recipe(data: object) -> dict | None:
    """The first object of type Recipe, through @graph."""
    if not isinstance(data, dict):
        return None
    kind = data.get("@type")
    if kind == "Recipe" or (isinstance(kind, list) and "Recipe" in kind):
        return data
    graph = data.get("@graph")
    return next((r for g in graph if (r := find_recipe(g))), None) if isinstance(graph, list) else None


def recipe_fields(html: str | None) -> dict:
    """name, durations, ingredients and categories of a page's recipe; a later script replaces earlier fields."""
    out: dict = {}
    for body in re.findall(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", html or ""):
        data = _json(body)
        pieces = data if isinstance(data, list) else [data]
        recipe = next((r for p in pieces if (r := find_recipe(p))), None)
        if recipe is None:
            continue
        if isinstance(recipe.get("name"), str) and recipe["name"]:
            out["name"] = recipe["name"]
        durations = {k: recipe[k] for k in ("totalTime", "timeRequired", "prepTime", "cookTime") if isinstance(recipe.get(k), str)}
        if any(re.search(r"(?i)PT", v) for v in durations.values()):
            out["durations"] = durations
        for source, name in (("recipeIngredient", "ingredients"), ("recipeCategory", "categories")):
            value = recipe.get(source)
            if isinstance(value, list):
                out[name] = [x if isinstance(x, str) else json.dumps(x) for x in value]
            elif isinstance(value, str):
                out[name] = [value]
    return out


def title(html: Column) -> Column:
    """Text of the first title element, trimmed, entities as they stand; null if there is none."""
    pattern = "(?is)<title[^>]*>([^<]*)</title>"
    return F.when(F.rlike(html, F.lit(pattern)), F.regexp_replace(F.regexp_extract(html, pattern, 1), "^\\s+|\\s+$", ""))


def duration_minutes(duration: Column) -> Column:
    """Minutes of an ISO 8601 time duration, rounded; null without PT. Days are not read."""
    pattern = "(?i)PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(duration, pattern, i), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(F.rlike(duration, F.lit(pattern)), F.floor(part(1) * 60 + part(2) + part(3) / 60 + 0.5).cast("int"))


def body_minutes(text: Column) -> Column:
    """Minutes after the first `total|prep|cook time` of a text; null without one."""
    pattern = "(?i)(?:total|prep|cook)\\s*time\\s*[:\\s]*([0-9]+)\\s*(?:min|minutes)"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")


def _parse(html: str | None, url: str | None) -> dict:
    listed, anchors = page_links(html, url or "")
    found = recipe_fields(html)
    times = found.get("durations", {})
    return {"text": html_to_text(html), "listed": listed, "anchors": anchors, "name": found.get("name"), "total_time": times.get("totalTime"), "time_required": times.get("timeRequired"), "prep_time": times.get("prepTime"), "cook_time": times.get("cookTime"), "ingredients": found.get("ingredients"), "categories": found.get("categories")}


def parse_pages(pages: DataFrame) -> DataFrame:
    """Add `page` to pages(url, html): text, links and raw recipe fields, from one Arrow pass."""
    small_batches(pages.sparkSession)
    texts = ("text", "name", "total_time", "time_required", "prep_time", "cook_time")
    lists = ("listed", "anchors", "ingredients", "categories")
    kind = pa.struct([*[(c, pa.string()) for c in texts], *[(c, pa.list_(pa.string())) for c in lists]])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, url in batches:
            yield pa.array([_parse(h, u) for h, u in zip(html.to_pylist(), url.to_pylist(), strict=True)], kind)

    schema = ", ".join([*[f"{c}: string" for c in texts], *[f"{c}: array<string>" for c in lists]])
    return pages.withColumn("page", F.arrow_udf(run, f"struct<{schema}>")("html", "url"))


def frontier_links(listed: Column, anchors: Column, allowed, most: int = 200) -> Column:
    """Distinct links that the policy allows, JSON-LD before anchors, at most `most`."""
    return F.slice(F.array_distinct(F.filter(F.concat(listed, anchors), allowed)), F.lit(1), F.lit(most))


def crawl_docs(pages: DataFrame) -> DataFrame:
    """(url, text, title, times, ingredients, categories): the record kept of each page(url, html)."""
    return records(parse_pages(pages))


def records(rows: DataFrame, *keep: str) -> DataFrame:
    """crawl_docs of parsed pages(url, html, page), and the columns to keep."""
    p = F.col("page")
    total = F.coalesce(duration_minutes(p["total_time"]), duration_minutes(p["time_required"]))
    prep, cook = duration_minutes(p["prep_time"]), duration_minutes(p["cook_time"])
    known = total.isNotNull() | prep.isNotNull() | cook.isNotNull()
    body = body_minutes(p["text"])
    empty = F.lit(None).cast("int")
    fields = lambda a, b, c: F.struct(a.alias("totalMinutes"), b.alias("prepMinutes"), c.alias("cookMinutes"))
    times = F.when(known, fields(total, prep, cook)).when(body.isNotNull(), fields(body, empty, empty))
    return rows.select(*keep, "url", p["text"].alias("text"), F.coalesce(p["name"], title(F.col("html"))).alias("title"), times.alias("times"), p["ingredients"].alias("ingredients"), p["categories"].alias("categories"))


def is_rich(ingredients: Column, times: Column) -> Column:
    """Whether a record has ingredients or times."""
    some = times["totalMinutes"].isNotNull() | times["prepMinutes"].isNotNull() | times["cookMinutes"].isNotNull()
    return F.coalesce(F.size(ingredients) > 0, F.lit(False)) | F.coalesce(some, F.lit(False))
