"""URL parts, resolution and site policies as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = "^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]+)?([^?#]*)"
# Site rules.
ALLRECIPES_BLOCKED = ("article", "gallery", "video", "kitchen", "cook", "home", "author", "profile", "user", "print", "reviews")
SERIOUSEATS_BLOCKED = (
    "about", "contact", "login", "register", "search", "subscribe", "newsletters", "advertise", "privacy", "terms",
    "shop", "authors", "contributors", "slideshows", "user", "video", "photos", "gifts", "sitemap", "rss",
)
BUDGETBYTES_BLOCKED = (
    "/wp-admin", "/wp-login", "/wp-content", "/cdn-cgi", "/search", "/login", "/category/", "/tag/", "/author/",
    "/page/", "/recipes/", "/meal-plan", "/about", "/contact", "/faq", "/privacy", "/terms", "/accessibility",
    "/collaborate", "/extra-bytes", "/xmlrpc.php", "/feed", "/wp-json",
)


def host(url: Column) -> Column:
    """Lower-cased host without a leading www.; empty for what is not an http URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _SHAPE, 1)), "^www\\.", "")


def path(url: Column) -> Column:
    found = F.regexp_extract(url, _SHAPE, 2)
    return F.when(found == "", F.lit("/")).otherwise(found)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def _first(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_element_at(segments(url), F.lit(1)), F.lit("")))


def food_detail(url: Column) -> Column:
    """food.com: /recipe/<something>."""
    return (host(url) == "food.com") & F.lower(path(url)).contains("/recipe/") & (F.size(segments(url)) >= 2) & (_first(url) == "recipe")


def allrecipes_detail(url: Column) -> Column:
    """allrecipes.com: /recipe/<something> or a slug that ends in -recipe-<digits>, outside the blocked sections."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    blocked = F.rlike(trimmed, F.lit(f"(?i)^/(?:{'|'.join(ALLRECIPES_BLOCKED)})\\b"))
    recipe = F.lower(trimmed).contains("/recipe/")
    detail = F.when(recipe, (F.size(segments(url)) >= 2) & (_first(url) == "recipe")).otherwise(F.rlike(trimmed, F.lit("^/[^/]+-recipe-[0-9]+$")))
    return (host(url) == "allrecipes.com") & (trimmed != "") & ~blocked & detail


def seriouseats_detail(url: Column) -> Column:
    """seriouseats.com: /recipes/<something> or one slug of six characters or more that is no page number."""
    parts = segments(url)
    slug = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    single = (F.size(parts) == 1) & ~F.rlike(slug, F.lit("(?i)^page-[0-9]+$")) & (F.length(slug) >= 6)
    return (host(url) == "seriouseats.com") & (F.size(parts) > 0) & ~_first(url).isin(*SERIOUSEATS_BLOCKED) & F.when(_first(url) == "recipes", F.size(parts) >= 2).otherwise(single)


def budgetbytes_detail(url: Column) -> Column:
    """budgetbytes.com: one slug of three characters or more under no blocked prefix."""
    low = F.lower(path(url))
    blocked = F.lit(False)
    for prefix in BUDGETBYTES_BLOCKED:
        blocked = blocked | low.startswith(prefix)
    return (host(url) == "budgetbytes.com") & ~blocked & (F.size(segments(url)) == 1) & (F.length(_first(url)) >= 3)


def multisite_detail(url: Column) -> Column:
    """A recipe page of one of the four sites; null and unparsable URLs are none."""
    rules = food_detail(url) | allrecipes_detail(url) | seriouseats_detail(url) | budgetbytes_detail(url)
    return F.coalesce(rules, F.lit(False))


def food_only_detail(url: Column) -> Column:
    return F.coalesce(food_detail(url), F.lit(False))


def legacy_food_recipe(url: Column) -> Column:
    """The older rule: food.com with or without www., /recipe/ anywhere in the path."""
    return F.coalesce((host(url) == "food.com") & F.lower(path(url)).contains("/recipe/"), F.lit(False))


#: Policies by preset; any other name means multisite.
POLICIES: dict[str, Callable[[Column], Column]] = {"multisite": multisite_detail, "food_only": food_only_detail}


def policy(preset: str = "multisite") -> Callable[[Column], Column]:
    return POLICIES.get(preset, multisite_detail)


def adjusted_base(url: Column) -> Column:
    """The base against which links resolve: without a final index.html, else with a final slash."""
    return F.when(url.endswith("index.html"), F.regexp_replace(url, "index\\.html$", "")).when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/")))


def base_of(url: str) -> str:
    """adjusted_base for one value."""
    if url.endswith("index.html"):
        return url.removesuffix("index.html")
    return url if url.endswith("/") else url + "/"


def resolve(href: str, page: str) -> str | None:
    """Absolute URL of a link on a page, without query and fragment; None for a bad link."""
    try:
        full = urljoin(base_of(page), href.strip())
        parts = urlsplit(full)
        if not parts.scheme or (parts.scheme in ("http", "https") and not parts.hostname):
            return None
        if parts.scheme in ("http", "https"):
            port = f":{parts.port}" if parts.port and parts.port != {"http": 80, "https": 443}[parts.scheme] else ""
            full = f"{parts.scheme}://{parts.hostname}{port}{parts.path or '/'}"
    except ValueError:
        return None
    return full.split("?")[0].split("#")[0]
