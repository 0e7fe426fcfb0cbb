"""The recipe normaliser as Column expressions: ingredients, tags, flags, confidences and ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import words

EXTRACTOR_VERSION, SCHEMA_VERSION = "indexer-v1", 1
MAX_STEPS = 30
UNTITLED = "Untitled Recipe"

# Keyword tables.
APPLIANCES = {
    "oven": ("oven", "bake", "baking tray", "broil", "roast"),
    "air fryer": ("air fryer", "airfry"),
    "grill": ("grill", "griddle", "barbecue", "bbq"),
    "stovetop": ("stovetop", "simmer", "saute", "skillet", "frying pan"),
    "microwave": ("microwave",),
    "blender": ("blender", "food processor", "immersion blender"),
    "instant pot": ("instant pot", "pressure cooker"),
    "slow cooker": ("slow cooker", "crock pot"),
}
UNITS = (
    "cup", "cups", "tbsp", "tablespoon", "tablespoons", "tsp", "teaspoon", "teaspoons", "oz", "ounce", "ounces", "lb",
    "pound", "pounds", "g", "gram", "grams", "kg", "ml", "l", "pinch", "clove", "cloves", "can", "cans", "slice", "slices",
)
GLUTEN = (
    "flour", "breadcrumbs", "bread", "soy sauce", "pasta", "noodle", "linguine", "spaghetti", "fettuccine", "penne",
    "macaroni", "lasagna", "orzo", "farro", "barley", "seitan", "tortilla", "cracker",
)
GLUTEN_FREE = ("gluten free", "gluten-free", "certified gluten free")
MEAT = ("beef", "pork", "chicken", "turkey", "fish", "shrimp", "bacon", "ham", "sausage")
DAIRY = ("milk", "butter", "cheese", "yogurt", "cream")
REASONS = {
    "ingredients": "No recipeIngredient field available",
    "times": "No parseable total/prep/cook times",
    "appliance_tags": "No appliance keywords found in text or steps",
    "dietary_tags": "Unable to infer dietary tags from categories/ingredients",
}


def _has(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether one of the keywords, none of which is a pattern, is a substring: a byte search in place of a regex."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords])


def slugify(text: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("recipe"))


_QUANTITY = "^([0-9]+(?:\\.[0-9]+)?|[0-9]+\\s*/\\s*[0-9]+)\\s+"


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: an expression inside a lambda is computed wherever it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ingredients(lines: Column) -> Column:
    """array<struct<raw, name, quantity, unit, confidence>> of ingredient lines, blank ones left out.

    A leading number or fraction is the quantity (a fraction with a zero gives none), then
    a known unit if more follows; the rest without brackets, commas and semicolons is the name.
    Each step is an array of its own, so that nothing is computed twice.
    """
    none = F.lit(None).cast("double")
    raws = F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: _trim(F.coalesce(x, F.lit("")))), lambda x: x != "")

    def cut(raw: Column) -> Column:
        lead = F.regexp_extract(raw, _QUANTITY, 0)
        return F.struct(raw.alias("raw"), F.split(F.regexp_replace(lead, "\\s+", ""), "/").alias("over"), _trim(F.substring(raw, F.length(lead) + 1, F.length(raw))).alias("rest"))

    def number(x: Column) -> Column:
        top, bottom = x["over"][0], F.try_element_at(x["over"], F.lit(2)).cast("double")
        fraction = F.when((top.cast("double") != 0) & (bottom != 0), top.cast("double") / bottom)
        quantity = F.when(top == "", none).when(bottom.isNotNull(), fraction).otherwise(F.nullif(top, F.lit("")).cast("double"))
        return F.struct(x["raw"].alias("raw"), quantity.alias("quantity"), x["rest"].alias("rest"), F.regexp_extract(F.lower(x["rest"]), "^(\\S+)\\s+\\S", 1).alias("first"))

    def named(x: Column) -> Column:
        unit = F.when(x["first"].isin(*UNITS), x["first"])
        after = F.lower(F.substring(x["rest"], F.length(x["first"]) + 1, F.length(x["rest"])))
        cleaned = F.regexp_replace(F.regexp_replace(F.when(unit.isNotNull(), after).otherwise(x["rest"]), "\\([^)]*\\)", " "), "[,;]+", " ")
        return F.struct(x["raw"].alias("raw"), _trim(F.regexp_replace(cleaned, "\\s+", " ")).alias("name"), x["quantity"].alias("quantity"), unit.alias("unit"))

    def weighed(x: Column) -> Column:
        weight = F.lit(0.5) + F.when(F.length(x["name"]) >= 3, 0.25).otherwise(0.0) + F.when(x["quantity"].isNotNull(), 0.1).otherwise(0.0) + F.when(x["unit"].isNotNull(), 0.1).otherwise(0.0)
        return F.struct(x["raw"].alias("raw"), F.nullif(x["name"], F.lit("")).alias("name"), x["quantity"].alias("quantity"), x["unit"].alias("unit"), F.least(F.lit(1.0), weight).alias("confidence"))

    return F.transform(F.transform(F.transform(F.transform(raws, cut), number), named), weighed)


def ingredient(line: Column) -> Column:
    """The same of one line; a blank one has no name and confidence 0."""
    blank = F.struct(F.lit("").alias("raw"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("string").alias("unit"), F.lit(0.0).alias("confidence"))
    return F.coalesce(F.try_element_at(ingredients(F.array(line)), F.lit(1)), blank)


def ingredient_tokens(parsed: Column) -> Column:
    """Distinct words of three characters or more of the names, in order."""
    every = F.flatten(F.transform(parsed, lambda i: words(i["name"])))
    return F.array_distinct(F.filter(every, lambda w: F.length(w) > 2))


def appliance_tags(text: Column) -> Column:
    """Appliances one of whose keywords is a substring of the lower-cased text."""
    tags = lambda low: F.array_compact(F.array(*[F.when(_has(low, keys), F.lit(tag)) for tag, keys in APPLIANCES.items()]))
    return _let(F.lower(F.coalesce(text, F.lit(""))), tags)


def dietary(title: Column, categories: Column, names: Column, has_ingredients: Column) -> Column:
    """struct<tags, confidence>: explicit wording first, else what meat, dairy and egg words allow."""
    cats = F.lower(F.array_join(categories, " "))
    phrases = "|".join(k for k in GLUTEN if " " in k)
    single = "\\b(?:" + "|".join(k for k in GLUTEN if " " not in k) + ")\\b"

    def found(text: Column) -> Column:
        flags = {
            "meat": _has(text, MEAT), "dairy": _has(text, DAIRY), "egg": text.contains("egg") & F.rlike(text, F.lit("\\begg(s)?\\b")), "vegetarian": text.contains("vegetarian"), "vegan": text.contains("vegan"),
            "dairy_free": text.contains("dairy") & F.rlike(text, F.lit("dairy[-\\s]?free")), "gluten_free": _has(text, GLUTEN_FREE), "gluten": F.rlike(text, F.lit(f"{phrases}|{single}")),
        }
        return F.struct(*[v.alias(k) for k, v in flags.items()])

    def tagged(f: Column) -> Column:
        tags = F.array_compact(F.array(
            F.when(f["vegetarian"] | (~f["meat"] & ~cats.contains("meat")), "vegetarian"),
            F.when(f["vegan"] | (~f["meat"] & ~f["dairy"] & ~f["egg"] & ~cats.contains("dairy")), "vegan"),
            F.when(f["dairy_free"] | ~f["dairy"], "dairy-free"),
            F.when(f["gluten_free"], "gluten-free").when(f["gluten"], "contains-gluten"),
        ))
        sure = lambda t: F.when(F.size(t) == 0, 0.0).when(f["vegetarian"] | f["vegan"] | f["dairy_free"] | f["gluten_free"], 0.72).otherwise(0.45)
        return _let(tags, lambda t: F.struct(t.alias("tags"), F.when(has_ingredients, sure(t)).otherwise(F.least(sure(t), F.lit(0.35))).alias("confidence")))

    return _let(_let(_trim(F.concat_ws(" ", F.lower(title), cats, F.lower(F.array_join(names, " ")))), found), tagged)


def time_bucket(minutes: Column) -> Column:
    known = minutes.isNotNull() & ~F.isnan(minutes.cast("double"))
    return F.when(~known, "unknown").when(minutes <= 15, "le15").when(minutes <= 30, "le30").when(minutes <= 60, "le60").otherwise("gt60")


def quality_flags(confidence: dict[str, Column]) -> Column:
    low = lambda name, least: F.coalesce(confidence[name], F.lit(0.0)) < least
    return F.array_compact(F.array(
        F.when(low("ingredients", 0.7), "low_ingredient_confidence"),
        F.when(low("appliance_tags", 0.5), "missing_appliance_tags"),
        F.when(low("dietary_tags", 0.5), "missing_dietary_tags"),
        F.when(low("times", 0.5), "missing_time_fields"),
    ))


def source_hash(url: Column, title: Column, ingredients_raw: Column, steps_raw: Column, times_json: Column) -> Column:
    parts = [F.coalesce(url, F.lit("")), title, F.array_join(ingredients_raw, "|"), F.array_join(steps_raw, "|"), times_json]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def normalise(docs: DataFrame) -> DataFrame:
    """Canonical recipes from crawl records (url, text, title, times, ingredients, categories).

    `steps` and `servings` are used where docs has them; otherwise the first MAX_STEPS
    non-blank lines of the text stand in for steps. Rows without url are left out.
    """
    none = F.array().cast("array<string>")
    full = lambda c: F.filter(F.coalesce(c, none), lambda x: x.isNotNull() & (x != ""))
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), _trim), lambda x: x != "")
    steps = F.slice(lines, F.lit(1), F.lit(MAX_STEPS))
    if "steps" in docs.columns:
        steps = F.when(F.col("steps").isNotNull(), full(F.col("steps"))).otherwise(steps)
    title = F.coalesce(F.nullif(_trim(F.coalesce(F.col("title"), F.lit(""))), F.lit("")), F.lit(UNTITLED))
    base = docs.filter(F.col("url").isNotNull()).withColumns({
        "title": title, "steps_raw": steps, "ingredients_raw": full(F.col("ingredients")),
        "categories": F.filter(F.transform(F.coalesce(F.col("categories"), none), _trim), lambda c: c != ""),
        "text": F.coalesce(F.col("text"), F.lit("")),
    })
    base = base.withColumn("normalized_ingredients", ingredients(F.col("ingredients_raw")))
    names = F.transform("normalized_ingredients", lambda i: F.coalesce(i["name"], F.lit("")))
    haystack = F.concat_ws(" ", F.col("text"), F.array_join("steps_raw", " "), F.array_join("categories", " "))
    base = base.withColumns({
        "ingredient_tokens": ingredient_tokens(F.col("normalized_ingredients")), "appliance_tags": appliance_tags(haystack),
        "_diet": dietary(F.col("title"), F.col("categories"), names, F.size("normalized_ingredients") > 0),
        "_times": F.coalesce(F.to_json("times"), F.lit("{}")),
    })
    count = F.size("normalized_ingredients")
    mean = F.when(count > 0, F.aggregate("normalized_ingredients", F.lit(0.0), lambda a, i: a + i["confidence"]) / count).otherwise(0.0)
    some_time = F.lit(False)
    for c in ("totalMinutes", "prepMinutes", "cookMinutes"):
        some_time = some_time | (F.coalesce(F.col("times")[c], F.lit(0)) != 0)
    sure = {
        "title": F.when(F.col("title") == UNTITLED, 0.0).otherwise(0.95), "ingredients": mean, "times": F.when(some_time, 0.85).otherwise(0.0),
        "appliance_tags": F.when(F.size("appliance_tags") > 0, 0.8).otherwise(0.0), "dietary_tags": F.col("_diet.confidence"),
    }
    missing = {"ingredients": F.size("ingredients_raw") == 0, "times": ~some_time, "appliance_tags": F.size("appliance_tags") == 0, "dietary_tags": F.size("_diet.tags") == 0}
    reasons = F.map_from_entries(F.array_compact(F.array(*[F.when(missing[k], F.struct(F.lit(k).alias("key"), F.array(F.lit(v)).alias("value"))) for k, v in REASONS.items()])))
    digest = source_hash(F.col("url"), F.col("title"), F.col("ingredients_raw"), F.col("steps_raw"), F.col("_times"))
    base = base.withColumn("source_hash", digest)
    null = F.lit(None).cast("string")
    optional = lambda c: F.col(c).cast("string") if c in docs.columns else null
    return base.select(
        F.concat(slugify(F.col("title")), F.lit("-"), F.substring("source_hash", 1, 12)).alias("recipe_id"), F.col("url").alias("source_url"),
        "title", "text", "ingredients_raw", "steps_raw",
        F.struct(F.col("times.totalMinutes").alias("total_minutes"), F.col("times.prepMinutes").alias("prep_minutes"), F.col("times.cookMinutes").alias("cook_minutes")).alias("times"),
        optional("servings").alias("servings"), "categories", "ingredient_tokens", "appliance_tags", F.col("_diet.tags").alias("dietary_tags"),
        quality_flags(sure).alias("quality_flags"), F.create_map(*[x for k, v in sure.items() for x in (F.lit(k), v)]).alias("extraction_confidence"),
        "normalized_ingredients",
        F.struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("source_hash"), F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
            optional("raw_html_ref").alias("raw_html_ref"), optional("jsonld_blob").alias("jsonld_blob"), reasons.alias("missing_field_reasons"),
        ).alias("extraction_meta"),
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
    )
