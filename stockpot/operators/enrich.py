"""Enrichment of weakly extracted recipes by an outside model, with a cache and a checked contract."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..shipping import small_batches

TAG_CAP, PROMPT_STEPS = 12, 12
Client = Callable[[str], object]
OUTPUT = "appliance_tags array<string>, dietary_tags array<string>, ingredient_normalizations array<struct<raw:string,name:string,quantity:double,unit:string>>"


def tag_list(values: Column) -> Column:
    """Lower-cased, trimmed, non-empty tags: the first TAG_CAP, then distinct."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(F.lower(v))), lambda v: v != "")
    return F.array_distinct(F.slice(clean, F.lit(1), F.lit(TAG_CAP)))


def needed_fields(recipes: DataFrame) -> Column:
    """Fields whose values or confidence are too weak."""
    sure = lambda k: F.coalesce(F.col("extraction_confidence")[k], F.lit(0.0))
    weak = {
        "appliance_tags": (F.size("appliance_tags") == 0) | (sure("appliance_tags") < 0.5),
        "dietary_tags": (F.size("dietary_tags") == 0) | (sure("dietary_tags") < 0.7),
        "ingredient_normalizations": (F.size("ingredient_tokens") == 0) | (sure("ingredients") < 0.65),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in weak.items()]))


def validated(answer: object) -> dict | None:
    """The parts of an answer that fit the contract; None if nothing does."""
    if not isinstance(answer, dict):
        return None
    out: dict = {}
    for field in ("appliance_tags", "dietary_tags"):
        if isinstance(answer.get(field), list):
            tags = [t for v in answer[field] if (t := str(v if v is not None else "").lower().strip())]
            out[field] = list(dict.fromkeys(tags[:TAG_CAP]))
    rows = answer.get("ingredient_normalizations")
    good = [_ingredient(r) for r in rows if isinstance(r, dict) and r.get("raw") and r.get("name")] if isinstance(rows, list) else []
    if good:
        out["ingredient_normalizations"] = good
    return out or None


def _ingredient(row: dict) -> dict:
    number, unit = row.get("quantity"), row.get("unit")
    is_number = isinstance(number, int | float) and not isinstance(number, bool)
    return {"raw": str(row["raw"]), "name": str(row["name"]).lower().strip(), "quantity": float(number) if is_number else None, "unit": unit.lower().strip() if isinstance(unit, str) else None}


def prompt(recipe: DataFrame) -> Column:
    return F.concat_ws("\n", F.lit("Fill in missing index fields of a recipe. Answer with JSON: appliance_tags, dietary_tags, ingredient_normalizations of raw, name, quantity, unit."), F.concat(F.lit("fields: "), F.array_join("_fields", ", ")), F.concat(F.lit("title: "), F.col("title")), F.concat(F.lit("ingredients: "), F.array_join("ingredients_raw", " | ")), F.concat(F.lit("steps: "), F.array_join(F.slice("steps_raw", 1, PROMPT_STEPS), " | ")))


def enrich(recipes: DataFrame, make_client: Callable[[], Client] | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(recipes with answers applied, new cache(cache_key, answer)).

    Only recipes with weak fields are asked about, each cache key once, and only if the
    cache has no valid answer; without a client nothing is asked. Answers arrive as JSON or objects.
    """
    small_batches(recipes.sparkSession)
    rows = recipes.withColumn("_fields", needed_fields(recipes))
    rows = cut(rows.withColumn("_key", F.when(F.size("_fields") > 0, F.concat(F.col("extraction_meta.source_hash"), F.lit("-"), F.array_join("_fields", "_")))))
    known = cache.select(F.col("cache_key").alias("_key"), "answer") if cache is not None else rows.sparkSession.createDataFrame([], "_key string, answer string")
    check = _answers(None)
    known = cut(known.dropDuplicates(["_key"]).withColumn("_a", check("answer")).filter("_a IS NOT NULL"))
    asked = rows.filter("_key IS NOT NULL").join(known.select("_key"), "_key", "left_anti").dropDuplicates(["_key"]).select("_key", prompt(rows).alias("_prompt"))
    fresh = cut(asked.withColumn("_a", _answers(make_client)("_prompt")).filter("_a IS NOT NULL").select("_key", F.to_json("_a").alias("answer"), "_a")) if make_client else known.filter("false")
    answers = known.select("_key", "_a", F.lit(True).alias("_hit")).unionByName(fresh.select("_key", "_a", F.lit(False).alias("_hit")))
    return _apply(rows.join(answers, "_key", "left"), recipes.columns), fresh.select(F.col("_key").alias("cache_key"), "answer")


def _answers(make_client: Callable[[], Client] | None):
    kind = pa.struct([("appliance_tags", pa.list_(pa.string())), ("dietary_tags", pa.list_(pa.string())), ("ingredient_normalizations", pa.list_(pa.struct([("raw", pa.string()), ("name", pa.string()), ("quantity", pa.float64()), ("unit", pa.string())])))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = make_client() if make_client else lambda x: x
        for batch in batches:
            yield pa.array([_one(ask(x)) if x is not None else None for x in batch.to_pylist()], kind)

    return F.arrow_udf(run, f"struct<{OUTPUT.replace(' array', ': array')}>")


def _one(answer: object) -> dict | None:
    if isinstance(answer, str):
        try:
            answer = json.loads(answer)
        except ValueError:
            return None
    return validated(answer)


def _apply(rows: DataFrame, columns: list[str]) -> DataFrame:
    wants = lambda f: F.array_contains("_fields", f)
    some = lambda f: wants(f) & (F.coalesce(F.size(F.col("_a")[f]), F.lit(0)) > 0)
    sure = F.col("extraction_confidence")
    at_least = {"appliance_tags": ("appliance_tags", 0.82), "dietary_tags": ("dietary_tags", 0.8), "ingredients": ("ingredient_normalizations", 0.8)}
    raised = F.transform_values(sure, lambda k, v: _raised(k, v, at_least, some))
    patches = F.coalesce(F.col("_a.ingredient_normalizations"), F.array().cast("array<struct<raw:string,name:string,quantity:double,unit:string>>"))

    def patch(i: Column) -> Column:
        # The last patch of a line counts.
        mine = F.try_element_at(F.filter(patches, lambda p: F.lower(F.trim(p["raw"])) == F.lower(F.trim(i["raw"]))), F.lit(-1))
        fixed = F.struct(i["raw"].alias("raw"), F.coalesce(F.nullif(mine["name"], F.lit("")), i["name"]).alias("name"), F.coalesce(mine["quantity"], i["quantity"]).alias("quantity"), F.coalesce(mine["unit"], i["unit"]).alias("unit"), F.greatest(i["confidence"], F.lit(0.8)).alias("confidence"))
        return F.when(mine.isNotNull(), fixed).otherwise(i)

    tags = lambda f: F.when(some(f), tag_list(F.concat(F.col(f), F.col("_a")[f]))).otherwise(F.col(f))
    status = F.struct((F.size("_fields") > 0).alias("required"), F.col("_fields").alias("fields"), (F.size("_fields") > 0).alias("executed"), F.coalesce(F.col("_hit"), F.lit(False)).alias("cache_hit"), F.col("_a").isNotNull().alias("validated"))
    out = rows.withColumn("_ings", F.when(some("ingredient_normalizations"), F.transform("normalized_ingredients", patch)).otherwise(F.col("normalized_ingredients")))
    every = F.flatten(F.transform("_ings", lambda i: F.split(F.lower(F.coalesce(i["name"], F.lit(""))), "\\s+")))
    tokens = F.array_distinct(F.filter(every, lambda w: F.rlike(w, F.lit("^[a-z]{3,}$"))))
    out = out.withColumns({
        "ingredient_tokens": F.when(some("ingredient_normalizations"), tokens).otherwise(F.col("ingredient_tokens")),
        "extraction_confidence": raised, "appliance_tags": tags("appliance_tags"), "dietary_tags": tags("dietary_tags"),
        "extraction_meta": F.col("extraction_meta").withField("fallback_status", status).withField("llm_cache_key", F.col("_key")),
        "updated_at": F.when(F.col("_a").isNotNull(), F.current_timestamp()).otherwise(F.col("updated_at")),
    }).withColumn("normalized_ingredients", F.col("_ings"))
    return out.select(*columns)


def _raised(key: Column, value: Column, at_least: dict[str, tuple[str, float]], some) -> Column:
    out = value
    for name, (field, least) in at_least.items():
        out = F.when((key == name) & some(field), F.greatest(value, F.lit(least))).otherwise(out)
    return out
