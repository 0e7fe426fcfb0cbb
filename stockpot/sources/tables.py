"""Relational sink: five tables of canonical recipes, replaced by source_url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_nullable
from ..lineage import staged

TAG_TYPES = ("appliance", "dietary", "category")


def recipes_table(recipes: DataFrame) -> DataFrame:
    meta = F.col("extraction_meta")
    return recipes.select(
        "recipe_id", "source_url", "title", "ingredients_raw", "steps_raw", F.col("times.total_minutes").alias("total_minutes"),
        F.col("times.prep_minutes").alias("prep_minutes"), F.col("times.cook_minutes").alias("cook_minutes"), clean_nullable(F.col("servings")).alias("servings"),
        "categories", "ingredient_tokens", "appliance_tags", "dietary_tags", "quality_flags", F.to_json("extraction_confidence").alias("extraction_confidence"),
        meta["raw_html_ref"].alias("raw_html_ref"), meta["jsonld_blob"].alias("jsonld_blob"), meta["extractor_version"].alias("extractor_version"),
        F.concat_ws(" ", "title", F.array_join("ingredients_raw", " "), F.array_join("steps_raw", " ")).alias("search_document"),
        "created_at", "updated_at",
    )


def ingredients_table(recipes: DataFrame) -> DataFrame:
    rows = recipes.select("recipe_id", F.posexplode("normalized_ingredients").alias("position", "i"))
    return rows.select("recipe_id", "position", F.col("i.raw").alias("raw_text"), clean_nullable(F.col("i.name")).alias("normalized_name"), F.col("i.quantity").alias("quantity"), clean_nullable(F.col("i.unit")).alias("unit"), F.col("i.confidence").cast("float").alias("confidence"))


def tags_table(recipes: DataFrame) -> DataFrame:
    """Distinct lower-cased tags with the confidence of their kind."""
    sure = F.col("extraction_confidence")
    kinds = {"appliance": ("appliance_tags", sure["appliance_tags"]), "dietary": ("dietary_tags", sure["dietary_tags"]), "category": ("categories", F.lit(1.0))}
    parts = [recipes.select("recipe_id", F.lit(kind).alias("tag_type"), F.explode(column).alias("tag"), F.coalesce(c, F.lit(1.0)).alias("confidence")) for kind, (column, c) in kinds.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("recipe_id", "tag_type", F.lower("tag").alias("tag")).agg(F.max("confidence").cast("float").alias("confidence"))


def steps_table(recipes: DataFrame) -> DataFrame:
    return recipes.select("recipe_id", F.posexplode("steps_raw").alias("position", "step_text"))


def meta_table(recipes: DataFrame) -> DataFrame:
    meta = F.col("extraction_meta")
    has = {f.name for f in recipes.schema["extraction_meta"].dataType.fields}
    status = F.to_json(meta["fallback_status"]) if "fallback_status" in has else F.lit("{}")
    cache = meta["llm_cache_key"] if "llm_cache_key" in has else F.lit(None).cast("string")
    return recipes.select("recipe_id", meta["schema_version"].alias("schema_version"), F.to_json("extraction_confidence").alias("extraction_confidence"), F.to_json(meta["missing_field_reasons"]).alias("missing_field_reasons"), status.alias("fallback_status"), meta["source_hash"].alias("source_hash"), cache.alias("llm_cache_key"), "created_at", "updated_at")


TABLES = {"recipes": recipes_table, "recipe_ingredients": ingredients_table, "recipe_tags": tags_table, "recipe_steps": steps_table, "recipe_extraction_meta": meta_table}


def check_tags(tags: DataFrame) -> None:
    """Fail on a tag of an unknown kind."""
    bad = tags.filter(~F.col("tag_type").isin(*TAG_TYPES)).first()
    if bad is not None:
        raise ValueError(f"unknown tag_type {bad['tag_type']!r}")


def relational(recipes: DataFrame) -> dict[str, DataFrame]:
    """The five tables of the recipes; of several with one source_url the smallest recipe_id counts."""
    from ..operators.counting import by_key
    from ..operators.index import first_per_key

    # Whole recipes are shuffled only where several have one source_url.
    single, several = by_key(recipes, "source_url")
    one = single.unionByName(first_per_key(several, "source_url", [F.col("recipe_id")]))
    return {name: make(one) for name, make in TABLES.items()}


def replaced(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Old tables without the recipes whose source_url comes again, and the new rows. Children go with their recipe."""
    again = old["recipes"].join(new["recipes"].select("source_url"), "source_url", "left_semi").select("recipe_id")
    gone = again.union(new["recipes"].select("recipe_id")).distinct()
    return {name: old[name].join(gone, "recipe_id", "left_anti").unionByName(rows) for name, rows in new.items()}


def write(recipes: DataFrame, folder: str, old: str | None = None) -> dict[str, int]:
    """Write the tables to a new folder, merged with those in the folder `old` if given; {"written": recipes}."""
    spark = recipes.sparkSession
    new = relational(staged(recipes))  # five tables from one normalisation
    check_tags(new["recipe_tags"])
    out = replaced({n: spark.read.parquet(f"{old}/{n}") for n in TABLES}, new) if old else new
    for name, rows in out.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")
    return {"written": new["recipes"].count()}


def write_jdbc(tables: dict[str, DataFrame], url: str, properties: dict[str, str]) -> None:
    """Append the tables over JDBC, arrays as JSON text; the driver jar is the session's."""
    for name, rows in tables.items():
        flat = rows.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])
        flat.write.jdbc(url, name, mode="append", properties=properties)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of each table, by name."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionAll(one)
    return out.orderBy("table_name")


def recent(rows: DataFrame, order: str, key: str, limit: int) -> DataFrame:
    """The latest rows by `order`, ties by key."""
    return rows.orderBy(F.desc(order), key).limit(limit)


def sample_to_tables(spark: SparkSession, docs: DataFrame, folder: str, limit: int = 25) -> dict[str, int]:
    """Normalise and write the first `limit` stored documents that have a url."""
    from ..functions.recipes import normalise

    return write(normalise(docs.filter("url IS NOT NULL").orderBy("url").limit(limit)), folder)
