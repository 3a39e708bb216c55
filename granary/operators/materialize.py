"""Authored drafts to finished records, with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import numbers, rules, text
from granary.functions.text import bound
from granary.operators import resolve

SCHEMA_VERSION = "1.0.0"
LINE = "struct<ingredient_id: string, item: string, quantity: struct<num: double, raw: string>, unit: string, preparation: string, optional: boolean>"


def given(value: Column) -> Column:
    """A trimmed text; null where it is empty, so that JSON leaves it out."""
    return F.nullif(F.trim(F.coalesce(value, F.lit(""))), F.lit(""))


def given_array(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def _distinct(values: Column) -> Column:
    return F.array_distinct(F.coalesce(values, F.array().cast("array<string>")))


def materialized(drafts: DataFrame, known: DataFrame, taken: DataFrame, day: Column) -> DataFrame:
    """(key, record) of drafts (key, source, draft, ingredients); of drafts with the same title the first key gets it as its id.

    source: struct of name and url; draft: the authored record (struct); ingredients: the facts' ones, which win over
    the draft's where there are any. known: ingredient records (id, name, aliases), of equal names the last id counts;
    taken: ids (id) that are used already. Steps are numbered anew, allergens are the declared and the inferred ones,
    diets they contradict go, and empty texts and arrays are null.
    """
    lines = F.when(F.size("ingredients") > 0, F.col("ingredients")).otherwise(F.col("draft.ingredients"))
    placed = drafts.select("key", "source", "draft", lines.alias("lines"))
    index = resolve.alias_index(known, "id", ["name"], ["aliases"]).groupBy("key").agg(F.max("id").alias("ingredient_id"))
    each = placed.select("key", F.posexplode("lines").alias("pos", "i")).withColumn("name_key", text.lookup_key(F.col("i.item")))
    linked = each.join(index.withColumnRenamed("key", "name_key"), "name_key", "left")
    line = F.struct(
        "ingredient_id", F.trim("i.item").alias("item"), numbers.typed_quantity(F.col("i.quantity")).alias("quantity"), given(F.col("i.unit")).alias("unit"),
        given(F.col("i.preparation")).alias("preparation"), F.when(F.col("i.optional"), F.lit(True)).alias("optional"),
    )
    gathered = linked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("placed"))
    base = text.slug(F.col("draft.name"))
    used = taken.select(F.col("id").alias("base")).distinct().withColumn("used", F.lit(True))
    rows = placed.withColumn("base", base).withColumn("tag_slugs", text.import_slugs("draft.tags")).join(used, "base", "left").join(gathered, "key", "left")

    def made(p: Column) -> Column:
        d, found, kept_diets = p["d"], p["found"], p["dietary"]
        steps = F.transform(d["instructions"], lambda s, i: F.struct((i + 1).alias("step"), F.trim(s["text"]).alias("text"), F.nullif(s["timer_minutes"], F.lit(0)).alias("timer_minutes")))
        equipment = F.transform(F.coalesce(d["equipment"], F.array().cast("array<string>")), lambda x: F.trim(x))
        return F.struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"), p["id"].alias("id"), F.trim(d["name"]).alias("name"), given(d["subtitle"]).alias("subtitle"), given(d["description"]).alias("description"),
            d["meal_type"].alias("meal_type"), given(d["cuisine"]).alias("cuisine"),
            F.struct(d["yield"]["quantity"].alias("quantity"), F.coalesce(given(d["yield"]["unit"]), F.lit("servings")).alias("unit")).alias("yield"),
            F.struct(
                d["times"]["prep_minutes"].alias("prep_minutes"), d["times"]["cook_minutes"].alias("cook_minutes"), F.nullif(d["times"]["inactive_minutes"], F.lit(0)).alias("inactive_minutes")
            ).alias("times"),
            F.coalesce(F.transform(p["placed"], lambda x: x["line"]), F.array().cast(f"array<{LINE}>")).alias("ingredients"), steps.alias("instructions"),
            F.filter(_distinct(p["tags"]), lambda t: t != "").alias("tags"), given_array(_distinct(d["seasons"])).alias("seasons"),
            given_array(kept_diets).alias("dietary"), given_array(found).alias("allergens"),
            given_array(F.filter(_distinct(equipment), lambda x: x != "")).alias("equipment"),
            F.struct(p["s"]["name"].alias("name"), p["s"]["url"].alias("url"), F.lit(True).alias("adapted")).alias("source"), day.alias("created_at"), day.alias("updated_at"),
        )

    def with_allergens(p: Column) -> Column:
        foods = F.lower(F.array_join(F.transform(p["lines"], lambda i: F.concat(i["item"], F.lit(" "), F.coalesce(i["preparation"], F.lit("")))), " "))
        return bound(foods, lambda f: p.withField("found", _distinct(F.concat(F.coalesce(p["d"]["allergens"], F.array().cast("array<string>")), rules.allergens(f)))))

    # allergens and diets are found once a row, whatever reads them
    with_diets = lambda p: p.withField("dietary", rules.reconciled_diets(_distinct(p["d"]["dietary"]), p["found"]))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("key"))
    rows = rows.withColumn("id", resolve.unique_id(F.col("base"), F.col("used").isNotNull() | (nth > 1), F.col("source.url")))
    parts = F.struct(F.col("draft").alias("d"), F.col("source").alias("s"), F.col("lines"), F.col("placed"), F.col("id"), F.col("tag_slugs").alias("tags"))
    return rows.select("key", bound(bound(bound(parts, with_allergens), with_diets), made).alias("record"))


def provenance(extracted: Column, record: Column, review: Column, model: str, prompt_version: str, moment: Column, requires_review: bool = False, status: str = "passed") -> Column:
    """The normalization struct of a record; model and version of the prompt must be named."""
    if not model.strip() or not prompt_version.strip():
        raise ValueError("provenance needs a model and a prompt version")
    return F.struct(
        text.source_digest(extracted["description"], extracted["instruction_lines"]).alias("source_text_hash"),
        text.final_digest(record["subtitle"], record["description"], F.transform(record["instructions"], lambda s: s["text"])).alias("normalized_text_hash"),
        F.lit(model.strip()).alias("model"), F.lit(model.strip()).alias("model_version"), F.lit(prompt_version.strip()).alias("prompt_version"), moment.alias("transformed_at"),
        review["semantic_similarity"].alias("semantic_similarity"), review["structural_similarity"].alias("structural_similarity"),
        F.lit(requires_review).alias("requires_review"), F.lit(status).alias("source_review_status"),
    )


def authored(rows: DataFrame, author, schema: str) -> DataFrame:
    """rows through a model-backed function of pandas batches (mapInPandas): any callable stands in for a model. A batch
    that fails is tried again with its task."""
    return rows.mapInPandas(author, schema)
