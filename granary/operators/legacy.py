"""A legacy meal collection as reviewable drafts, with the audit of everything that was inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import numbers, produce, text
from granary.functions.text import bound, lookup_key
from granary.operators import resolve
from granary.sources.stores import kept

#: Source records: ingredients as an array, as the order of a map is lost in tables.
MEALS = (
    "id string, name string, subName string, url string, totalTime string, prepTime string, difficulty string, tags array<string>, nutritionalValues map<string, string>, "
    "ingredients array<struct<name: string, amount: string, unit: string>>, instructions array<struct<order: int, text: string>>"
)
PLACEHOLDER = "REWRITE REQUIRED: Replace source step {} with an original, concise cooking direction before promotion."


def checked_meals(meals: DataFrame) -> DataFrame:
    """meals; an error where an id is missing or not unique."""
    bad = meals.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL OR id = ''")
    problem = bad.agg(F.min(F.coalesce("id", F.lit(""))).alias("id"), F.count(F.lit(1)).alias("bad"))
    message = F.concat(F.lit("every source record needs a unique id; invalid: "), F.col("_bad.id"))
    joined = meals.crossJoin(F.broadcast(problem.select(F.struct("id", "bad").alias("_bad"))))  # one row
    return joined.where(F.when(F.col("_bad.bad") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_bad")


def selected(rows: DataFrame, key: str, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted ids, ids that no row has)."""
    ids = rows.sparkSession.createDataFrame([(w,) for w in wanted], f"{key} string")
    return rows.join(F.broadcast(ids), key, "left_semi"), ids.join(rows, key, "left_anti")


def named_foods(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, item, key, optional, ingredient_id, food, own) of names (name) as the source spells them, each once; food: the
    folded name and seasons of its record; own: its allergens."""
    each = resolve.with_keys(names.distinct()).withColumn("optional", text.is_optional(F.col("name")))
    folded = catalog.select("key", F.col("id").alias("ingredient_id"), "record", lookup_key(F.col("record.name")).alias("folded"))
    food = F.struct(F.col("folded").alias("name"), F.coalesce("record.seasons", F.array().cast("array<string>")).alias("seasons"))
    records = folded.select("key", "ingredient_id", food.alias("food"), F.coalesce("record.allergens", produce.name_allergens(F.col("folded"))).alias("own"))
    return each.join(records, "key", "left").select("name", "item", "key", "optional", "ingredient_id", "food", "own")


def meal_lines(meals: DataFrame, foods: DataFrame) -> DataFrame:
    """(recipe_id, pos, ingredient_id, item, key, num, raw, unit, optional, audit, food, own) of every ingredient of meals by
    named_foods(); audit: names of its problems."""
    each = meals.select(F.col("id").alias("recipe_id"), F.posexplode("ingredients").alias("pos", "i"))
    linked = each.join(foods, F.col("i.name").eqNullSafe(foods["name"]), "left").withColumn("q", numbers.normal_quantity(F.col("i.amount"), F.col("i.unit")))
    seasoning = F.rlike("item", F.lit("(?i)^(?:kosher )?salt$|^(?:black )?pepper$")) & (F.col("q.missing") | F.col("q.malformed"))
    audit = F.array_compact(
        F.array(
            F.when(F.col("q.malformed"), F.lit("malformedMeasurements")), F.when(F.col("q.missing_unit"), F.lit("missingUnits")),
            F.when(seasoning, F.lit("inferredMeasurements")).when(F.col("q.missing"), F.lit("missingMeasurements")),
        )
    )
    raw = F.when(seasoning, F.lit("to taste")).otherwise(F.col("q.raw"))
    return linked.select("recipe_id", "pos", "ingredient_id", "item", "key", F.col("q.num").alias("num"), raw.alias("raw"), F.col("q.unit").alias("unit"), "optional", audit.alias("audit"), "food", "own")


def recipe_ids(meals: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(id, recipe_id): titles' slugs; meals with the same one get the end of their own id after it."""
    slug = text.import_slug(F.col("name"))
    base = F.when(slug != "", slug).otherwise(text.import_slug(F.concat(F.lit("legacy-recipe-"), F.col("id"))))
    return resolve.minted_ids(meals.select("id", base.alias("base")), "id", "base", "id", taken).select("id", F.col("minted_id").alias("recipe_id"))


def transformed(meals: DataFrame, known: DataFrame, southern: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recipes, ingredients, audit) of meals (MEALS) and known ingredient records.

    recipes: source_id, folder and the draft's fields; ingredients: new records (id, record); audit: (category, recipe_id, detail).
    Names are read once each, not once a line: their counts, the catalog and its link to the names are written once.
    """
    usages = meals.select(F.explode("ingredients").alias("i")).select("i.name", "i.unit")
    counts = kept(resolve.counted_usages(usages), "usages")
    catalog = kept(resolve.ingredient_catalog(counts, known, southern), "catalog")
    lines = meal_lines(meals, kept(named_foods(counts.select("name"), catalog), "foods"))
    line = F.struct("ingredient_id", "item", F.struct("num", "raw").alias("quantity"), "unit", F.when(F.col("optional"), F.lit(True)).alias("optional"))
    gathered = lines.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), "food", "own", "key"))).alias("all"))
    per_meal = gathered.select(
        "recipe_id", F.transform("all", lambda x: x["line"]).alias("lines"), F.transform("all", lambda x: x["food"]).alias("foods"),
        F.flatten(F.filter(F.transform("all", lambda x: x["own"]), lambda x: x.isNotNull())).alias("food_allergens"), F.transform("all", lambda x: x["key"]).alias("keys"),
    )
    rows = meals.withColumnRenamed("id", "source_id").join(per_meal.withColumnRenamed("recipe_id", "source_id"), "source_id", "left")
    rows = rows.join(recipe_ids(meals).withColumnRenamed("id", "source_id"), "source_id")
    tag_text = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    steps = F.transform(F.coalesce("instructions", F.array().cast("array<struct<order: int, text: string>>")), lambda s: s["text"])
    title = lookup_key(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("subName", F.lit(""))))
    full = lookup_key(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("subName", F.lit("")), tag_text))
    read = rows.select(
        "*", produce.leading_dish(F.col("name")).alias("dish"), title.alias("title_key"), full.alias("full_key"), steps.alias("step_texts"),
        numbers.inferred_yield(F.concat_ws(" ", F.coalesce("subName", F.lit("")), tag_text)).alias("yielded"),
        numbers.nutrients(F.col("nutritionalValues")).alias("nutrients"), produce.dish_allergens(F.col("tags"), F.col("food_allergens")).alias("allergens"),
    )
    read = read.withColumn("times", numbers.inferred_times(F.col("totalTime"), F.col("prepTime"), F.col("step_texts"))).withColumn("meal_type", produce.dish_type(F.col("dish")))
    read = read.withColumn("dietary", produce.dish_diets(F.col("tags"), F.col("allergens"), F.col("keys")))
    foods = F.filter("foods", lambda f: f["name"].isNotNull())
    read = read.withColumn("seasons", produce.seasons_of_scores(produce.season_scores(F.col("title_key"), F.col("dish"), F.coalesce(foods, F.array().cast("array<struct<name: string, seasons: array<string>>>")))))
    count = F.greatest(F.lit(1), F.size("step_texts"))
    drafts = F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(i.alias("step"), F.replace(F.lit(PLACEHOLDER), F.lit("{}"), i.cast("string")).alias("text")))
    believed = F.filter("nutrients", lambda n: ~n["outlier"])
    has_nutrition = F.size(F.map_keys(F.coalesce("nutritionalValues", F.create_map().cast("map<string, string>")))) > 0
    recipes = read.select(
        "source_id", "recipe_id", produce.folder(F.col("meal_type")).alias("folder"),
        F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Legacy recipe "), F.col("source_id"))).alias("name"), F.nullif("subName", F.lit("")).alias("subtitle"), "meal_type",
        produce.title_cuisine(F.col("full_key")).alias("cuisine"), F.struct("yielded.quantity", "yielded.unit").alias("yield"), F.struct("times.prep_minutes", "times.cook_minutes").alias("times"),
        F.coalesce("lines", F.array()).alias("ingredients"), drafts.alias("instructions"),
        F.when(has_nutrition, F.map_from_entries(F.transform(believed, lambda n: F.struct(n["target"], n["value"])))).alias("nutrition"),
        produce.dish_tags(F.col("meal_type"), F.col("difficulty"), F.col("tags")).alias("tags"), "seasons", "dietary", "allergens",
        produce.equipment(F.array_join("step_texts", " ")).alias("equipment"), F.col("url").alias("source_url"),
    )
    return recipes, catalog.where("is_new").select("id", "record"), _audit(read, meals, lines, catalog, has_nutrition)


def _audit(read: DataFrame, meals: DataFrame, lines: DataFrame, catalog: DataFrame, has_nutrition: Column) -> DataFrame:
    low = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)

    def of(p: Column) -> Column:
        tagged = lambda *t: F.arrays_overlap(p["tags"], F.array(*map(F.lit, t)))
        entry = lambda when, category, detail: F.when(when, F.struct(F.lit(category).alias("category"), detail.alias("detail")))
        none = F.lit(None).cast("string")
        lacks = lambda d: ~F.array_contains(p["dietary"], d)
        return F.array_compact(
            F.array(
                entry(F.size(p["tags"]) == 0, "missingSourceTags", none), entry(F.coalesce(p["sub"], F.lit("")) == "", "missingSubtitles", none),
                entry(text.title_artifact(p["name"]), "titleArtifacts", p["name"]), entry(tagged("vegan") & lacks("vegan"), "dietaryConflicts", F.lit("Vegan")),
                entry(tagged("veggie", "vegetarian") & lacks("vegetarian"), "dietaryConflicts", F.lit("Veggie")),
                entry(tagged("gluten-free", "gluten free") & lacks("gluten-free"), "dietaryConflicts", F.lit("Gluten-free")),
                entry(F.array_contains(p["inferred"], "prep_minutes"), "inferredPrepTime", none), entry(F.array_contains(p["inferred"], "total_minutes"), "inferredTotalTime", none),
                entry(p["assumed"], "assumedYield", none), entry(~p["nutrition"], "missingNutrition", none),
            )
        )

    facts = F.struct(
        low.alias("tags"), F.col("subName").alias("sub"), F.col("name"), F.col("dietary"), F.col("times.inferred").alias("inferred"), F.col("yielded.inferred").alias("assumed"), has_nutrition.alias("nutrition")
    )
    by_meal = read.select(F.col("source_id").alias("recipe_id"), F.explode(bound(facts, of)).alias("a")).select("a.category", "recipe_id", "a.detail")
    by_line = lines.select(F.explode("audit").alias("category"), "recipe_id", F.col("item").alias("detail"))
    # these need no more than the source has; of meals with one title, however many, no task holds all
    extreme = F.explode(F.filter(numbers.nutrients(F.col("nutritionalValues")), lambda n: n["outlier"])).alias("n")
    outliers = meals.select(F.col("id").alias("recipe_id"), extreme).select(F.lit("nutritionOutliers").alias("category"), "recipe_id", F.col("n.nutrient").alias("detail"))
    titles = meals.select(F.col("id").alias("recipe_id"), lookup_key(F.col("name")).alias("title"))
    several = titles.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = titles.join(several, "title", "left_semi").select(F.lit("duplicateTitles").alias("category"), "recipe_id", F.col("title").alias("detail"))
    guessed = catalog.where("fallback_season").select(F.lit("fallbackSeasonIngredients").alias("category"), F.lit(None).cast("string").alias("recipe_id"), F.col("id").alias("detail"))
    return by_meal.union(by_line).union(outliers).union(repeated).union(guessed)


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def promotable(record: Column, tags: Column) -> Column:
    """Neither a placeholder in a record (struct) nor the mark for review among its tags."""
    return ~F.contains(F.to_json(record), F.lit("REWRITE REQUIRED")) & ~F.coalesce(F.array_contains(tags, "needs-review"), F.lit(False))
