"""A reader's own document: plans, cookbooks, preferences and imported records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import bound, json_object
from granary.operators.search import last_wins

VERSION = "1.0.0"
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
ITEM = "struct<id: string, recipe_id: string, day: string, position: int, target_servings: double>"
FILTERS = "struct<meal_type: string, season: string, dietary: string>"
DOCUMENT = (
    f"struct<schema_version: string, preferences: struct<dietary: array<string>, filters: {FILTERS}>, meal_plans: array<struct<id: string, name: string, items: array<{ITEM}>>>, "
    "cookbooks: array<struct<id: string, name: string, recipe_ids: array<string>>>, imported_recipes: array<string>>"
)


def empty_document() -> Column:
    """One plan without items, nothing else, every filter on "all"."""
    everything = F.struct(*[F.lit("all").alias(k) for k in ("meal_type", "season", "dietary")])
    plan = F.struct(F.lit("weekly-plan").alias("id"), F.lit("Weekly meal plan").alias("name"), F.array().cast(f"array<{ITEM}>").alias("items"))
    return F.struct(
        F.lit(VERSION).alias("schema_version"), F.struct(F.array().cast("array<string>").alias("dietary"), everything.alias("filters")).alias("preferences"), F.array(plan).alias("meal_plans"),
        F.array().cast("array<struct<id: string, name: string, recipe_ids: array<string>>>").alias("cookbooks"), F.array().cast("array<string>").alias("imported_recipes"),
    ).cast(DOCUMENT)


def _is(value: Column, path: str, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit(kind))


def _kinds(value: Column, kinds: dict[str, str]) -> Column:
    def of(v: Column) -> Column:
        out = F.lit(True)
        for path, kind in kinds.items():
            out = out & F.coalesce(_is(v, path, kind), F.lit(False))
        return out

    return bound(value, of)


def is_recipe(json: Column) -> Column:
    """JSON of a record: id, name, meal type, yield and times are there (and neither empty, 0 nor false), ingredients, instructions and tags are arrays."""

    def of(text: Column) -> Column:
        there = F.lit(True)
        for field in ("id", "name", "meal_type", "yield", "times"):
            there = there & ~F.coalesce(F.get_json_object(text, f"$.{field}"), F.lit("")).isin("", "0", "false", "null")
        return F.coalesce(there & _kinds(json_object(text), {f"$.{f}": "ARRAY" for f in ("ingredients", "instructions", "tags")}), F.lit(False))

    return bound(json, of)


def is_document(json: Column) -> Column:
    """JSON of a document of this version with plans (each with id, name and items), cookbooks, preferences and imports."""
    value = json_object(json)
    shape = _kinds(value, {
        "$.preferences": "OBJECT", "$.preferences.dietary": "ARRAY", "$.preferences.filters": "OBJECT", "$.preferences.filters.meal_type": "STRING", "$.preferences.filters.season": "STRING",
        "$.preferences.filters.dietary": "STRING", "$.meal_plans": "ARRAY", "$.cookbooks": "ARRAY", "$.imported_recipes": "ARRAY",
    })
    plans = F.from_json(F.get_json_object(json, "$.meal_plans"), "array<string>")
    each = F.forall(F.coalesce(plans, F.array().cast("array<string>")), lambda p: F.coalesce(_kinds(F.try_parse_json(p), {"$.id": "STRING", "$.name": "STRING", "$.items": "ARRAY"}), F.lit(False)))
    return F.coalesce((F.get_json_object(json, "$.schema_version") == VERSION) & shape & each, F.lit(False))


def migrated(plan_json: Column, recipes_json: Column) -> Column:
    """A document from the texts of the two older stores: a day's record ids, and imported records."""
    plan, imports = F.from_json(plan_json, "map<string, array<string>>"), F.from_json(recipes_json, "array<string>")

    def of_day(day: str) -> Column:
        ids = F.coalesce(F.try_element_at(plan, F.lit(day)), F.array().cast("array<string>"))
        item = lambda r, i: F.struct(
            F.concat(F.lit(f"{day.lower()}-"), i.cast("string"), F.lit("-"), r).alias("id"), r.alias("recipe_id"), F.lit(day).alias("day"), i.alias("position"), F.lit(None).cast("double").alias("target_servings")
        )
        return F.transform(ids, item)

    items = F.concat(*[of_day(d) for d in DAYS]).cast(f"array<{ITEM}>")
    with_items = _first_plan(empty_document(), lambda p: p.withField("items", items))
    return with_items.withField("imported_recipes", F.coalesce(imports, F.array().cast("array<string>")))


def read_document(current: Column, plan_json: Column, recipes_json: Column) -> Column:
    """The stored document if it is one, with records that are; else one from the older stores; else an empty one."""
    older = F.coalesce(plan_json, recipes_json).isNotNull() & current.isNull()

    def of(stored: Column) -> Column:
        good = is_document(current) & F.forall(F.coalesce(stored["imported_recipes"], F.array().cast("array<string>")), is_recipe)
        return F.when(F.coalesce(good, F.lit(False)), stored).when(older, migrated(plan_json, recipes_json)).otherwise(empty_document())

    return bound(F.from_json(current, DOCUMENT), of)


def _first_plan(document: Column, change) -> Column:
    """The document is bound, as withField() names it once for each of its fields, and changes may follow one another."""
    return bound(document, lambda d: d.withField("meal_plans", F.transform(d["meal_plans"], lambda p, i: F.when(i == 0, change(p)).otherwise(p))))


def added(document: Column, id_: Column, recipe_id: Column, day: Column, servings: Column) -> Column:
    """An item at the end of a day of the first plan."""

    def change(plan: Column) -> Column:
        place = F.size(F.filter(plan["items"], lambda i: i["day"] == day))
        item = F.struct(id_.alias("id"), recipe_id.alias("recipe_id"), day.alias("day"), place.alias("position"), servings.cast("double").alias("target_servings"))
        return plan.withField("items", F.concat(plan["items"], F.array(item)))

    return _first_plan(document, change)


def removed(document: Column, id_: Column) -> Column:
    """Without an item of the first plan; other plans stay."""
    return _first_plan(document, lambda p: p.withField("items", F.filter(p["items"], lambda i: i["id"] != id_)))


def cleared(document: Column) -> Column:
    return _first_plan(document, lambda p: p.withField("items", F.array().cast(f"array<{ITEM}>")))


def with_filters(document: Column, **filters: Column) -> Column:
    """Filters that are named and not null replace the old ones."""
    replaced = lambda name, value: lambda d: d.withField(f"preferences.filters.{name}", F.coalesce(value, d["preferences"]["filters"][name]))
    for name, value in filters.items():
        document = bound(document, replaced(name, value))
    return document


def imported(document: Column, json: Column) -> Column:
    """The document with the records of an imported text: one, an array, or a catalog of them; of equal ids the last one
    counts, in the first one's place. A text of a document takes its place. Null where any record is not one."""

    def merged(all_: Column) -> Column:
        ids = F.array_distinct(F.transform(all_, lambda r: F.get_json_object(r, "$.id")))
        return F.transform(ids, lambda i: F.element_at(F.filter(all_, lambda r: F.get_json_object(r, "$.id") == i), -1))

    def taken(p: Column) -> Column:
        both = bound(F.concat(p["document"]["imported_recipes"], p["listed"]), merged)
        return F.when(F.forall(p["listed"], is_recipe), p["document"].withField("imported_recipes", both))

    listed = F.coalesce(F.from_json(F.get_json_object(json, "$.recipes"), "array<string>"), F.from_json(json, "array<string>"), F.array(json))
    whole = bound(F.from_json(json, DOCUMENT), lambda w: F.when(F.forall(w["imported_recipes"], is_recipe), w))
    return F.when(is_document(json), whole).otherwise(bound(F.struct(document.alias("document"), listed.alias("listed")), taken))


def library(built_in: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """Built-in and own records by key: an own one counts, in the place of the first."""
    both = built_in.withColumn("place", F.struct(F.lit(0).alias("own"), F.col(key).alias("k"))).unionByName(own.withColumn("place", F.struct(F.lit(1).alias("own"), F.col(key).alias("k"))))
    return last_wins(both, key, "place").drop("place", "first_at")
