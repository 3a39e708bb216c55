"""Pages to candidates, and candidates to facts."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import numbers, rules, text
from granary.functions.text import arrow_udf, bound, plain

VERSION, STATUS = "1.0.0", "needs-review-and-original-wording"
TIMES = "struct<prep_minutes: long, cook_minutes: long, inactive_minutes: long>"
EXTRACTED = (
    f"struct<id: string, name: string, description: string, yield: struct<quantity: double, unit: string>, times: {TIMES}, ingredient_lines: array<string>, "
    "instruction_lines: array<string>, categories: array<string>, nutrition: string>"
)
NOTES = (
    "Verify every extracted fact against the authorized source.",
    "Rewrite expressive instruction and description text; do not publish scraped prose verbatim.",
    "Map ingredient lines, meal type, tags, allergens, and dietary fields to the repository schema.",
)


def _list(value: object) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def instruction_lines(value: object) -> list[str]:
    """The plain texts of steps in any nesting: texts, objects with a text, lists of elements."""
    found, todo = [], _list(value)[::-1]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            found.append(item)
        elif isinstance(item, dict) and item.get("text"):
            found.append(item["text"])
        elif isinstance(item, dict) and isinstance(item.get("itemListElement"), list):
            todo += item["itemListElement"][::-1]
    return [x for x in map(plain, found) if x]


def _minutes(value: object) -> int:
    m = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?)?", str(value or ""), re.I)
    return sum(int(g or 0) * n for g, n in zip(m.groups(), (1440, 60, 1), strict=True)) if m else 0


def _yield(value: object) -> dict:
    m = re.search(r"([\d.]+)(?:\s*[-–]\s*[\d.]+\+?)?\s*(.*)", str(_list(value)[0] if _list(value) else ""))
    try:
        quantity = float(m[1]) if m else 1.0
    except ValueError:
        quantity = 1.0
    return {"quantity": quantity or 1.0, "unit": plain(m[2] if m else "") or "servings"}


def _ascii(name: str) -> str:
    folded = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", name)).lower()
    return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", folded))[:90] or "recipe"


def extracted_of(node: dict) -> dict:
    """The extracted part of a candidate from a recipe node."""
    name = plain(node.get("name")) or "Untitled recipe"
    prep, cook, total = (_minutes(node.get(k)) for k in ("prepTime", "cookTime", "totalTime"))
    kinds = [v for k in ("recipeCategory", "recipeCuisine", "keywords") for v in (_list(node.get(k)) or [""])]
    categories = [plain(part) for v in kinds for part in str(v or "").split(",")]
    nutrition = node.get("nutrition")
    return {
        "id": _ascii(name), "name": name, "description": plain(node.get("description")), "yield": _yield(node.get("recipeYield")),
        "times": {"prep_minutes": prep, "cook_minutes": cook, "inactive_minutes": max(0, total - prep - cook)},
        "ingredient_lines": [x for x in map(plain, _list(node.get("recipeIngredient") or node.get("ingredients"))) if x],
        "instruction_lines": instruction_lines(node.get("recipeInstructions")),
        "categories": list(dict.fromkeys(x for x in categories if x)),
        "nutrition": json.dumps(nutrition, ensure_ascii=False) if nutrition else None,
    }


def _extracted(nodes: pd.Series) -> pd.Series:
    return nodes.map(lambda v: None if v is None else json.dumps(extracted_of(json.loads(v)), ensure_ascii=False))


def normalized(node: Column) -> Column:
    """extracted_of() of a JSON node."""
    return F.from_json(arrow_udf(_extracted, "string")(node), EXTRACTED)


def nodes_of(html: Column) -> Column:
    """Recipe nodes of a page: those of its JSON-LD, or else its microdata record."""
    linked, marked = text.json_ld(html), text.microdata(html)
    return F.when(F.size(linked) > 0, linked).when(marked.isNotNull(), F.array(marked)).otherwise(F.array().cast("array<string>"))


def candidates(pages: DataFrame, site: Column, retrieved_at: Column) -> DataFrame:
    """A candidate for every recipe node of pages (url, html)."""
    found = pages.select("url", site.alias("site"), retrieved_at.alias("retrieved_at"), F.explode(nodes_of(F.col("html"))).alias("node"))
    return found.select(
        F.lit(VERSION).alias("candidate_version"), F.lit(STATUS).alias("review_status"),
        F.struct(F.col("site").alias("name"), "url", "retrieved_at").alias("source"), normalized(F.col("node")).alias("extracted"),
        F.array(*map(F.lit, NOTES)).alias("review_notes"),
    )


#: Nutrients of a candidate by a finished record's key, with their unit. Fixed values.
NUTRITION_KEYS = {
    "calories": ("calories", "kcal"), "protein_g": ("proteinContent", "g"), "carbohydrates_g": ("carbohydrateContent", "g"), "fat_g": ("fatContent", "g"), "fiber_g": ("fiberContent", "g"),
    "sugar_g": ("sugarContent", "g"), "sodium_mg": ("sodiumContent", "mg"),
}


def _join(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " ")


def nutrition_texts(amounts: Column) -> Column:
    """A map from a candidate's nutrient to its amount with unit, from a map of numbers as texts."""
    found = [F.struct(F.lit(name).alias("k"), F.concat(F.try_element_at(amounts, F.lit(key)), F.lit(f" {unit}")).alias("v")) for key, (name, unit) in NUTRITION_KEYS.items()]
    return F.map_from_entries(F.filter(F.array(*found), lambda e: e["v"].isNotNull()))


def as_candidate(record: Column) -> Column:
    """A finished record (struct) in a candidate's shape: steps in their order, ingredients as lines, distinct categories."""
    line = lambda i: _join(i["quantity"], i["unit"], i["item"], F.when(F.coalesce(i["preparation"], F.lit("")) != "", F.concat(F.lit("("), i["preparation"], F.lit(")"))))
    steps = F.array_sort(record["instructions"], lambda a, b: (a["step"] - b["step"]).cast("int"))
    kinds = F.concat(F.array(record["meal_type"], record["cuisine"]), F.coalesce(record["tags"], F.array().cast("array<string>")))
    return F.struct(
        F.lit(VERSION).alias("candidate_version"), F.lit("archive-recipe").alias("review_status"),
        F.struct(F.coalesce(record["source"]["name"], F.lit("Archive")).alias("name"), record["source"]["url"].alias("url")).alias("source"),
        F.struct(
            record["id"].alias("id"), record["name"].alias("name"), record["description"].alias("description"), record["yield"].alias("yield"), record["times"].alias("times"),
            F.transform(record["ingredients"], line).alias("ingredient_lines"), F.transform(steps, lambda s: s["text"]).alias("instruction_lines"),
            F.array_distinct(F.filter(kinds, lambda x: x.isNotNull() & (x != ""))).alias("categories"), nutrition_texts(record["nutrition"]).alias("nutrition"),
        ).alias("extracted"),
    )


def _kept(lines: Column) -> Column:
    return F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def facts(extracted: Column) -> Column:
    """A candidate's facts (struct): parsed ingredients, one operation a clause, types, flags, and whether it is complete."""

    def listed(e: Column) -> Column:
        tags = F.filter(F.coalesce(e["categories"], F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
        return F.struct(
            e["name"].alias("name"), e["yield"].alias("yield"), e["times"].alias("times"), tags.alias("tags"),
            numbers.parse_lines(_kept(e["ingredient_lines"])).alias("ingredients"), _kept(e["instruction_lines"]).alias("steps"),
        )

    def made(e: Column) -> Column:
        tags, steps, items = e["tags"], e["steps"], F.transform(e["ingredients"], lambda i: i["item"])
        name, quantity = F.trim(F.coalesce(e["name"], F.lit(""))), F.coalesce(e["yield"]["quantity"], F.lit(0.0))
        complete = (name != "") & (F.size(e["ingredients"]) >= 2) & (F.size(steps) >= 1) & (quantity > 0)
        minutes = lambda k: F.greatest(F.lit(0), F.coalesce(e["times"][k], F.lit(0))).cast("long").alias(k)
        reason = F.when(complete, F.lit("Facts extracted deterministically from structured candidate fields.")).otherwise(
            F.lit("Candidate is missing a title, yield, two ingredients, or cooking instructions.")
        )
        return F.struct(
            F.when(complete, F.lit("usable")).otherwise(F.lit("skip")).alias("status"), reason.alias("reason"), name.alias("base_name"),
            rules.meal_type(F.concat_ws(" ", F.coalesce(e["name"], F.lit("")), F.array_join(tags, " "))).alias("meal_type"), rules.cuisine_of(tags).alias("cuisine"),
            F.struct(quantity.alias("quantity"), F.coalesce(e["yield"]["unit"], F.lit("")).alias("unit")).alias("yield"),
            F.struct(*[minutes(k) for k in ("prep_minutes", "cook_minutes", "inactive_minutes")]).alias("times"),
            e["ingredients"].alias("ingredients"), bound(rules.named_by(items), lambda named: rules.operations(rules.clauses(steps), named)).alias("operations"),
            tags.alias("tags"), rules.safety_flags(items, steps).alias("safety_flags"),
        )

    return bound(bound(extracted, listed), made)  # the JSON and the items are made once, not once for each use or clause
