"""Imports, drafts, staging, ledgers and resolution over tables: each part is a meal, a draft or a staged record whose columns
say what is wrong with it. They stand in place of records.py's queries of the same names, whose rows are kept for the tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import produce, text, urls
from granary.operators import gates, legacy, materialize, resolve, search, staging
from granary.plans import records
from granary.plans.catalog import _CANONICAL, _dealt, _query, _t
from granary.plans.tables import _pick
from granary.sources import records as sources


def _url() -> Column:
    return F.concat(F.lit("https://shop.example/"), F.col("p_partkey").cast("string"))


def _listed(values: list[str], by: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[1 + {by} % {len(values)}]"


# the legacy import

_DISHES = ["Salad", "Soup", "Cake", "Wrap"]
_FOODS = ["Cheddar Cheese", "Wheat Flour", "Chicken", "Carrot", "Onion", "Kosher Salt"]
#: A meal of each part: brands give tags, sizes the dish and the second food, keys the amounts, times and nutrients.
_MEALS = f"""m AS (SELECT *, 'part-' || lpad(p_partkey::VARCHAR, 8, '0') AS source_id, substr(p_brand, 7)::INT % 4 AS tagged, p_size % 4 AS d, p_size % 6 AS f, p_name LIKE 'red %' AS known,
  p_name || CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_partkey ELSE '' END || ' ' || {_listed(_DISHES, 'p_size')} AS title, {_listed(_FOODS, 'p_size')} AS food FROM part),
t AS (SELECT *, replace(lower(title), ' ', '-') AS base, count(*) OVER (PARTITION BY lower(title)) > 1 AS shared, f = 2 AS meat, CASE f WHEN 0 THEN 'milk' WHEN 1 THEN 'wheat' ELSE '' END AS allergen,
  2 * (p_name LIKE 'cold %')::INT + 3 * known::INT AS warm, 2 * (d = 1)::INT + (f = 3)::INT AS cool FROM m),
x AS (SELECT *, tagged IN (1, 3) AND NOT meat AS veggie, tagged = 1 AND NOT meat AND allergen <> 'milk' AS vegan, tagged = 2 AND allergen <> 'wheat' AS no_gluten FROM t)"""


def _meals(spark, sf_dir):
    key, brand = F.col("p_partkey"), F.substring("p_brand", 7, 9).cast("int") % 4
    name = F.concat_ws(" ", "p_name", F.when(key % 5 == 0, key.cast("string")), _pick(_DISHES, "p_size"))
    tags = F.when(brand == 0, F.array().cast("array<string>")).when(brand == 1, F.array(F.lit("Vegan"))).when(brand == 2, F.array(F.lit("Gluten-free"), F.lit("Spicy"))).otherwise(F.array(F.lit("Veggie")))
    size = F.col("p_size").cast("string")
    fat = (F.col("p_size") * 20).cast("string")
    amounts = F.when(key % 3 == 0, F.create_map().cast("map<string, string>")).when(key % 3 == 1, F.create_map(F.lit("Calories"), size)).otherwise(F.create_map(F.lit("Calories"), F.lit("100"), F.lit("Fat"), fat))
    line = lambda name, amount, unit: F.struct(name.alias("name"), amount.alias("amount"), unit.alias("unit"))
    foods = F.array(
        line(F.col("p_name"), _pick(["2", "1 1/2", "", "unit"], "p_partkey"), _pick(["cups", "cups", "", ""], "p_partkey")),
        line(_pick(_FOODS, "p_size"), F.when(F.col("p_size") % 6 == 5, F.lit("")).otherwise(F.lit("1")), F.lit("")),
    )
    steps = F.array(F.struct(F.lit(1).alias("order"), F.lit("Cook until done.").alias("text")))
    return _dealt(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), F.lpad(key.cast("string"), 8, "0")).alias("id"), name.alias("name"), _pick(["", "4 servings", "2-6 portions"], "p_size").alias("subName"), _url().alias("url"),
        F.when(key % 7 != 0, F.lit("30 minutes")).alias("totalTime"), F.when(key % 6 == 0, F.lit("")).otherwise(F.lit("10 minutes")).alias("prepTime"), F.lit("Easy").alias("difficulty"),
        tags.alias("tags"), amounts.alias("nutritionalValues"), foods.alias("ingredients"), steps.alias("instructions"),
    )


def _import(spark, sf_dir):
    none = F.array().cast("array<string>")
    known = _t(spark, sf_dir, "part").where("p_name LIKE 'red %'").select("p_name").distinct().select(
        F.regexp_replace("p_name", " ", "-").alias("id"), F.col("p_name").alias("name"), none.alias("aliases"), F.array(F.lit("x")).alias("categories"), F.array(F.lit("summer")).alias("seasons"),
        F.lit(None).cast("string").alias("default_unit"), none.alias("allergens"),
    )
    return legacy.transformed(legacy.checked_meals(_meals(spark, sf_dir)), known)


@_query(f"""WITH {_MEALS} SELECT source_id, base || CASE WHEN shared THEN '-' || lpad(p_partkey::VARCHAR, 8, '0') ELSE '' END AS recipe_id, {_listed(['salads', 'soups', 'desserts', 'sandwiches'], 'p_size')} AS folder,
CASE WHEN greatest(warm, cool) < 2 THEN 'year-round' ELSE array_to_string(list_filter([CASE WHEN warm >= greatest(2, 0.6 * greatest(warm, cool)) THEN 'summer' END,
  CASE WHEN cool >= greatest(2, 0.6 * greatest(warm, cool)) THEN 'fall,winter' END], lambda x: x IS NOT NULL), ',') END AS seasons,
10 AS prep, CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE 20 END AS cook,
array_to_string(list_filter([CASE WHEN veggie THEN 'vegetarian' END, CASE WHEN vegan THEN 'vegan' END, CASE WHEN no_gluten THEN 'gluten-free' END, CASE WHEN allergen <> 'milk' THEN 'dairy-free' END, 'nut-free', 'egg-free'], lambda x: x IS NOT NULL), ',') AS dietary,
allergen AS allergens, {_listed(['salad', 'soup', 'dessert', 'sandwich'], 'p_size')} || ',easy' || CASE WHEN tagged = 2 THEN ',spicy' ELSE '' END || ',needs-review' AS tags,
{_listed(['2', '4', '6'], 'p_size')} || ' servings' AS yield_text,
CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'calories=' || p_size ELSE 'calories=100' || CASE WHEN p_size <= 25 THEN ',fat_g=' || (p_size * 20) ELSE '' END END AS nutrition, 1 AS n_steps FROM x""")
def legacy_import(spark, sf_dir):
    return records.shown_recipes(_import(spark, sf_dir))


@_query(f"""WITH {_MEALS} SELECT source_id, 0 AS pos, replace(p_name, ' ', '-') AS ingredient_id, p_name AS item, {_listed(['2|cup|', '1.5|cup|', '||missingMeasurements', '||malformedMeasurements'], 'p_partkey')} AS amount, FALSE AS optional FROM m
UNION ALL SELECT source_id, 1, replace(lower(food), ' ', '-'), food, CASE WHEN f = 5 THEN 'to taste||inferredMeasurements' ELSE '1||missingUnits' END, FALSE FROM m""")
def legacy_lines(spark, sf_dir):
    return records.shown_lines(_import(spark, sf_dir))


@_query(f"""WITH {_MEALS}, a AS (SELECT unnest([CASE WHEN tagged = 0 THEN 'missingSourceTags' END, CASE WHEN p_size % 3 = 0 THEN 'missingSubtitles' END, CASE WHEN tagged = 1 AND NOT vegan THEN 'dietaryConflicts' END,
  CASE WHEN tagged = 3 AND NOT veggie THEN 'dietaryConflicts' END, CASE WHEN tagged = 2 AND NOT no_gluten THEN 'dietaryConflicts' END, CASE WHEN p_partkey % 6 = 0 THEN 'inferredPrepTime' END,
  CASE WHEN p_partkey % 7 = 0 THEN 'inferredTotalTime' END, CASE WHEN p_size % 3 <> 1 THEN 'assumedYield' END, CASE WHEN p_partkey % 3 = 0 THEN 'missingNutrition' END,
  CASE WHEN p_partkey % 4 = 3 THEN 'malformedMeasurements' END, CASE WHEN p_partkey % 4 = 2 THEN 'missingMeasurements' END, CASE WHEN f = 5 THEN 'inferredMeasurements' ELSE 'missingUnits' END,
  CASE WHEN p_partkey % 3 = 2 AND p_size > 25 THEN 'nutritionOutliers' END, CASE WHEN shared THEN 'duplicateTitles' END]) AS category FROM x
  UNION ALL SELECT DISTINCT 'fallbackSeasonIngredients' FROM x WHERE food = 'Onion')
SELECT category, count(*)::INT AS n FROM a WHERE category IS NOT NULL GROUP BY category""")
def legacy_audit(spark, sf_dir):
    return records.shown_audit(_import(spark, sf_dir))


@_query(f"""WITH {_MEALS} SELECT replace(p_name, ' ', '-') AS id, p_name AS name, '' AS aliases, 'other' AS category, 'year-round' AS seasons, max(CASE WHEN p_partkey % 4 < 2 THEN 'cup' END) AS unit, '' AS allergens FROM x WHERE NOT known GROUP BY p_name
UNION ALL SELECT DISTINCT replace(lower(food), ' ', '-'), food, '', {_listed(['dairy', 'baking', 'protein', 'produce', 'produce', 'spice'], 'f')}, CASE WHEN f = 3 THEN 'fall,winter' ELSE 'year-round' END, NULL::VARCHAR, allergen FROM x""")
def legacy_ingredients(spark, sf_dir):
    return records.shown_ingredients(_import(spark, sf_dir))


@_query(f"""WITH {_MEALS}, s AS (SELECT count(*)::INT AS recipes, (count(DISTINCT CASE WHEN NOT known THEN p_name END) + count(DISTINCT food))::INT AS ingredients, sum((p_size % 3 = 0)::INT)::INT AS subtitles FROM x)
SELECT turn, recipes, ingredients, subtitles FROM s, (VALUES ('first'), ('again')) AS v(turn)""")
def review_bundle(spark, sf_dir):
    return records.shown_bundle(spark, _import(spark, sf_dir))


# drafts

_FOOD = "struct<item: string, quantity: string, unit: string, preparation: string, optional: boolean>"


def _key() -> Column:
    return F.lpad(F.col("p_partkey").cast("string"), 12, "0")


def _made(spark, sf_dir):
    """Records of parts: those of odd keys take the facts' ingredient; red things are known foods, blue ones taken ids."""
    part, none, empty = _t(spark, sf_dir, "part"), F.array().cast("array<string>"), F.lit("")
    food = lambda item, quantity, unit, how, optional: F.struct(
        item.alias("item"), F.lit(quantity).alias("quantity"), F.lit(unit).alias("unit"), F.lit(how).alias("preparation"), F.lit(optional).alias("optional")
    )
    step = lambda says, minutes: F.struct(F.lit(says).alias("text"), minutes.alias("timer_minutes"))
    draft = F.struct(
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"), empty.alias("subtitle"), F.concat("p_type", F.lit(". ")).alias("description"), F.lit("dessert").alias("meal_type"), empty.alias("cuisine"),
        F.struct(F.col("p_size").cast("double").alias("quantity"), F.lit(" ").alias("unit")).alias("yield"),
        F.struct(F.lit(5).alias("prep_minutes"), F.col("p_size").cast("int").alias("cook_minutes"), (F.col("p_size") % 2).cast("int").alias("inactive_minutes")).alias("times"),
        F.array(food(F.lit("Butter"), "2", "cup", "", False)).alias("ingredients"), F.array(step(" Mix. ", F.lit(0)), step("Bake.", F.col("p_size").cast("int"))).alias("instructions"),
        F.array(F.lit("Quick!"), F.col("p_type"), empty).alias("tags"), none.alias("seasons"), F.array(*map(F.lit, ("vegan", "dairy-free", "nut-free"))).alias("dietary"),
        F.array(F.lit("eggs")).alias("allergens"), F.array(*map(F.lit, (" oven ", "oven", ""))).alias("equipment"),
    )
    facts = F.when(F.col("p_partkey") % 2 == 1, F.array(food(F.col("p_name"), "1/2", "", "strained", True))).otherwise(F.array().cast(f"array<{_FOOD}>"))
    drafts = part.select(_key().alias("key"), F.struct(F.lit("S").alias("name"), _url().alias("url")).alias("source"), draft.alias("draft"), facts.alias("ingredients"))
    names = part.select("p_name").distinct().withColumn("id", F.regexp_replace("p_name", " ", "-"))
    butter = part.select(F.lit("butter").alias("id"), F.lit("Butter").alias("name")).distinct()
    known = names.where("p_name LIKE 'red %'").select("id", F.col("p_name").alias("name")).union(butter).withColumn("aliases", none)
    return part, materialize.materialized(drafts, known, names.where("p_name LIKE 'blue %'").select("id"), F.lit("2026-01-01"))


_DRAFTS = """d AS (SELECT *, lpad(p_partkey::VARCHAR, 12, '0') AS key, 'https://shop.example/' || p_partkey AS url, replace(p_name, ' ', '-') AS base, p_partkey % 2 = 1 AS given,
p_name LIKE 'blue %' OR row_number() OVER (PARTITION BY p_name ORDER BY lpad(p_partkey::VARCHAR, 12, '0')) > 1 AS again FROM part)"""


@_query(f"""WITH {_DRAFTS} SELECT key, '{{"schema_version":"1.0.0","id":"' || base || CASE WHEN again THEN '-' || substr(sha256(url), 1, 8) ELSE '' END || '","name":"' || p_name || '","description":"' || p_type || '.","meal_type":"dessert","yield":{{"quantity":' || p_size
|| '.0,"unit":"servings"}},"times":{{"prep_minutes":5,"cook_minutes":' || p_size || CASE WHEN p_size % 2 = 1 THEN ',"inactive_minutes":1' ELSE '' END || '}},"ingredients":[{{' ||
CASE WHEN NOT given THEN '"ingredient_id":"butter","item":"Butter","quantity":{{"num":2.0,"raw":"2"}},"unit":"cup"'
  ELSE CASE WHEN p_name LIKE 'red %' THEN '"ingredient_id":"' || base || '",' ELSE '' END || '"item":"' || p_name || '","quantity":{{"raw":"1/2"}},"preparation":"strained","optional":true' END
|| '}}],"instructions":[{{"step":1,"text":"Mix."}},{{"step":2,"text":"Bake.","timer_minutes":' || p_size || '}}],"tags":["quick","' || lower(p_type) || '"],"dietary":[' || CASE WHEN given THEN '"dairy-free",' ELSE '' END || '"nut-free"],"allergens":["eggs"'
|| CASE WHEN given THEN '' ELSE ',"milk"' END || '],"equipment":["oven"],"source":{{"name":"S","url":"' || url || '","adapted":true}},"created_at":"2026-01-01","updated_at":"2026-01-01"}}' AS json FROM d""")
def materialized(spark, sf_dir):
    return _made(spark, sf_dir)[1].select("key", F.to_json("record").alias("json"))


@_query(f"""WITH {_DRAFTS} SELECT key, sha256('{{"description":"' || p_type || '","instructions":["' || p_name || '"]}}') AS source_text_hash, sha256('{{"subtitle":"","description":"' || p_type || '.","instructions":["Mix.","Bake."]}}') AS normalized_text_hash,
'm1' AS model, 'p2' AS prompt_version, p_size::INT AS semantic, FALSE AS requires_review FROM d""")
def provenance(spark, sf_dir):
    part, made = _made(spark, sf_dir)
    extracted = F.struct(F.col("p_type").alias("description"), F.array("p_name").alias("instruction_lines"))
    return records.shown_provenance(made.join(part.withColumn("key", _key()), "key"), extracted, F.col("p_size").cast("int"))


# staging


def _staged(wrong: Column) -> Column:
    """A staged record of a part; wrong (an int) names what is wrong with it."""
    none = F.lit(None).cast("string")
    steps = F.array(F.struct(F.concat(F.lit("Make "), "p_name", F.lit(".")).alias("text")))
    digest = text.final_digest(F.lit(""), F.lit(""), F.array(F.concat(F.lit("Make "), "p_name", F.lit("."))))
    normal = F.struct(
        F.sha2("p_type", 256).alias("source_text_hash"), F.when(wrong == 6, F.lit("0")).otherwise(digest).alias("normalized_text_hash"), F.lit("m").alias("model"), F.lit("1").alias("prompt_version"),
        F.lit("t").alias("transformed_at"), F.when(wrong != 7, F.lit(False)).alias("requires_review"), F.lit("passed").alias("source_review_status"),
    )
    kind = _pick(["main", "soup", "snack"], "p_size")
    food = F.array(F.struct(F.when(wrong == 5, F.lit("saffron")).otherwise(F.regexp_replace("p_name", " ", "-")).alias("ingredient_id")))
    source = F.struct(F.lit("S").alias("name"), _url().alias("url"), (wrong != 4).alias("adapted"))
    return F.struct(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), none.alias("subtitle"), none.alias("description"), kind.alias("meal_type"), steps.alias("instructions"), food.alias("ingredients"), source.alias("source"), normal.alias("normalization"))


def _foods(part):
    names = part.select(F.regexp_replace("p_name", " ", "-").alias("id")).distinct()
    return names.select("id", F.struct("id", F.lit("n").alias("notes")).alias("record"))


def _files(rows):
    return rows.select(F.concat(produce.folder(F.col("record.meal_type")), F.lit("/"), "record.id", F.lit(".json")).alias("file"), "record")


_FILE = f"{_listed(['mains', 'soups', 'snacks'], 'p_size')} || '/part-' || p_partkey || '.json'"


@_query(f"""SELECT {_FILE} AS file, 'part-' || p_partkey AS recipe_id, 'https://shop.example/' || p_partkey AS source_url, sha256('{{"subtitle":"","description":"","instructions":["Make ' || p_name || '."]}}') AS normalized_text_hash,
(SELECT count(DISTINCT p_name) FROM part)::INT AS n_foods, 0::BIGINT AS n_errors FROM part""")
def staging_export(spark, sf_dir):
    """A manifest of all parts as staged records; the collection it lists has no errors."""
    part = _t(spark, sf_dir, "part")
    rows, foods = part.select(_staged(F.lit(0)).alias("record")), _foods(part)
    listed, listed_foods, hosts, totals = staging.staging_export(rows, foods, "2026-01-01T00:00:00.000Z")
    errors = staging.collection_errors(listed, _files(rows), listed_foods, foods.select(F.concat(F.lit("_ingredients/"), "id", F.lit(".json")).alias("file"), "record"), foods.select("record").limit(0), totals, hosts)
    shown = listed.select("file", "recipe_id", "source_url", "normalized_text_hash", F.lit(totals["total_ingredients"]).alias("n_foods"))
    return shown.crossJoin(F.broadcast(errors.agg(F.count(F.lit(1)).alias("n_errors"))))  # one row


@_query(f"""WITH p AS (SELECT *, {_FILE} AS file, p_partkey % 11 AS w FROM part), f AS (SELECT DISTINCT replace(p_name, ' ', '-') AS id FROM part)
SELECT file || ': ' || unnest(CASE w WHEN 1 THEN ['file is missing'] WHEN 2 THEN ['recipe is not listed in manifest'] WHEN 3 THEN ['source URL does not match manifest'] WHEN 4 THEN ['source.adapted must be true']
  WHEN 5 THEN ['unknown ingredient_id ''saffron'''] WHEN 6 THEN ['normalized text hash does not match'] WHEN 7 THEN ['normalization must have passed content review']
  WHEN 8 THEN ['normalization.model does not match manifest'] WHEN 9 THEN ['recipe id does not match manifest', 'source name does not match manifest'] END) AS error FROM p WHERE w BETWEEN 1 AND 9
UNION ALL SELECT '_ingredients/' || id || '.json: conflicts with finalized ingredient ''' || id || '''' FROM f WHERE id LIKE 'red-%'
UNION ALL SELECT '_ingredients/' || id || '.json: ingredient is not listed in manifest' FROM f WHERE id LIKE 'blue-%'
UNION ALL SELECT DISTINCT {_FILE} || ': unknown ingredient_id ''' || replace(p_name, ' ', '-') || '''' FROM part WHERE p_name LIKE 'blue %' AND p_partkey % 11 NOT IN (1, 2, 5)
UNION ALL SELECT 'recipes-staging/manifest.json: ' || unnest(['recipe totals do not match files', 'ingredient totals do not match files', 'publication_status must remain rights-pending', 'source_counts do not match recipes'])""")
def staging_audit(spark, sf_dir):
    """A collection whose records have eleven kinds of errors by their keys; red foods are published otherwise and blue ones not listed."""
    part, wrong = _t(spark, sf_dir, "part"), F.col("p_partkey") % 11
    made = part.select(wrong.alias("w"), _staged(wrong).alias("record"))
    good = part.select(wrong.alias("w"), _staged(F.lit(0)).alias("record")).where("w <> 2")
    n = F.col("record.normalization")
    other = lambda w, change, value: F.when(F.col("w") == w, F.lit(change)).otherwise(value)
    file = F.concat(produce.folder(F.col("record.meal_type")), F.lit("/"), "record.id", F.lit(".json"))
    # the digest that the manifest names is the one that a file has
    named = [other(6, "0", n[f]) if f == "normalized_text_hash" else other(8, "other", n[f]) if f == "model" else n[f] for f in staging.NAMED]
    listed = good.select(
        file.alias("file"), other(9, "x", F.col("record.id")).alias("recipe_id"), other(9, "x", F.col("record.source.name")).alias("source_name"), other(3, "https://x.example/", F.col("record.source.url")).alias("source_url"),
        *[c.alias(f) for c, f in zip(named, staging.NAMED, strict=True)],
    )
    foods = _foods(part).select(F.concat(F.lit("_ingredients/"), "id", F.lit(".json")).alias("file"), "id", "record")
    listed_foods = foods.where("id NOT LIKE 'blue-%'").select("file", F.col("id").alias("ingredient_id"))
    final = foods.where("id LIKE 'red-%'").select(F.struct("id", F.lit("published").alias("notes")).alias("record"))
    counts = part.select(F.lit("shop.example").alias("host"), F.lit(-1).cast("long").alias("n")).distinct()
    totals = {"publication_status": "ready", "total_recipes": -1, "total_ingredients": -1}
    return staging.collection_errors(listed, _files(made.where("w <> 1")), listed_foods, foods.select("file", "record"), final, totals, counts)


@_query("""SELECT 'part-' || p_partkey AS id, (['mains', 'soups', 'snacks'])[1 + p_size % 3] || '/part-' || p_partkey || '.json' AS destination, array_to_string(list_filter([
CASE WHEN p_size % 4 = 0 THEN 'input is not a supported review candidate' END, CASE WHEN p_size % 5 = 0 THEN 'final recipe must retain the candidate source URL' END, CASE WHEN p_size % 7 = 0 THEN 'final recipe source must set adapted to true' END,
CASE WHEN p_size % 9 = 0 THEN 'final recipe still has the needs-review tag' END, CASE WHEN p_size % 11 = 0 THEN 'final recipe still contains a rewrite placeholder' END, CASE WHEN p_partkey % 10 = 0 THEN 'a finalized recipe exists already' END],
lambda x: x IS NOT NULL), '; ') AS issues FROM part""")
def manual_promotion(spark, sf_dir):
    size, none = F.col("p_size"), F.lit(None).cast("string")
    extracted = F.struct(F.col("p_type").alias("description"), F.array("p_name").alias("instruction_lines"))
    status = F.when(size % 4 == 0, F.lit("x")).otherwise(F.lit("needs-review-and-original-wording"))
    candidate = F.struct(F.lit("1.0.0").alias("candidate_version"), status.alias("review_status"), F.struct(_url().alias("url")).alias("source"), extracted.alias("extracted"))
    step = F.when(size % 11 == 0, F.lit("REWRITE REQUIRED")).otherwise(F.lit("Mix."))
    record = F.struct(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), _pick(["main", "soup", "snack"], "p_size").alias("meal_type"), none.alias("subtitle"), none.alias("description"),
        F.array(F.struct(step.alias("text"))).alias("instructions"), F.array().cast("array<string>").alias("notes"), F.array(F.when(size % 9 == 0, F.lit("needs-review")).otherwise(F.lit("x"))).alias("tags"),
        F.struct(F.when(size % 5 == 0, F.lit("https://x.example/")).otherwise(_url()).alias("url"), (size % 7 != 0).alias("adapted")).alias("source"),
    )
    part = _t(spark, sf_dir, "part")
    stored = part.where("p_partkey % 10 = 0").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"))
    got = staging.manual_promotion(part.select(candidate.alias("candidate"), record.alias("record")), stored, attested=True)
    return got.select("id", "destination", F.array_join("issues", "; ").alias("issues"))


# rights, ledgers and sites


@_query("""WITH c AS (SELECT 'c' || c_custkey AS host, c_custkey AS k, c_custkey % 3 <> 0 AS had, c_custkey % 2 = 0 AS changed, c_custkey % 4 = 0 AS yes FROM customer)
SELECT host, CASE WHEN changed THEN CASE WHEN yes THEN 'approved' ELSE 'draft-only' END WHEN k % 5 = 0 THEN 'approved' ELSE 'draft-only' END AS status, CASE WHEN changed THEN CASE WHEN yes THEN 'cc0' ELSE 'unverified' END WHEN k % 5 = 0 THEN 'cc0' ELSE 'unverified' END AS basis,
CASE WHEN changed THEN CASE WHEN yes THEN 'e' || k ELSE '' END ELSE 'old' END AS evidence, CASE WHEN changed AND NOT yes THEN 0 WHEN changed AND k % 8 = 0 THEN 7 WHEN had THEN (k % 10)::INT ELSE 0 END AS max_per_run,
CASE WHEN changed AND NOT yes THEN 0 WHEN had THEN 9 ELSE 0 END AS max_catalog, CASE WHEN had THEN 'kept' ELSE '' END AS notes FROM c WHERE had OR changed""")
def rights_upsert(spark, sf_dir):
    """Two thirds of the hosts have an entry, half of them a change, and half of the changes approve."""
    key, host = F.col("c_custkey"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("host")
    rows, none = _t(spark, sf_dir, "customer"), F.lit(None)
    good, yes = key % 5 == 0, key % 4 == 0
    text_ = lambda when, value: F.when(when, value)
    policy = rows.where("c_custkey % 3 <> 0").select(
        host, F.when(good, F.lit("approved")).otherwise(F.lit("draft-only")).alias("status"), F.when(good, F.lit("cc0")).otherwise(F.lit("unverified")).alias("basis"), F.lit("old").alias("evidence"), F.lit("").alias("reviewed_at"),
        F.lit("").alias("expires_at"), (key % 10).cast("int").alias("max_per_run"), F.lit(9).alias("max_catalog"), F.lit("kept").alias("notes"),
    )
    changes = rows.where("c_custkey % 2 = 0").select(
        host, yes.alias("approve"), text_(yes, F.lit("cc0")).alias("basis"), text_(yes, F.concat(F.lit("e"), key.cast("string"))).alias("evidence"), F.lit("2026-01-01").alias("reviewed_at"), none.cast("string").alias("expires_at"),
        F.when(key % 8 == 0, F.lit(7)).alias("max_per_run"), none.cast("int").alias("max_catalog"), none.cast("string").alias("notes"),
    )
    return gates.upserted_rights(policy, changes).select("host", "status", "basis", "evidence", "max_per_run", "max_catalog", "notes")


_MOMENT = "lpad(page_id::VARCHAR, 12, '0')"


def _moment() -> Column:
    return F.lpad(F.col("page_id").cast("string"), 12, "0")


@_query(f"""WITH c AS ({_CANONICAL}), f AS (SELECT page_id, canonical_url AS url FROM c UNION ALL SELECT page_id, 'https://final.example/' || (page_id % 50) FROM pages)
SELECT url, min({_MOMENT}) AS scraped_at, arg_min('f' || page_id, {_MOMENT}) AS output FROM f WHERE url NOT IN (SELECT canonical_url FROM c WHERE page_id % 5 = 0) GROUP BY url""")
def ledger_append(spark, sf_dir):
    """Pages that lead to fifty last addresses; a fifth of the requested ones are in the ledger."""
    pages = _t(spark, sf_dir, "pages")
    final = F.concat(F.lit("https://final.example/"), (F.col("page_id") % 50).cast("string"))
    fetched = pages.select(F.col("url").alias("requested"), final.alias("final"), _moment().alias("scraped_at"), F.array(F.concat(F.lit("f"), F.col("page_id").cast("string"))).alias("output"))
    known = pages.where("page_id % 5 = 0").select(urls.canonical(F.col("url")).alias("url"))
    return sources.ledger_rows(fetched, known).select("url", "scraped_at", F.array_join("output", ",").alias("output"))


@_query(f"""WITH c AS ({_CANONICAL}) SELECT canonical_url AS url, min({_MOMENT}) AS scraped_at, arg_min('p' || page_id, {_MOMENT}) AS output, TRUE AS recovered FROM c
WHERE page_id % 7 <> 0 AND canonical_url NOT IN (SELECT canonical_url FROM c WHERE page_id % 5 = 0) GROUP BY canonical_url""")
def ledger_recover(spark, sf_dir):
    """Stored candidates of pages, a seventh without their address; a fifth of the pages are in the ledger."""
    pages = _t(spark, sf_dir, "pages")
    source = F.struct(F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("url"), _moment().alias("retrieved_at"))
    stored = pages.select(source.alias("source"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"))
    got = sources.recovered(stored, pages.where("page_id % 5 = 0").select("url"))
    return got.select("url", "scraped_at", F.array_join("output", ",").alias("output"), "recovered")


@_query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'n' || n_nationkey WHEN 1 THEN regexp_replace(host, '^www\.', '') END AS id, CASE page_id % 3 WHEN 0 THEN n_name WHEN 1 THEN host END AS name,
CASE page_id % 3 WHEN 0 THEN 'https://' || lower(n_name) || '.example' WHEN 1 THEN scheme || '://' || host END AS base_url, page_id % 3 = 0 AS configured FROM p LEFT JOIN nation ON page_id % 3 = 0 AND n_nationkey = page_id % 25""")
def site_config(spark, sf_dir):
    """Pages that name a configured site, an address of their own, or a site that nobody configured."""
    base = F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example"))
    sites = _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), base.alias("base_url"), F.array(base).alias("seeds"))
    place = F.col("page_id") % 3
    given = F.when(place == 0, F.concat(F.lit("n"), (F.col("page_id") % 25).cast("string"))).when(place == 1, F.col("url")).otherwise(F.lit("nobody's"))
    rows = _t(spark, sf_dir, "pages").select("page_id", given.alias("given"))
    return sources.sites_of(rows, "given", sites).select("page_id", "site.id", "site.name", "site.base_url", F.coalesce("site.configured", F.lit(False)).alias("configured"))


# names

_SYNONYMS = sorted(produce.SYNONYMS)


@_query(f"""WITH s AS (SELECT * FROM {records._values(*[(k, produce.SYNONYMS[k]) for k in _SYNONYMS])} AS v(name, id)), known AS (SELECT DISTINCT replace(p_name, ' ', '-') AS id FROM part WHERE p_name LIKE 'red %' UNION SELECT 'olive-oil' UNION SELECT 'onion')
SELECT p_partkey, item, coalesce(k.id, o.id) AS id FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE upper({_listed(_SYNONYMS, 'p_size')}) END AS item FROM part) AS p
LEFT JOIN known AS k ON replace(lower(item), ' ', '-') = k.id AND p_partkey % 2 = 0 LEFT JOIN s ON s.name = lower(item) LEFT JOIN known AS o ON o.id = s.id""")
def synonym_resolve(spark, sf_dir):
    """Names of parts and synonyms of foods; red things, olive oil and onions are known."""
    part = _t(spark, sf_dir, "part")
    item = F.upper(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(_pick(_SYNONYMS, "p_size")))
    foods = part.select(F.explode(F.array(F.lit("olive-oil"), F.lit("onion"))).alias("id")).distinct().withColumn("name", F.col("id"))
    known = part.where("p_name LIKE 'red %'").select(F.regexp_replace("p_name", " ", "-").alias("id"), F.col("p_name").alias("name")).distinct().union(foods)
    return resolve.with_synonyms(part.select("p_partkey", item.alias("item")), "item", resolve.alias_index(known, "id", ["name"])).select("p_partkey", "item", "id")


_AZ = "abcdefghijklmnopqrstuvwxyz"


@_query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS word FROM documents)
SELECT word, row_number() OVER (PARTITION BY lower(word[1:3]) ORDER BY lower(word), translate(word, '{_AZ}{_AZ.upper()}', '{_AZ.upper()}{_AZ}')) AS place FROM w""")
def collation_order(spark, sf_dir):
    """Places of the documents' distinct words among those with the same first three letters: a before A before b."""
    words = _t(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    return search.collated_places(words.withColumn("start", F.lower(F.substring("word", 1, 3))), "start", "word").select("word", "place")
