"""Rules and parsers over inputs that reach every branch, dealt to the rows of a table by key; the SQL twins hold the
results that the rules call for, as literals."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import numbers, produce, rules, text, urls
from granary.operators import candidates, crawl, gates, increments, legacy, resolve, review, staging
from granary.plans.catalog import _dealt, _query


def cases(name: str, of: Callable[[Column], Column], *pairs: tuple[object, object]) -> None:
    """Register a query that applies ``of`` to each input (a text, or a value as JSON), one a row of part by its key."""
    given = [x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x, _ in pairs]
    wanted = ["NULL" if y is None else "'" + str(y).replace("'", "''") + "'" for _, y in pairs]

    def query(spark, sf_dir):
        x = F.element_at(F.array(*[F.lit(g).cast("string") for g in given]), (F.col("p_partkey") % len(given) + 1).cast("int"))
        # the input is a value of its own row, so that nothing is folded to a constant
        return _dealt(spark, sf_dir, "part").select("p_partkey", x.alias("x")).select("p_partkey", of(F.col("x")).cast("string").alias("value"))

    query.__name__ = name
    _query(f"SELECT p_partkey, ([{', '.join(wanted)}])[1 + p_partkey % {len(wanted)}] AS value FROM part")(query)


def _json(x: Column, schema: str) -> Column:
    return F.from_json(x, schema)


def _bar(*parts: Column) -> Column:
    """Parts joined by bars, null ones empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _list(values: Column, sep: str = ",") -> Column:
    return F.array_join(values, sep)


# quantities and times

cases("duration_iso", numbers.iso_minutes, ("PT10M", 10), ("PT1H30M", 90), ("P1DT1M", 1441), ("PT5S", 0), ("pt2h", 120), ("P1W", 0), ("", 0), (None, 0), ("PT0.5H", 0))
cases(
    "duration_english", numbers.english_minutes,
    ("1 hour 5 minutes", 65), ("2 hours 45 minutes", 165), ("4 hrs 15 min", 255), ("", None), (None, None), ("about 20", 20), ("5 minced cloves", 5), ("1.5 hours", 90), ("overnight", None), ("2 HRS 2.5 min", 123),
)
cases(
    "yield_parse", lambda x: _bar(numbers.number_text(numbers.yield_of(x)["quantity"]), numbers.yield_of(x)["unit"]),
    ("4-6+", "4|servings"), ("Makes 12 cookies", "12|cookies"), ("0", "1|servings"), ("a few", "1|servings"), ("2.5 cups", "2.5|cups"), ("8 – 10 slices", "8|slices"), (None, "1|servings"), ("approx. 4", "1|4"),
)


def _inferred(x: Column) -> Column:
    got = numbers.inferred_yield(x)
    return _bar(got["quantity"], got["unit"], got["inferred"], got["reason"])


cases(
    "yield_infer", _inferred,
    ("Platter | 2-4 Servings", "4|servings|true|source range"), ("4 servings", "4|servings|false|"), ("Dinner", "2|servings|true|source omitted yield"), ("6 to 8 portions", "8|servings|true|source range"),
    ("10 servings", "2|servings|true|source omitted yield"), ("2–3 portions", "3|servings|true|source range"), (None, "2|servings|true|source omitted yield"),
)
cases("normalize_unit", numbers.normal_unit, ("cups", "cup"), ("Unit", None), ("", None), (None, None), ("tbsp", "tbsp"), ("LBS", "LBS"), (" Ounce(oz) ", "ounce"), ("Handful", "Handful"), ("CLOVES", "clove"))


def _normal(x: Column) -> Column:
    p = _json(x, "struct<a: string, u: string>")
    q = numbers.normal_quantity(p["a"], p["u"])
    flags = rules.all_matches([(q["missing"], "missing"), (q["malformed"], "malformed"), (q["missing_unit"], "no unit")])
    return _bar(numbers.number_text(q["num"]), q["raw"], q["unit"], _list(flags))


cases(
    "normalize_quantity", _normal,
    ({"a": "1 1/2", "u": "cups"}, "1.5||cup|"), ({"a": "2", "u": ""}, "2|||no unit"), ({"a": "unit", "u": ""}, "|||malformed"), ({"a": "", "u": ""}, "|||missing"), ({"a": "1/2", "u": "cup"}, "|1/2|cup|"),
    ({"a": "2", "u": "ounces"}, "2||ounce|"), ({"a": "box", "u": "cups"}, "|box|cup|"), ({"a": "3", "u": "unit"}, "3|||"), ({"a": "1 1/0", "u": "cup"}, "|1 1/0|cup|"), ({"u": "cups"}, "||cup|missing"),
)


def _formatted(x: Column) -> Column:
    p = _json(x, "struct<num: double, raw: string, scale: double>")
    return numbers.format_quantity(p["num"], p["raw"], p["scale"])


cases(
    "format_quantity", _formatted,
    ({"num": 2, "scale": 1.5}, "3"), ({"num": 0.333, "scale": 2}, "0.67"), ({"raw": "1/2", "scale": 1}, "1/2"), ({"raw": "1/2", "scale": 3}, "1.5"), ({"raw": "to taste", "scale": 2}, "to taste"),
    ({"scale": 2}, ""), ({"raw": "1 1/2", "scale": 2}, "1 1/2"), ({"num": 0.125, "scale": 1}, "0.13"),
)
cases(
    "typed_quantity", lambda x: _bar(numbers.number_text(numbers.typed_quantity(x)["num"]), numbers.typed_quantity(x)["raw"]),
    ("2", "2|2"), ("1/2", "|1/2"), ("", "|"), (None, "|"), (" 1.50 ", "1.5|1.50"), ("2-4", "|2-4"),
)


def _totals(x: Column) -> Column:
    p = _json(x, "struct<prep: int, cook: int, inactive: int, servings: double, quantity: double>")
    return _bar(numbers.total_minutes(p["prep"], p["cook"], p["inactive"]), numbers.number_text(numbers.serving_scale(p["servings"], p["quantity"])))


cases(
    "total_minutes", _totals, ({"prep": 5, "cook": 10, "servings": 6, "quantity": 4}, "15|1.5"), ({"prep": 5, "cook": 10, "inactive": 60, "servings": 2, "quantity": 4}, "75|0.5"), ({"prep": 0, "cook": 0, "inactive": 0, "servings": 4, "quantity": 4}, "0|1")
)


def _times(x: Column) -> Column:
    p = _json(x, "struct<total: string, prep: string, steps: array<string>>")
    t = numbers.inferred_times(p["total"], p["prep"], p["steps"])
    return _bar(t["prep_minutes"], t["cook_minutes"], _list(t["inferred"]))


cases(
    "infer_times", _times,
    ({"total": "30 minutes", "prep": "10 minutes", "steps": []}, "10|20|"), ({"total": "20 minutes", "prep": "", "steps": []}, "10|10|prep_minutes"), ({"total": "12 minutes", "steps": []}, "5|7|prep_minutes"),
    ({"steps": ["Cook 5 minutes.", "Bake 20-25 minutes or 10 min"]}, "10|30|prep_minutes,total_minutes"), ({"total": "10 minutes", "prep": "25 minutes", "steps": []}, "10|0|prep_minutes_clamped"),
    ({"prep": "5 minutes", "steps": []}, "5|10|total_minutes"), ({"prep": "3 minutes", "steps": ["Rest 2 to 3 min, then 7 minutes", None]}, "3|12|total_minutes"), ({"prep": "5 minutes"}, "5|10|total_minutes"),
)


def _nutrition(x: Column) -> Column:
    found = numbers.nutrients(_json(x, "map<string, string>"))
    shown = lambda n: F.concat(n["target"], F.lit("="), numbers.number_text(n["value"]), F.when(n["outlier"], F.lit("!")).otherwise(F.lit("")))
    return _list(F.transform(found, shown))


cases(
    "nutrition_limits", _nutrition,
    ({"Calories": "250 kcal", "Protein": "12.5", "Fat": "-1", "Sodium": "30000"}, "calories=250,protein_g=12.5,sodium_mg=30000!"), ({}, ""), ({"Sugar": "abc"}, ""), ({"Dietary Fiber": "200"}, "fiber_g=200"),
    ({"Fat": "501 g"}, "fat_g=501!"), ({"Carbohydrate": "1e2"}, "carbohydrates_g=100"),
)


def _line(x: Column) -> Column:
    return text.bound(numbers.parse_line(x), lambda r: _bar(r["quantity"], r["unit"], r["item"], r["preparation"], r["optional"]))


cases(
    "parse_quantity_line", _line,
    ("1 (14 ounce) can sweetened condensed milk", "1|can|sweetened condensed milk|14 ounce|false"), ("350g plums, halved and destoned", "350|g|plums|halved and destoned|false"),
    ("½ cinnamon stick", "1/2||cinnamon stick||false"), ("2 to 3 cups chopped peeled onion", "2-3|cups|onion|chopped peeled|false"), ("", "||unknown ingredient||false"), (None, "||unknown ingredient||false"),
    ("1 cup milk (optional)", "1|cup|milk (optional)||true"), ("2 (8 oz) packages cream cheese, softened", "2|package|cream cheese|8 oz, softened|false"), ("1½ cups flour", "1 1/2|cups|flour||false"),
    ("3 - 4 cloves garlic", "3-4|cloves|garlic||false"), ("Salt - to taste", "||Salt|to taste|false"), ("2 chopped onions", "2||onions|chopped|false"), ("chopped", "||chopped||false"), ("1 can. beans", "1|can|beans||false"),
    ("2 large eggs, beaten", "2|large|eggs|beaten|false"), ("1/2 tsp salt", "1/2|tsp|salt||false"),
)
cases("timestamp_default", lambda x: numbers.since_or_day(F.get_json_object(x, "$.t"), F.get_json_object(x, "$.d")), ({"t": "2026-01-02T03:04:05.000Z", "d": "2026-01-01"}, "2026-01-02T03:04:05.000Z"), ({"d": "2026-01-01"}, "2026-01-01T00:00:00.000Z"), ({}, None))

# names

cases("slug_folded", lambda x: text.slug(x, fold=True), ("Jalapeño Popper!", "jalapeno-popper"), ("", "recipe"), (None, "recipe"), ("--", "recipe"), ("Crème Brûlée", "creme-brulee"))
cases("slug_marks", text.slug, ("Jalapeño", "jalapen-o"), ("x" * 95, "x" * 90), ("A  b", "a-b"), (None, "recipe"), ("a" * 89 + " b", "a" * 89 + "-"))
cases("slug_import", text.import_slug, ("Frank's® Hot™ Sauce", "frank-s-hot-sauce"), ("", ""), (None, ""), ("a" * 99 + " b", "a" * 99), ("Jalapeño", "jalapen-o"))
cases("lookup_key", text.lookup_key, ("Egg® (optional)", "egg"), ("Jalapeño", "jalapen o"), ("Jalapeño", "jalapen o"), ("Salt*  &  Pepper", "salt pepper"), ("Tofu™", "tofutm"), (None, ""), ("Dip (sauce not included) mix", "dip mix"))
cases(
    "clean_name", lambda x: _bar(text.clean_name(x), text.is_optional(x)),
    ("Egg® (optional)", "Egg|true"), ("  Sea   Salt** ", "Sea Salt|false"), ("", "Unspecified ingredient|false"), (None, "Unspecified ingredient|false"), ("Oil (not included) extra", "Oil extra|true"), ("Optional herbs", "Optional herbs|true"),
)
cases("folded_tokens", lambda x: _list(text.folded_tokens(x), " "), ("Crème BRÛLÉE, 2x", "creme brulee 2x"), ("Jalapeño", "jalapeno"), (None, ""), ("naïve café", "naive cafe"))
cases("display_name", text.display_name, ("  red   onion ", "Red onion"), ("", None), (None, None), ("x" * 121, None), ("élan", "Élan"), ("aBC", "ABC"))
cases("title_artifact", text.title_artifact, ("2023-W12 Tacos", "true"), ("R12 Tacos", "true"), ("Tacos", "false"), ("TACO TUESDAY", "true"), ("Beef Tacos", "false"), ("", "false"), ("rolls", "false"), ("123 A", "true"))
cases(
    "risky_title", lambda x: text.risky_title(F.get_json_object(x, "$.t"), F.get_json_object(x, "$.p")),
    ({"t": "Copycat Burger", "p": "x"}, "true"), ({"t": "World's Best Chili"}, "true"), ({"t": "Award winning pie"}, "true"), ({"t": "Plain soup", "p": "Foo"}, "false"), ({"t": "Foodie Inc soup", "p": "Foodie Inc"}, "true"),
    ({"t": "Infamous stew"}, "false"), ({"t": "Coke™ cake"}, "true"), ({}, "false"),
)
cases("page_name", lambda x: text.page_name(x.cast("long")), ("1", "page-00001.json"), ("12345", "page-12345.json"))
cases("entity_decode", text.plain_text, ("Fast&nbsp;&amp; easy&#33;", "Fast & easy!"), ("a<br>b &hellip; &deg;C", "a b … &deg;C"), ("&#x41;&amp;lt;", "A&lt;"), ("x <b>y</b> , z", "x y, z"), (None, ""), ("&#1114112;", "&#1114112;"))
cases("structured_output", lambda x: F.to_json(text.json_object(x)), ('{"a":1}', '{"a":1}'), ("[1]", None), ("{broken", None), ("3", None), (None, None))
cases(
    "map_entries", lambda x: _list(F.transform(text.entries(_json(x, "map<string, string>")), lambda e: F.concat_ws(":", e["pos"].cast("string"), e["key"], e["value"]))),
    ({"b": "2", "a": "1"}, "0:a:1,1:b:2"), ({}, ""),
)
cases(
    "prose_join", lambda x: review.final_prose(F.get_json_object(x, "$.s"), F.get_json_object(x, "$.d"), _json(F.get_json_object(x, "$.i"), "array<string>")),
    ({"s": "a", "d": "", "i": ["b", None, "c"]}, "a b c"), ({}, ""), ({"d": "x"}, "x"),
)

# addresses

_SITE = ("https://www.a.example/", ["/recipe/"], ["/print"], ["/list", "page="])
_flags = lambda u: rules.all_matches([
    (urls.listed(u, F.lit(_SITE[0]), F.array(*map(F.lit, _SITE[1])), F.array(*map(F.lit, _SITE[2]))), "listed"),
    (urls.followable(u, F.lit(_SITE[0]), F.array(*map(F.lit, _SITE[3])), F.array(*map(F.lit, _SITE[2]))), "followable"),
    (urls.in_sitemap(u, F.lit(_SITE[0]), F.array(F.lit("cdn.example")), F.array(F.lit("sitemap"))), "in_sitemap"),
    (urls.is_sitemap(u, F.lit("text/html")), "is_sitemap"),
])
cases(
    "crawl_predicates", lambda x: _list(_flags(x)),
    ("https://www.a.example/recipe/1", "listed"), ("https://a.example/recipe/1", ""), ("https://www.a.example/recipe/print/1", ""), ("https://www.a.example/x?from=/print&page=2", "followable"),
    ("https://www.a.example/list/1", "followable"), ("https://cdn.example/sitemap-1.xml.gz", "in_sitemap,is_sitemap"), ("https://www.a.example/recipe/?q=/print", "listed"), ("https://www.a.example/about", ""),
)
ROBOTS = [("/", True), ("/*/1", False), ("/en/1*", True), ("/de", False), ("/q?x=1", False), ("/end$", False), ("", False)]


def _allowed(x: Column) -> Column:
    path = urls.request_of(x)
    hits = [F.when((F.lit(p) != "") & F.rlike(path, urls.rule_pattern(F.lit(p))), F.struct(F.lit(len(p)).alias("n"), F.lit(ok).alias("ok"))) for p, ok in ROBOTS]
    return F.coalesce(F.array_max(F.array_compact(F.array(*hits)))["ok"], F.lit(True))


cases(
    "robots_decision", _allowed,
    ("https://a.example/en/10", "true"), ("https://a.example/fr/10", "false"), ("https://a.example/de", "false"), ("https://a.example/q?x=12", "false"), ("https://a.example/q?y=1", "true"), ("https://a.example/end", "true"),
    ("https://a.example", "true"), ("https://a.example/x?u=/1", "false"),
)
cases(
    "crawl_status_message",
    lambda x: text.bound(
        _json(x, "struct<site: string, found: int, wanted: int, bad: int, drained: boolean>"),
        lambda p: text.bound(increments.crawl_state(p["found"], p["wanted"], p["bad"], p["drained"]), lambda s: F.concat_ws(": ", s, crawl.status_message(p["site"], s, p["found"], p["wanted"], p["bad"]))),
    ),
    ({"site": "a", "found": 0, "wanted": 5, "bad": 0, "drained": True}, "exhausted: ALERT: a has no new recipe URLs. All configured sitemap and pagination sources were exhausted."),
    ({"site": "a", "found": 3, "wanted": 5, "bad": 0, "drained": True}, "exhausted: ALERT: a reached the end of its configured sitemap and pagination sources. No additional URLs were found beyond this final batch (3 URL(s))."),
    ({"site": "a", "found": 3, "wanted": 5, "bad": 2, "drained": True}, "incomplete: ALERT: a found fewer than 5 new recipe URLs, but 2 discovery page(s) failed or were blocked, so exhaustion could not be confirmed."),
    ({"site": "a", "found": 5, "wanted": 5, "bad": 0, "drained": True}, "more: a found a full batch; more recipe URLs may remain."),
    ({"site": "a", "found": 1, "wanted": 5, "bad": 0, "drained": False}, "more: a found a full batch; more recipe URLs may remain."),
)

# pages to candidates

cases(
    "microdata_extract", lambda x: text.microdata(x),
    ('<div itemscope itemtype="https://schema.org/Recipe"><h1 itemprop=name>Soup</h1><li itemprop="recipeIngredient">salt</li><li itemprop="recipeIngredient">salt</li><ul itemprop="recipeInstructions"><li>Mix.</li><li>Boil.</li></ul></div>',
     '{"@type": "Recipe", "name": "Soup", "recipeIngredient": ["salt"], "recipeInstructions": ["Mix.", "Boil."]}'),
    ('<p itemscope itemtype="http://schema.org/Recipe"><b itemprop="name">Author</b><i itemprop="name">Pie</i><meta itemprop="mainEntityOfPage" content="u"><b itemprop="name">Other</b><span itemprop="recipeIngredient">1 egg</span><div itemprop="recipeInstructions">Bake.</div><meta itemprop="prepTime" content="PT5M">',
     '{"@type": "Recipe", "name": "Pie", "prepTime": "PT5M", "recipeIngredient": ["1 egg"], "recipeInstructions": ["Bake."]}'),
    ('<div itemscope itemtype="https://schema.org/Person"><b itemprop="name">x</b></div>', None), ('<div itemscope itemtype="https://schema.org/Recipe"><b itemprop="name">x</b></div>', None), (None, None),
)


def _candidate(x: Column) -> Column:
    def shown(e: Column) -> Column:
        t = e["times"]
        return _bar(e["id"], e["name"], e["description"], numbers.number_text(e["yield"]["quantity"]), e["yield"]["unit"], F.concat_ws("/", *[t[k].cast("string") for k in ("prep_minutes", "cook_minutes", "inactive_minutes")]),
                    _list(e["ingredient_lines"], ";"), _list(e["instruction_lines"], ";"), _list(e["categories"], ";"), e["nutrition"])

    return text.bound(candidates.normalized(x), shown)


cases(
    "normalize_candidate", _candidate,
    ({"@type": "Recipe", "name": "Fast&nbsp;&amp; easy&#33;", "description": "<p>Good</p>", "prepTime": "PT10M", "cookTime": "PT30M", "totalTime": "PT45M", "recipeYield": ["4-6+"], "recipeIngredient": ["1 egg", " "],
      "recipeInstructions": ["Mix.", {"@type": "HowToSection", "itemListElement": [{"text": "Bake."}, {"name": "x"}]}], "recipeCategory": "Dinner, Main", "recipeCuisine": ["Italian", "Dinner"], "keywords": "quick,,easy", "nutrition": {"calories": "1"}},
     'fast-easy|Fast & easy!|Good|4|servings|10/30/5|1 egg|Mix.;Bake.|Dinner;Main;Italian;quick;easy|{"calories": "1"}'),
    ({"@type": "Recipe"}, "untitled-recipe|Untitled recipe||1|servings|0/0/0||||"),
    ({"name": "Jalapeño Dip", "totalTime": "PT5M", "cookTime": "PT10M", "recipeYield": "12 cookies", "ingredients": ["a", "b"], "recipeInstructions": {"text": "Stir."}}, "jalapeno-dip|Jalapeño Dip||12|cookies|0/10/0|a;b|Stir.||"),
)

_EXTRACTED = candidates.EXTRACTED


def _facts(x: Column) -> Column:
    def shown(f: Column) -> Column:
        done = F.transform(f["operations"], lambda o: F.concat_ws("/", o["action"], _list(o["ingredients"], "+"), o["temperature_f"].cast("string"), o["duration_minutes"].cast("string"), o["endpoint"]))
        return _bar(f["status"], f["base_name"], f["meal_type"], f["cuisine"], _list(F.transform(f["ingredients"], lambda i: i["item"]), ";"), _list(done, ";"), _list(f["safety_flags"], ";"))

    return text.bound(candidates.facts(_json(x, _EXTRACTED)), shown)


cases(
    "recipe_facts", _facts,
    ({"name": "Tomato Salad", "yield": {"quantity": 4, "unit": "servings"}, "times": {"prep_minutes": 5, "cook_minutes": 0}, "ingredient_lines": ["2 tomatoes, chopped", "1 tbsp olive oil"],
      "instruction_lines": ["Mix tomatoes; chill for 5 minutes. Serve"], "categories": ["Salad", "Italian"]},
     "usable|Tomato Salad|salad|Italian|tomatoes;olive oil|combine/tomatoes/0/0/;chill//0/5/;serve//0/0/|"),
    ({"name": "Chicken", "yield": {"quantity": 0}, "ingredient_lines": ["1 chicken"], "instruction_lines": [" "], "categories": []}, "skip|Chicken|other||chicken||raw animal protein or egg may require a safe endpoint"),
    ({"name": "Pickles", "yield": {"quantity": 1}, "ingredient_lines": ["3 cucumbers", "1 cup vinegar"], "instruction_lines": ["Ferment for 2 hours until set"], "categories": None},
     "usable|Pickles|other||cucumbers;vinegar|home preservation//0/120/set|manual preservation safety review"),
)
_RECORD = (
    "struct<id: string, name: string, subtitle: string, description: string, meal_type: string, cuisine: string, yield: struct<quantity: double, unit: string>, times: struct<prep_minutes: int, cook_minutes: int>, "
    "ingredients: array<struct<item: string, quantity: string, unit: string, preparation: string>>, instructions: array<struct<step: int, text: string>>, tags: array<string>, notes: array<string>, "
    "allergens: array<string>, dietary: array<string>, nutrition: map<string, string>, source: struct<name: string, url: string, adapted: boolean>>"
)


def _reshaped(x: Column) -> Column:
    def shown(c: Column) -> Column:
        e = c["extracted"]
        pairs = F.transform(F.array_sort(F.map_entries(e["nutrition"])), lambda n: F.concat_ws("=", n["key"], n["value"]))
        return _bar(c["review_status"], c["source"]["name"], _list(e["ingredient_lines"], ";"), _list(e["instruction_lines"], ";"), _list(e["categories"], ";"), _list(pairs, ";"))

    return text.bound(candidates.as_candidate(_json(x, _RECORD)), shown)


cases(
    "candidate_reshape", _reshaped,
    ({"id": "a", "name": "A", "meal_type": "snack", "cuisine": "Thai", "ingredients": [{"item": "oats", "quantity": "1/2", "unit": "cup", "preparation": "toasted"}, {"item": "salt"}],
      "instructions": [{"step": 2, "text": "Eat."}, {"step": 1, "text": "Mix."}], "tags": ["quick", "snack"], "nutrition": {"protein_g": "10", "calories": "90", "sodium_mg": "5"}, "source": {"name": "N", "url": "u"}},
     "archive-recipe|N|1/2 cup oats (toasted);salt|Mix.;Eat.|snack;Thai;quick|calories=90 kcal;proteinContent=10 g;sodiumContent=5 mg"),
    ({"id": "b", "meal_type": "main", "ingredients": [], "instructions": [], "source": {}}, "archive-recipe|Archive|||main|"),
)

# rules

cases(
    "meal_type", rules.meal_type,
    ("Brunch Salad", "breakfast"), ("Tomato Salad", "salad"), ("Beef stew", "soup"), ("Egg wrap", "sandwich"), ("Apple pie", "dessert"), ("Iced tea", "drink"), ("Hot sauce", "sauce"), ("Dinner rolls", "baked-good"),
    ("Rice side dish", "side"), ("Party snack", "snack"), ("Entrée", "main"), ("Main dish", "main"), ("Chicken", "other"), ("pancakes", "other"),
)
cases("cuisine", lambda x: rules.cuisine_of(_json(x, "array<string>")), (["Dinner", "Italian"], "Italian"), (["Mexican inspired bowl"], "Mexican inspired"), ([], ""), (["Thailand"], ""), (["asian fusion", "Greek"], "asian"))


def _operation(x: Column) -> Column:
    items = F.array(F.lit("red onion"), F.lit("whole wheat flour"))
    return text.bound(rules.operation(x, items), lambda o: _bar(o["action"], _list(o["ingredients"], "+"), o["temperature_f"], o["duration_minutes"], o["endpoint"]))


cases(
    "clause_operations", _operation,
    ("whole wheat dough", "preheat|whole wheat flour|0|0|"), ("Sautéed onions", "sauté|red onion|0|0|"), ("Sauté the leeks", "prepare||0|0|"), ("Mix well", "combine||0|0|"), ("Preheat oven to 350°F", "preheat||350|0|"),
    ("Chill for 5 minutes", "chill||0|5|"), ("Bake about 1.5 hours until golden brown", "bake||0|90|golden brown"), ("Serve", "serve||0|0|"), ("Wait", "prepare||0|0|"), ("Top with flour", "add|whole wheat flour|0|0|"),
    ("Cook to 165 degrees F until set", "cook||165|0|set"),
)
cases(
    "clauses", lambda x: _list(rules.clauses(F.array(x)), "|"),
    ("Mix well. Chill for 5 minutes; serve", "Mix well|Chill for 5 minutes|serve"), ("Add 1.5 cups. then stir", "Add 1.5 cups. then stir"), ("", ""), (" ; ;a", "a"),
)
cases("allergens_ordered", lambda x: _list(rules.allergens(x)), ("flour and cream", "milk,wheat"), ("two eggs", ""), ("egg, tofu", "eggs,soy"), ("Tahini; crab", "shellfish,sesame"), ("coconut milk", "milk"), ("plain rice", ""), ("peanut butter", "milk,peanuts"))
cases(
    "diet_reconcile", lambda x: _list(rules.reconciled_diets(F.array(*map(F.lit, ("vegan", "nut-free", "vegetarian", "dairy-free", "egg-free", "gluten-free", "vegan"))), _json(x, "array<string>"))),
    ([], "vegan,nut-free,vegetarian,dairy-free,egg-free,gluten-free"), (["milk"], "nut-free,vegetarian,egg-free,gluten-free"), (["fish"], "nut-free,dairy-free,egg-free,gluten-free"),
    (["peanuts", "wheat"], "vegan,vegetarian,dairy-free,egg-free"), (["eggs"], "nut-free,vegetarian,dairy-free,gluten-free"),
)


def _safety(x: Column) -> Column:
    p = _json(x, "struct<title: string, foods: array<struct<item: string, preparation: string>>, steps: string, ops: string, flags: string>")
    return text.bound(p, lambda q: _list(rules.food_safety(rules.active_foods(q["foods"]), F.coalesce(q["steps"], F.lit("")), F.coalesce(q["title"], F.lit("")), q["ops"], q["flags"]), "; "))


def _food(item: str, preparation: str | None = None) -> list:
    return [{"item": item, "preparation": preparation}]


cases(
    "safety_ladder", _safety,
    ({"title": "Chicken Casserole", "foods": _food("chicken"), "steps": "bake"}, "meat or egg casserole directions must specify 165°F"), ({"title": "casserole", "foods": _food("chicken"), "steps": "bake to 165 degrees F"}, ""),
    ({"foods": _food("chicken"), "steps": "fry"}, "poultry directions must specify 165°F"), ({"foods": _food("canned chicken"), "steps": "mix"}, ""), ({"foods": _food("chicken", "cooked"), "steps": "mix"}, ""),
    ({"foods": _food("ground beef"), "steps": "cook to 155°F"}, "ground meat, sausage, rabbit, or venison directions must specify 160°F"),
    ({"foods": _food("steak"), "steps": "grill to 145°F"}, "whole-cut meat directions must specify 145°F and a 3-minute rest"), ({"foods": _food("steak"), "steps": "grill to 145°F; 3-minute rest"}, ""),
    ({"foods": _food("steak"), "steps": "145 f, then rest it for three minutes"}, ""), ({"foods": _food("cod"), "steps": "bake"}, "fish directions must specify 145°F or an opaque, easily flaked endpoint"),
    ({"foods": _food("cod"), "steps": "bake until it flakes easily"}, ""), ({"foods": _food("shrimp"), "steps": "boil"}, "shellfish directions must specify an opaque or open-shell endpoint"), ({"foods": _food("shrimp"), "steps": "boil until opaque"}, ""),
    ({"foods": _food("egg"), "steps": "whisk", "flags": "raw animal protein or egg may require a safe endpoint"}, "raw-egg directions must specify 160°F or a firm, fully set endpoint"),
    ({"foods": _food("egg"), "steps": "fry until the yolk is firm", "flags": "egg"}, ""), ({"foods": _food("egg"), "steps": "whisk"}, ""),
    ({"foods": _food("beans"), "steps": "x", "ops": "canning "}, "home canning, fermentation, preservation, or sous-vide methods require manual safety review"),
)

# ingredients and dishes of a legacy collection


def _ingredient(southern: bool) -> Callable[[Column], Column]:
    def of(x: Column) -> Column:
        return text.bound(text.lookup_key(x), lambda k: text.bound(F.struct(k.alias("k"), produce.category(k).alias("c")), lambda p: _bar(p["c"], _list(produce.seasons(p["k"], p["c"], southern)), _list(produce.name_allergens(p["k"])))))

    return of


cases(
    "first_match_category", _ingredient(False),
    ("Fresh Mozzarella", "dairy|year-round|milk"), ("Coconut Milk", "other|year-round|"), ("Bold & Savory Steak Spice", "spice|year-round|"), ("Eggplant", "produce|summer,fall|"), ("Yukon Gold Potatoes", "produce|fall,winter|"),
    ("Potato Buns", "grain|year-round|"), ("Soy Sauce", "condiment|year-round|soy"), ("Egg", "protein|year-round|eggs"), ("Black Beans", "legume|year-round|"), ("Fresh Basil", "herb|summer,fall|"), ("Kosher Salt", "spice|year-round|"),
    ("Olive Oil", "oil|year-round|"), ("Brown Sugar", "sweetener|year-round|"), ("Cocoa", "baking|year-round|"), ("Apple Cider", "beverage|year-round|"), ("Paper towel", "other|year-round|"), ("Asparagus", "produce|spring|"),
    ("Dried Cranberries", "produce|year-round|"), ("Strawberries", "produce|spring,summer|"), ("Lime", "produce|winter,year-round|"), ("Mint", "herb|spring,summer|"), ("Corn Flour", "baking|year-round|"), ("Rice Noodles", "grain|year-round|"),
    ("All-Purpose Flour", "baking|year-round|wheat"), ("Vegan Mayo", "condiment|year-round|"), ("Mayo", "condiment|year-round|eggs"), ("Almond Milk", "other|year-round|tree-nuts"), ("Peanut Butter", "dairy|year-round|milk,peanuts"),
    ("Sesame Noodles", "grain|year-round|wheat,sesame"), ("Cod", "protein|year-round|fish"), ("Shrimp", "protein|year-round|shellfish"), ("Bunch of thyme", "grain|year-round|"),
)
cases("seasons_southern", _ingredient(True), ("Asparagus", "produce|fall|"), ("Strawberries", "produce|fall,winter|"), ("Lime", "produce|summer,year-round|"), ("Tomato", "produce|winter,spring|"), ("Salt", "spice|year-round|"))
cases(
    "all_match_flags", lambda x: _list(produce.equipment(x)),
    ("Heat the Oven; brown in a large pan.", "oven,skillet"), ("Boil in a medium pot, then drain.", "saucepan,colander"), ("Use a slow cooker or microwave", "microwave,slow cooker"), ("Blend in a food processor", "food processor"), (None, ""),
    ("Grill on a baking sheet", "baking sheet,grill"),
)


def _seasons(x: Column) -> Column:
    p = _json(x, "struct<title: string, foods: array<struct<name: string, seasons: array<string>>>>")
    return text.bound(p, lambda q: _list(produce.seasons_of_scores(produce.season_scores(F.lower(q["title"]), F.get(F.split(F.lower(q["title"]), " with "), F.lit(0)), q["foods"]))))


cases(
    "season_scores", _seasons,
    ({"title": "Summer Tomato Salad", "foods": [{"name": "tomato", "seasons": ["summer", "fall"]}]}, "summer"), ({"title": "Hearty Lentil Soup", "foods": [{"name": "lentil", "seasons": ["year-round"]}]}, "fall,winter"),
    ({"title": "Banana Cake", "foods": [{"name": "banana", "seasons": ["year-round"]}]}, "year-round"), ({"title": "Strawberry Spritz", "foods": [{"name": "strawberry", "seasons": ["spring", "summer"]}]}, "spring,summer"),
    ({"title": "Toast with Peach", "foods": [{"name": "peach", "seasons": ["summer"]}]}, "year-round"), ({"title": "Autumn plate", "foods": []}, "fall"),
)
cases(
    "import_meal_type", lambda x: produce.dish_type(produce.leading_dish(x)),
    ("Crispy Parmesan Chicken with Apple Crisp", "main"), ("Prosciutto-Wrapped Chicken", "main"), ("Beef & Mushroom Shepherd’s Pie", "main"), ("Bavette Steak & Sherry Shallot Sauce", "main"),
    ("Nectarine and Zucchini Panzanella", "salad"), ("Sweet Thai Chili Steak", "main"), ("Chopped Chicken Caesar Salad Sandwiches", "sandwich"), ("Country Chicken Honey Butter Biscuits", "main"),
    ("Homestyle Beef & Biscuit Pot Pie", "main"), ("White Bean Chili", "soup"), ("Berry Smoothie", "drink"), ("Overnight Oats", "breakfast"), ("Garlic Bread", "baked-good"), ("Pizza Bites", "snack"),
    ("Garlic Mashed Potatoes", "side"), ("Basil Pesto", "sauce"), ("Apple Pie", "dessert"), ("Pot Pie", "main"), (None, "main"),
)
cases(
    "import_cuisine", lambda x: produce.title_cuisine(text.lookup_key(x)),
    ("Chicken Tikka Masala", "Indian"), ("Tacos", "Mexican"), ("Pad Thai", "Thai"), ("Banh Mi bowl", "Vietnamese"), ("Phoenix rolls", None), ("Shawarma", "Middle Eastern"), ("Greek Tacos", "Mexican"), ("Steak", None), ("Miso soup", "Japanese"),
    ("Za'atar flatbread", "Middle Eastern"),
)


def _dish(x: Column) -> Column:
    p = _json(x, "struct<type: string, difficulty: string, tags: array<string>, allergens: array<string>, names: array<string>>")

    def of(q: Column) -> Column:
        found = produce.dish_allergens(q["tags"], q["allergens"])
        return text.bound(F.struct(q.alias("q"), found.alias("f")), lambda r: _bar(_list(r["f"]), _list(produce.dish_diets(r["q"]["tags"], r["f"], r["q"]["names"]))))

    return text.bound(p, of)


cases(
    "import_diets", _dish,
    ({"tags": ["Contains Milk", "Veggie"]}, "milk|vegetarian,nut-free,egg-free"), ({"tags": ["Vegan"], "allergens": ["milk"]}, "milk|vegetarian,nut-free,egg-free"),
    ({"tags": ["Vegan", "Gluten free"], "names": ["tofu"]}, "|vegetarian,vegan,gluten-free,dairy-free,nut-free,egg-free"), ({"tags": ["Gluten-Free"], "allergens": ["wheat"]}, "wheat|dairy-free,nut-free,egg-free"),
    ({"tags": ["Vegetarian"], "names": ["chicken thigh"]}, "|dairy-free,nut-free,egg-free"), ({"tags": ["Vegetarian"], "names": ["vegan sausage"]}, "|vegetarian,dairy-free,nut-free,egg-free"),
    ({"tags": ["veggie"], "names": ["beefsteak tomato"]}, "|vegetarian,dairy-free,nut-free,egg-free"), ({"tags": ["Tree Nuts", "eggs"]}, "eggs,tree-nuts|dairy-free"), ({}, "|dairy-free,nut-free,egg-free"),
)


def _tags(x: Column) -> Column:
    p = _json(x, "struct<type: string, difficulty: string, tags: array<string>>")
    return _list(produce.dish_tags(p["type"], p["difficulty"], p["tags"]))


cases(
    "import_tags", _tags,
    ({"type": "salad", "difficulty": "Easy", "tags": ["Spicy", "Veggie", "Contains Milk", "New", "One Pot"]}, "salad,easy,spicy,one-pot,needs-review"), ({"type": "main", "difficulty": "", "tags": []}, "main,needs-review"),
    ({"type": "soup", "difficulty": "Level 2!", "tags": ["Soup"]}, "soup,level-2,needs-review"), ({"type": "main"}, "main,needs-review"),
)
cases("meal_folder", produce.folder, ("main", "mains"), ("baked-good", "baked-goods"), ("breakfast", "breakfast"), ("salad", "salads"), ("other", "other"))

# reviews

_FACTS = "struct<status: string, reason: string, operations: array<struct<action: string, endpoint: string>>, safety_flags: array<string>>"
_GENERATED = "struct<status: string, reason: string, confidence: int, variation_changes: array<string>>"


def _automatic(x: Column) -> Column:
    p = _json(x, f"struct<f: {_FACTS}, g: {_GENERATED}, r: {_RECORD}>")
    return text.bound(p, lambda q: _list(review.automatic_reasons(q["f"], q["g"], q["r"]), "; "))


_GOOD = {
    "f": {"status": "usable", "operations": [], "safety_flags": []}, "g": {"status": "promote", "confidence": 90, "variation_changes": ["x"]},
    "r": {"name": "Rice", "tags": ["side"], "ingredients": [{"item": "rice"}, {"item": "water"}], "instructions": [{"text": "Boil."}], "allergens": [], "dietary": ["vegan"]},
}
cases(
    "automatic_review", _automatic,
    (_GOOD, ""), (_GOOD | {"f": {"status": "skip", "reason": "no title", "operations": [], "safety_flags": []}}, "fact extraction skipped: no title"),
    (_GOOD | {"g": {"status": "skip", "reason": "vague", "confidence": 40, "variation_changes": []}}, "authoring skipped: vague; confidence 40 is below 85"),
    (_GOOD | {"g": {"status": "promote", "confidence": 85, "variation_changes": []}}, "no editorial rewrite was recorded"),
    (_GOOD | {"r": {"name": "Cheese", "tags": [], "ingredients": [{"item": "cheese"}], "instructions": [], "allergens": [], "dietary": []}}, "fewer than two ingredients; missing instructions; missing tags; possible undeclared milk allergen"),
    (_GOOD | {"r": {"name": "Nut bread", "tags": ["x"], "ingredients": [{"item": "bread"}, {"item": "walnut"}], "instructions": [{"text": "Mix."}], "allergens": ["wheat", "tree-nuts", "milk"], "dietary": ["dairy-free", "gluten-free", "nut-free", "vegan"]}},
     "dairy-free conflicts with milk allergen; gluten-free conflicts with wheat allergen; nut-free conflicts with nut allergen; vegan conflicts with animal-derived ingredients"),
    (_GOOD | {"r": {"name": "Chicken", "tags": ["x"], "ingredients": [{"item": "chicken"}, {"item": "egg"}], "instructions": [{"text": "Fry."}], "allergens": ["eggs"], "dietary": ["egg-free"]}},
     "poultry directions must specify 165°F; egg-free conflicts with egg allergen"),
)
_REVIEW = (
    "struct<decision: string, confidence: int, copyright_risk: string, semantic_similarity: int, structural_similarity: int, distinctive_expression_matches: array<string>, "
    "likely_brand_terms: array<string>, trademark_risk: string, title_is_generic: boolean, implied_affiliation: boolean, reasons: array<string>>"
)
_PASS = {
    "decision": "pass", "confidence": 90, "copyright_risk": "low", "semantic_similarity": 10, "structural_similarity": 20, "distinctive_expression_matches": [], "likely_brand_terms": [], "trademark_risk": "low",
    "title_is_generic": True, "implied_affiliation": False, "reasons": [],
}


def _publication(x: Column) -> Column:
    p = _json(x, f"struct<v: {_REVIEW}, prose: double, step: double, brands: array<string>>")
    return text.bound(p, lambda q: _list(review.publication_reasons(q["v"], q["prose"], q["step"], q["brands"]), "; "))


def _published(change: dict, prose: float = 10.0, step: float = 20.0, brands: tuple = ()) -> dict:
    return {"v": _PASS | change, "prose": prose, "step": step, "brands": list(brands)}


cases(
    "publication_review", _publication,
    (_published({}), ""), (_published({"decision": "hold", "reasons": ["a", "b"]}), "independent publication review held the recipe: a; b"), (_published({"decision": "hold"}), "independent publication review held the recipe: unspecified concern"),
    (_published({"confidence": 79, "copyright_risk": "high"}), "publication-review confidence 79 is below 80; publication review found high expression-copying risk"),
    (_published({"semantic_similarity": 85, "structural_similarity": 90}), "semantic similarity 85% is too high; instruction-structure similarity 90% is too high"),
    (_published({"distinctive_expression_matches": ["x", "y"], "likely_brand_terms": ["m", "n"]}), "possible distinctive expression overlap: x | y; publication review found possible brand terms: m, n"),
    (_published({"trademark_risk": "medium", "title_is_generic": False, "implied_affiliation": True}),
     "publication review found medium trademark risk; recipe title may identify a brand, publisher, or distinctive source title; recipe presentation may imply affiliation or endorsement"),
    (_published({}, 50.0, 70.5, ("Coke",)), "source/final prose trigram overlap is 50%; a final instruction overlaps a source instruction by 70.5%; configured brand terms require review: Coke"),
)


def _deterministic(x: Column) -> Column:
    p = _json(x, "struct<prose: double, step: double, brands: array<string>, risky: boolean>")

    def of(q: Column) -> Column:
        d = rules.disposition(q["prose"], q["step"], q["brands"], q["risky"])
        shown = lambda r: _bar(r["d"]["mode"], r["v"]["decision"], r["v"]["copyright_risk"], r["v"]["semantic_similarity"], r["v"]["structural_similarity"], r["v"]["title_is_generic"], _list(r["v"]["reasons"], "; "))
        reviewed = lambda e: F.struct(e.alias("d"), review.publication_review(q["prose"], q["step"], e["mode"], e["reasons"], q["risky"]).alias("v"))
        return text.bound(text.bound(d, reviewed), shown)

    return text.bound(p, of)


cases(
    "deterministic_review", _deterministic,
    ({"prose": 8.4, "step": 15.5, "brands": [], "risky": False}, "pass|pass|low|8|16|true|Deterministic expression, structure, title, and brand checks passed."),
    ({"prose": 25.0, "step": 40.0, "brands": [], "risky": False}, "model|hold|medium|25|40|true|deterministic similarity is borderline and requires model review"),
    ({"prose": 55.0, "step": 75.5, "brands": [], "risky": False}, "hold|hold|medium|55|76|true|source/final prose trigram overlap is 55%; a final instruction overlaps a source instruction by 75.5%"),
    ({"prose": 0.0, "step": 0.0, "brands": ["Coke", "copycat"], "risky": True}, "hold|hold|medium|0|0|false|configured brand terms require review: Coke, copycat; recipe title may identify a brand, publisher, or promotional source title"),
)


def _issues(x: Column) -> Column:
    p = _json(x, f"struct<c: struct<candidate_version: string, review_status: string, source: struct<url: string>, extracted: struct<description: string, instruction_lines: array<string>>>, r: {_RECORD}>")
    return _list(review.promotion_issues(p["c"], p["r"]), "; ")


_CANDIDATE = {"candidate_version": "1.0.0", "review_status": "needs-review-and-original-wording", "source": {"url": "u"}, "extracted": {"description": "", "instruction_lines": ["Whisk the eggs and sugar until the mixture is pale and thick"]}}
_FINAL = {"source": {"url": "u", "adapted": True}, "tags": ["x"], "instructions": [{"step": 1, "text": "Beat eggs."}]}
cases(
    "promotion_issues", _issues,
    ({"c": _CANDIDATE, "r": _FINAL}, ""), ({"c": _CANDIDATE | {"candidate_version": "2"}, "r": _FINAL}, "input is not a supported review candidate"),
    ({"c": _CANDIDATE | {"source": {}}, "r": _FINAL}, "candidate is missing its source URL; final recipe must retain the candidate source URL"),
    ({"c": _CANDIDATE, "r": _FINAL | {"source": {"url": "v"}, "tags": ["needs-review"]}}, "final recipe must retain the candidate source URL; final recipe source must set adapted to true; final recipe still has the needs-review tag"),
    ({"c": _CANDIDATE, "r": _FINAL | {"notes": ["REWRITE REQUIRED: x"]}}, "final recipe still contains a rewrite placeholder"),
    ({"c": _CANDIDATE, "r": _FINAL | {"instructions": [{"step": 1, "text": "Then whisk the eggs and sugar until the mixture is smooth"}]}}, 'final prose repeats source wording: "whisk the eggs and sugar until the mixture"'),
)
_TERMS = [("Coke", "cola"), ("Crème Co", "cream"), ("coke", "soda")]


def _brands(x: Column) -> Column:
    p = _json(x, "struct<t: string, p: string>")
    return _list(F.transform(review.brand_terms(F.coalesce(p["t"], F.lit("")), p["p"], _TERMS), lambda b: F.concat_ws("=", b["term"], b["generic"])), ";")


cases(
    "detected_brands", _brands,
    ({"t": "A COKE float", "p": "x"}, "coke=soda"), ({"t": "Creme Co cake, copycat", "p": "Big Mill"}, "Crème Co=cream;copycat=generic recipe title"), ({"t": "Soup by Big Mill™", "p": "Big Mill"}, "Big Mill=publisher name;®/™ symbol=generic product name"),
    ({"t": "Cokes", "p": "Cok"}, ""), ({}, ""),
)


def _overlap(x: Column) -> Column:
    p = _json(x, "struct<a: array<string>, b: array<string>>")

    def of(q: Column) -> Column:
        o, m = review.overlap(_list(q["a"], " "), _list(q["b"], " "), q["a"], q["b"]), review.prose_metrics(_list(q["a"], " "), _list(q["b"], " "))
        return _bar(o["prose_percent"], o["step_percent"], o["source_steps"], o["final_steps"], m["source_words"], m["final_words"], m["change_percent"])

    return of(p)


cases(
    "overlap", _overlap,
    ({"a": ["Mix the crème well"], "b": ["mix the creme well"]}, "100.0|100.0|1|1|5|4|-20.0"), ({"a": ["one two three four"], "b": ["one two three five", "x"]}, "25.0|33.3|1|2|4|5|25.0"), ({"a": [], "b": ["x y z"]}, "0.0|0.0|0|1|0|3|0.0"),
)
cases(
    "retry_guidance", lambda x: _list(F.transform(review.guidance(_json(x, "array<string>")), lambda g: F.substring(g, 1, 12)), "|"),
    (["confidence 40 is below 85"], "Return a com"), (["Title may identify a brand"], "Use a shorte"), (["allergen conflict", "semantic similarity 90%"], "Rewrite ever|Classify die"), (["poultry"], "Add the appl"), (["missing tags"], "Produce a mo"), ([], "Produce a mo"),
)
cases(
    "record_status", lambda x: review.record_status(_json(F.get_json_object(x, "$.c"), "array<string>"), _json(F.get_json_object(x, "$.r"), "array<string>")),
    ({"c": ["x"], "r": ["y"]}, "needs-review"), ({"c": [], "r": ["y"]}, "publication-hold"), ({"c": [], "r": []}, "ready"),
)
_ENTRY = "struct<status: string, basis: string, evidence: string, reviewed_at: string, expires_at: string>"
_APPROVED = {"status": "approved", "basis": "cc0", "evidence": "doc", "reviewed_at": "2026-01-01", "expires_at": ""}


def _rights(x: Column) -> Column:
    p = _json(x, f"struct<h: string, e: {_ENTRY}>")
    return _list(gates.rights_issues(p["h"], p["e"], F.lit("2026-03-01 12:00:00").cast("timestamp"), F.lit(90)), "; ")


cases(
    "rights_issues", _rights,
    ({"h": "a.example", "e": _APPROVED}, ""), ({"h": "", "e": _APPROVED}, "candidate source URL has no valid hostname"), ({"h": "b.example"}, "no publication-rights record exists for b.example"),
    ({"h": "a", "e": _APPROVED | {"status": "draft-only", "basis": "unverified", "evidence": " "}}, "a is marked draft-only; a has no verified publication-rights basis; a has no publication-rights evidence reference"),
    ({"h": "a", "e": _APPROVED | {"reviewed_at": "2025-11-01"}}, "a rights review is 120 days old"), ({"h": "a", "e": _APPROVED | {"reviewed_at": "2026-02-30"}}, "a has no valid rights review date"),
    ({"h": "a", "e": _APPROVED | {"expires_at": "soon"}}, "a has an invalid rights expiry date"), ({"h": "a", "e": _APPROVED | {"expires_at": "2026-03-01"}}, "a publication rights expired on 2026-03-01"),
    ({"h": "a", "e": _APPROVED | {"expires_at": "2026-03-02"}}, ""),
)
_ISSUES_OF = lambda r: staging.schema_issues(r, [("n must be above 0", r["n"] > 0), ("s must not be empty", F.coalesce(r["s"], F.lit("")) != "")])
cases(
    "schema_issues", lambda x: _list(_ISSUES_OF(_json(x, "struct<n: int, s: string>")), "; "),
    ({"n": 1, "s": "a"}, ""), ({"n": 0}, "n must be above 0; s must not be empty"), ({"s": "x"}, "n must be above 0"), (None, "is missing"),
)
cases("without_id", lambda x: _list(resolve.without_id(_json(x, "array<struct<ingredient_id: string, item: string>>"))), ([{"ingredient_id": "a", "item": "A"}, {"item": "B"}, {"ingredient_id": "", "item": "C"}], "B,C"), ([], ""))
cases(
    "promotable", lambda x: text.bound(_json(x, "struct<t: array<string>, s: string>"), lambda r: legacy.promotable(r, r["t"])),
    ({"t": ["a"], "s": "Mix."}, "true"), ({"t": ["needs-review"], "s": "Mix."}, "false"), ({"t": [], "s": "REWRITE REQUIRED: x"}, "false"), ({"s": "x"}, "true"),
)
