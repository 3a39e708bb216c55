"""Ordered rules as data, with two ways to apply them: the first that holds, or all that hold in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import bound, contains_term

B, E = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first (label, pattern) whose pattern is found."""
    return F.coalesce(*[F.when(F.rlike(text, F.lit(p)), F.lit(label)) for label, p in rules], F.lit(default))


def all_matches(conditions: list[tuple[Column, str]], *more: Column) -> Column:
    """Labels of all conditions that hold, in the given order, then further labels that are not null."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in conditions], *more))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def words(*terms: str) -> str:
    return f"(?i){B}(?:{'|'.join(terms)}){E}"


#: Meal types by words of a title and its categories, first match. Fixed values.
MEAL_TYPES = [
    ("breakfast", words("breakfast", "brunch")), ("salad", words("salad")), ("soup", words("soup", "stew", "chowder", "bisque")),
    ("sandwich", words("sandwich", "burger", "quesadilla", "wrap")), ("dessert", words("dessert", "cake", "cookie", "pie", "candy", "pudding", "ice cream")),
    ("drink", words("drink", "beverage", "cocktail", "smoothie", "coffee", "tea")), ("sauce", words("sauce", "dressing", "marinade", "dip")),
    ("baked-good", words("bread", "muffin", "biscuit", "scone", "rolls?")), ("side", words("side dish", "side")), ("snack", words("snack", "appetizer")),
    ("main", words("dinner", "lunch", "main dish", "entree", "entr[éÉ]e")),
]
#: Actions of an instruction clause, first match; without a word boundary in front. Fixed values.
ACTIONS = [
    ("preheat", "preheat|heat"), ("combine", "combine|mix"), ("whisk", "whisk|beat|cream"), ("fold", "fold"), ("stir", "stir"), ("blend", "blend"), ("knead", "knead"),
    ("cut", "slice|cut|chop|dice|mince|trim"), ("shape", "shape|form|roll"), ("coat", "coat|dredge"), ("layer", "layer"), ("add", "add|sprinkle|top"),
    ("transfer", "pour|transfer|place|arrange|spread"), ("bake", "bake"), ("roast", "roast"), ("grill", "grill|broil"), ("sauté", "fry|saute|saut[éÉ](?=[0-9A-Za-z_])"), ("microwave", "microwave"),
    ("home preservation", "canning|ferment|fermentation|preserv|sous vide"), ("simmer", "boil|simmer|poach"), ("cook", "cook|steam"), ("chill", "chill|refrigerate"),
    ("freeze", "freeze"), ("cool", "cool"), ("rest", "rest"), ("drain", "drain"), ("shred", "shred|pull"), ("garnish", "decorate|garnish"), ("serve", "serve|plate"),
]
#: Allergens by terms in their exact form, in output order. Fixed values.
ALLERGENS = {
    "milk": ["butter", "cheese", "cream", "feta", "ghee", "milk", "yogurt"], "eggs": ["egg"], "fish": ["anchovy", "cod", "fish", "salmon", "tuna"],
    "shellfish": ["clam", "crab", "lobster", "mussel", "oyster", "shrimp"], "tree-nuts": ["almond", "cashew", "hazelnut", "pecan", "pistachio", "walnut"],
    "peanuts": ["peanut"], "wheat": ["bread", "flour", "pasta", "wheat"], "soy": ["soy", "tofu"], "sesame": ["sesame", "tahini"],
}
#: Cuisines that a category may name. Fixed values.
CUISINES = rf"(?i){B}(?:" + "|".join(("american", "asian", "british", "chinese", "french", "greek", "indian", "italian", "japanese", "korean", "mediterranean", "mexican", "spanish", "thai", "vietnamese")) + rf")(?: inspired)?{E}"
#: Diets that an allergen contradicts. Fixed values.
CONTRADICTED = {
    "dairy-free": ["milk"], "egg-free": ["eggs"], "gluten-free": ["wheat"], "nut-free": ["tree-nuts", "peanuts"],
    "vegan": ["milk", "eggs", "fish", "shellfish"], "vegetarian": ["fish", "shellfish"],
}


def meal_type(text: Column) -> Column:
    return first_match(text, MEAL_TYPES, "other")


def _by_letter(terms: list[str]) -> str:
    """Alternatives by their first letter, so a place of a text tries those of its own letter only."""
    letters: dict[str, list[str]] = {}
    for term in terms:
        letters.setdefault(term[0], []).append(term[1:])
    return "|".join(f"{letter}(?:{'|'.join(rests)})" for letter, rests in letters.items())


def action(clause: Column) -> Column:
    """An accent is no word character, so a word that ends in one only ends where another letter follows.

    The clause is read once for all terms: a term ends where its word does, so none hides another's action.
    """
    terms = [(x, i) for i, (_, p) in enumerate(ACTIONS) for x in p.split("|")]
    pattern = f"(?i)(?:{_by_letter([x if x.endswith(')') else x + E for x, _ in terms])})"
    places = F.create_map(*[F.lit(y) for x, i in terms for y in (x.split("(")[0].replace("[éÉ]", "é"), i)])
    found = F.transform(F.regexp_extract_all(clause, F.lit(pattern), F.lit(0)), lambda x: F.try_element_at(places, F.lower(x)))
    return F.coalesce(F.get(F.array(*[F.lit(label) for label, _ in ACTIONS]), F.array_min(found)), F.lit("prepare"))


def allergens(text: Column) -> Column:
    low = F.lower(text)
    return all_matches([(any_of([contains_term(low, t) for t in terms]), name) for name, terms in ALLERGENS.items()])


def reconciled_diets(diets: Column, found: Column) -> Column:
    """Distinct diets less those that an allergen contradicts. The allergens and the diets that go are found once a row."""

    def without(allergic: Column) -> Column:
        gone = all_matches([(any_of([F.array_contains(allergic, a) for a in by]), diet) for diet, by in CONTRADICTED.items()])
        return bound(gone, lambda g: F.filter(F.array_distinct(diets), lambda d: ~F.array_contains(g, d)))

    return bound(found, without)


def clauses(lines: Column) -> Column:
    """Lines cut at semicolons and at full stops before a capital."""
    return F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, r";|\.(?=\s+[A-Z])"))), lambda c: F.trim(c)), lambda c: c != "")


def clause_minutes(clause: Column) -> Column:
    pattern = rf"(?i){B}(\d+(?:\.\d+)?)\s*(hours?|hrs?|minutes?|mins?){E}"
    number = F.nullif(F.regexp_extract(clause, pattern, 1), F.lit("")).try_cast("double")
    return F.coalesce(F.floor(number * F.when(F.startswith(F.lower(F.regexp_extract(clause, pattern, 2)), F.lit("h")), 60).otherwise(1) + 0.5), F.lit(0)).cast("long")


def clause_fahrenheit(clause: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(clause, rf"(?i){B}(\d{{2,3}})\s*(?:°|degrees?\s*)?F{E}", 1), F.lit("")).try_cast("int"), F.lit(0))


#: Where an operation ends. Fixed values.
ENDPOINTS = words(
    "golden brown", "lightly browned", "tender", "smooth", "soft peaks?", "stiff peaks?", "melted", "thick(?:ened)?", "set", "firm", "opaque", "easily flaked", "cooked through", "combined",
    "evenly coated", "boiling", "simmering", "frozen solid",
)
#: Animal foods, methods of preservation, and words of foods that are done already. Fixed values.
ANIMAL = words(
    "chicken", "duck", "turkey", "beef", "pork", "veal", "lamb", "goat", "sausage", "rabbit", "venison", "fish", "salmon", "tuna", "cod", "egg", "shrimp", "shellfish", "oyster", "mussel",
    "clam", "crab", "lobster",
)
PRESERVING = words("canning", "ferment", "fermentation", "preserv", "sous vide")
DONE = words("canned", "cooked", "precooked", "rotisserie", "deli", "smoked", "hard-boiled")


def endpoint(clause: Column) -> Column:
    return F.lower(F.regexp_extract(clause, ENDPOINTS, 0))


def named_by(items: Column) -> Column:
    """Items as structs with the words that name them in a clause: those of four letters or more, lower-cased."""
    words_of = lambda item: F.transform(F.filter(F.split(item, r"\s+"), lambda w: F.length(w) >= 4), lambda w: F.lower(w))
    return F.transform(items, lambda item: F.struct(item.alias("item"), words_of(item).alias("words")))


def operation(clause: Column, items: Column) -> Column:
    """A clause as a struct of action, the items it names (a word of four letters or more), temperature_f, duration_minutes and endpoint."""
    return F.get(operations(F.array(clause), named_by(items)), F.lit(0))


def operations(found: Column, named: Column) -> Column:
    """operation() of each clause, by items as named_by() gives them."""

    def one(clause: Column) -> Column:
        foods = bound(F.lower(clause), lambda low: F.filter(named, lambda x: F.exists(x["words"], lambda w: F.contains(low, w))))
        return F.struct(
            action(clause).alias("action"), F.array_distinct(F.transform(foods, lambda x: x["item"])).alias("ingredients"), clause_fahrenheit(clause).alias("temperature_f"),
            clause_minutes(clause).alias("duration_minutes"), endpoint(clause).alias("endpoint"),
        )

    return F.transform(found, one)


def cuisine_of(categories: Column) -> Column:
    """The first category's words that name a cuisine; empty if none does."""
    found = F.filter(F.transform(categories, lambda c: F.regexp_extract(c, CUISINES, 0)), lambda x: x != "")
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def safety_flags(items: Column, lines: Column) -> Column:
    low = lambda a: F.lower(F.array_join(a, " "))
    return all_matches([
        (F.rlike(low(items), F.lit(ANIMAL)), "raw animal protein or egg may require a safe endpoint"),
        (F.rlike(low(lines), F.lit(PRESERVING)), "manual preservation safety review"),
    ])


def holding_reasons(prose: Column, step: Column, brands: Column, risky: Column) -> Column:
    """Why a record is held: brand terms, its title, its prose's or a step's overlap in percent."""
    shown = lambda p: F.when(p == F.floor(p), F.floor(p).cast("string")).otherwise(p.cast("string"))
    return F.array_compact(
        F.array(
            F.when(F.size(brands) > 0, F.concat(F.lit("configured brand terms require review: "), F.array_join(brands, ", "))),
            F.when(risky, F.lit("recipe title may identify a brand, publisher, or promotional source title")),
            F.when(prose >= 50, F.concat(F.lit("source/final prose trigram overlap is "), shown(prose), F.lit("%"))),
            F.when(step >= 70, F.concat(F.lit("a final instruction overlaps a source instruction by "), shown(step), F.lit("%"))),
        )
    )


def disposition(prose: Column, step: Column, brands: Column, risky: Column) -> Column:
    """A struct of mode (hold, model or pass) and its reasons, by overlap percentages, brand terms and title."""

    def made(p: Column) -> Column:
        between = (p["prose"] >= 20) | (p["step"] >= 35)
        mode = F.when(F.size(p["reasons"]) > 0, F.lit("hold")).when(between, F.lit("model")).otherwise(F.lit("pass"))
        borderline = F.array(F.lit("deterministic similarity is borderline and requires model review"))
        reasons = F.when(F.size(p["reasons"]) > 0, p["reasons"]).when(between, borderline).otherwise(F.array().cast("array<string>"))
        return F.struct(mode.alias("mode"), reasons.alias("reasons"))

    return bound(F.struct(prose.cast("double").alias("prose"), step.cast("double").alias("step"), holding_reasons(prose, step, brands, risky).alias("reasons")), made)


def active_foods(ingredients: Column) -> Column:
    """Items and preparations, lower-cased, of those ingredients (structs) that are not done already."""
    each = F.transform(ingredients, lambda i: F.concat(i["item"], F.lit(" "), F.coalesce(i["preparation"], F.lit(""))))
    return F.lower(F.array_join(F.filter(each, lambda x: ~F.rlike(x, F.lit(DONE))), " "))


def food_safety(foods: Column, directions: Column, title: Column, operations: Column = None, flags: Column = None) -> Column:
    """Reasons for review: home preservation, the meat ladder (casserole, poultry, ground, whole cut), fish, shellfish, eggs.

    foods: active_foods(); directions: all steps; title: name and tags; operations: actions and endpoints; flags: safety_flags() joined.
    """
    nothing = F.lit("")
    has = lambda text, *terms: F.rlike(F.lower(F.coalesce(text, nothing)), F.lit(words(*terms)))
    heat = lambda f: F.rlike(directions, F.lit(rf"(?i){B}{f}\s*(?:°|degrees?\s*)?f{E}"))
    rested = F.rlike(directions, F.lit(rf"(?i){B}(?:3|three)[ -]?minute rest{E}|{B}rest{E}.{{0,20}}{B}(?:3|three) minutes?{E}"))
    casserole = has(title, "casserole")
    meat = has(foods, "beef", "chicken", "duck", "egg", "goat", "lamb", "meat", "pork", "rabbit", "sausage", "turkey", "venison")
    ladder = (
        F.when(casserole & meat & ~heat(165), F.lit("meat or egg casserole directions must specify 165°F"))
        .when(has(foods, "chicken", "duck", "turkey", "poultry") & ~heat(165), F.lit("poultry directions must specify 165°F"))
        .when(has(foods, "ground beef", "ground pork", "ground lamb", "ground veal", "sausage", "rabbit", "venison") & ~heat(160), F.lit("ground meat, sausage, rabbit, or venison directions must specify 160°F"))
        .when(has(foods, "beef", "pork", "veal", "lamb", "goat", "ham", "steak", "chop", "roast") & (~heat(145) | ~rested), F.lit("whole-cut meat directions must specify 145°F and a 3-minute rest"))
    )
    fish = has(foods, "anchovy", "cod", "fish", "salmon", "tuna", "trout", "tilapia") & ~heat(145) & ~has(directions, "opaque") & ~has(directions, "flakes? (?:easily|with a fork)")
    shell = has(foods, "clam", "crab", "lobster", "mussel", "oyster", "scallop", "shellfish", "shrimp") & ~has(directions, "pearly", "white", "opaque", "shells? open")
    firm = rf"(?i){B}(?:yolk|white|center|centers|middle|batter).{{0,30}}{B}(?:firm|set|cooked through|no longer wet){E}"
    flagged = F.rlike(F.lower(nothing if flags is None else F.coalesce(flags, nothing)), F.lit("raw.animal|missing.food.safety|egg"))
    eggs = has(foods, "eggs?") & ~casserole & ~heat(160) & ~F.rlike(directions, F.lit(firm)) & flagged
    return F.array_distinct(F.array_compact(
        F.array(
            F.when(has(nothing if operations is None else operations, "can", "canning", "ferment", "fermentation", "preserv", "sous vide"), F.lit("home canning, fermentation, preservation, or sous-vide methods require manual safety review")),
            ladder,
            F.when(fish, F.lit("fish directions must specify 145°F or an opaque, easily flaked endpoint")),
            F.when(shell, F.lit("shellfish directions must specify an opaque or open-shell endpoint")),
            F.when(eggs, F.lit("raw-egg directions must specify 160°F or a firm, fully set endpoint")),
        )
    ))
