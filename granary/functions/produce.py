"""Ingredient categories, seasons and equipment: ordered rules over folded names (ASCII words, single spaces)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.rules import B, E, all_matches, first_match
from granary.functions.text import bound, import_slug, import_slugs, lookup_key

SEASONS = ("spring", "summer", "fall", "winter")
#: Ends of rules: whole words, or words that begin so.
WHOLE, BEGINS = E, f"[0-9A-Za-z_]*{E}"


def _rule(terms: str, end: str) -> str:
    return f"{B}(?:{terms}){end}"


#: Seasons by ingredient terms, first match. Fixed values.
SEASON_RULES = [
    (("spring",), _rule("asparagus|artichoke|rhubarb|ramp|fava bean|morel", WHOLE)),
    (("spring", "summer"), _rule("strawberr|snap pea|snow pea|fresh pea|radish|watercress", BEGINS)),
    (("summer",), _rule("apricot|blackberr|blueberr|boysenberr|cherr|nectarine|peach|raspberr|watermelon|cantaloupe|honeydew", BEGINS)),
    (("summer", "fall"), _rule("tomato|tomatoes|tomatillo|cucumber|eggplant|zucchini|yellow squash|summer squash|okra|corn(?: on the cob)?|green bean|bell pepper|poblano|jalape[nñ]o|basil", WHOLE)),
    (("fall",), _rule("apple|pear|fig|grape|persimmon", BEGINS)),
    (("fall", "winter"), _rule("cranberr|pomegranate|pumpkin|butternut|acorn squash|delicata|spaghetti squash|winter squash|sweet potato", BEGINS)),
    (("fall", "winter"), _rule("beet|broccoli|brussels sprout|cabbage|carrot|cauliflower|celeriac|collard|fennel|kale|leek|parsnip|potato|rutabaga|turnip", BEGINS)),
    (("fall",), _rule("celery|mushroom", BEGINS)),
    (("spring", "fall"), _rule("arugula|chard|lettuce|mixed greens|spinach", WHOLE)),
    (("spring", "summer"), _rule("mint|chive|cilantro|dill|scallion|tarragon", BEGINS)),
    (("winter", "year-round"), _rule("blood orange|cara cara orange|mandarin orange|meyer lemon|orange|lime", BEGINS)),
]
#: Terms that keep dairy words from meaning dairy. Fixed values.
PLANT_BASED = _rule("coconut|almond|oat|soy|vegan|plant based", WHOLE)
#: Categories by ingredient terms, first match; dairy only where PLANT_BASED is not found. Fixed values.
CATEGORIES = [
    ("spice", _rule("seasoning|spice|spices|rub", WHOLE)),
    ("condiment", _rule("stock|broth|concentrate|sauce|vinegar|mustard|mayonnaise|mayo|ketchup|dressing|glaze|paste|spread|relish|pickle|hoisin|salsa|pesto|tahini", BEGINS)),
    ("dairy", _rule("milk|cheese|cream|crema|yogurt|butter|ghee|buttermilk|mozzarella|parmesan|cheddar|feta|gouda|brie|mascarpone|ricotta|burrata", WHOLE)),
    ("protein", _rule("chicken|beef|steak|pork|bacon|ham|turkey|duck|venison|lamb|sausage|prosciutto|salami|fish|salmon|trout|steelhead|cod|cobia|tilapia|tuna|halibut|barramundi|shrimp|prawn|scallop|lobster|crab|mussel|clam|tofu|tempeh|seitan", BEGINS) + "|" + _rule("eggs?", WHOLE)),
    ("legume", _rule("bean|lentil|chickpea|garbanzo|edamame|split pea", BEGINS)),
    ("grain", _rule("rice|pasta|noodle|bread|baguette|bun|tortilla|couscous|polenta|oat|barley|farro|freekeh|quinoa|bulgur|orzo|ravioli|tortellini|gnocchi|panko|breadcrumb|flatbread|naan|ciabatta", BEGINS)),
    ("herb", _rule("basil|parsley|thyme|mint|cilantro|coriander leaves|rosemary|sage|oregano|chive|dill|tarragon", BEGINS)),
    ("spice", _rule("salt|pepper|paprika|cumin|cinnamon|chili powder|curry powder|turmeric|nutmeg|clove|cardamom|coriander|allspice|cayenne|chili flake", BEGINS)),
    ("oil", _rule("oil|shortening", WHOLE)),
    ("sweetener", _rule("sugar|honey|syrup|agave|molasses|jam|preserve|marmalade", BEGINS)),
    ("baking", _rule("flour|yeast|baking soda|baking powder|cornstarch|cocoa|chocolate chip|cake mix|pie|pie crust", BEGINS)),
    ("beverage", _rule("wine|beer|juice|cider|coffee|tea|seltzer|sparkling water", WHOLE)),
]
#: Terms of produce without a season. Fixed values.
PRODUCE = _rule("onion|shallot|garlic|potato|carrot|celery|avocado|banana|lemon|lime|orange|mushroom|ginger|scallion|lettuce|greens|fruit|vegetable", BEGINS)
#: Terms of preserved goods, which have no season. Fixed values.
PRESERVED = _rule("canned|can of|dried|dry|frozen|powder|paste|concentrate|stock|broth|sauce|jam|preserve|juice|puree|purée|sun dried|sun-dried", WHOLE)
#: Equipment by words of instructions, all matches. Fixed values.
EQUIPMENT = [
    ("oven", _rule("oven", WHOLE)), ("baking sheet", _rule("baking sheet", WHOLE)), ("skillet", _rule("skillet|large pan|medium pan|frying pan", WHOLE)),
    ("saucepan", _rule("saucepan|small pot|medium pot|large pot", WHOLE)), ("grill", _rule("grill", WHOLE)), ("microwave", _rule("microwave", WHOLE)),
    ("slow cooker", _rule("slow cooker", WHOLE)), ("blender", _rule("blender", WHOLE)), ("food processor", _rule("food processor", WHOLE)), ("colander", _rule("colander|drain", WHOLE)),
]
#: Dishes that add to seasons' scores. Fixed values.
COLD_WEATHER, WARM_WEATHER = _rule("soup|stew|chowder|chili|braise|pot pie", BEGINS), _rule("grill|barbecue|barbeque|skewer|cold|chilled|spritz|no cook", BEGINS)


def category(name: Column) -> Column:
    """The category of a folded name: the first rule found, then produce, then other."""
    in_season = any_rule([p for _, p in SEASON_RULES])
    named = [(label, p if label != "dairy" else f"^(?!.*{PLANT_BASED}).*(?:{p})") for label, p in CATEGORIES]
    return first_match(name, [*named, ("produce", f"{in_season}|{PRODUCE}")], "other")


def any_rule(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def seasons(name: Column, kind: Column, southern: bool = False) -> Column:
    """Seasons of a folded name of a category; year-round for what is preserved or neither produce nor herb."""
    opposite = {"spring": "fall", "summer": "winter", "fall": "spring", "winter": "summer"} if southern else {}
    always = F.array(F.lit("year-round"))
    found = F.coalesce(*[F.when(F.rlike(name, F.lit(p)), F.array(*[F.lit(opposite.get(s, s)) for s in labels])) for labels, p in SEASON_RULES], always)
    fresh = F.coalesce(kind.isin("produce", "herb") & ~F.rlike(name, F.lit(PRESERVED)), F.lit(False))
    return F.when(fresh, found).otherwise(always)


def equipment(instructions: Column) -> Column:
    low = F.lower(F.coalesce(instructions, F.lit("")))
    return all_matches([(F.rlike(low, F.lit(p)), label) for label, p in EQUIPMENT])


def season_scores(title: Column, driver: Column, ingredients: Column) -> Column:
    """An array of four scores in the order of SEASONS. title and driver (the title before "with") are folded;
    ingredients: array of structs of a folded name and its seasons."""

    def score(season: str) -> Column:
        named = F.rlike(title, F.lit(_rule("fall|autumn" if season == "fall" else season, WHOLE)))
        weight = lambda i: F.when((i["name"] != "") & F.contains(driver, i["name"]), 3).otherwise(1)
        counts = lambda i: F.array_contains(i["seasons"], season) & ~F.array_contains(i["seasons"], "year-round")
        base = F.when(named, 6).otherwise(0)
        if season in ("fall", "winter"):
            base = base + F.when(F.rlike(title, F.lit(COLD_WEATHER)), 2).otherwise(0)
        if season == "summer":
            base = base + F.when(F.rlike(title, F.lit(WARM_WEATHER)), 2).otherwise(0)
        return F.aggregate(ingredients, base, lambda a, i: a + F.when(counts(i), weight(i)).otherwise(0))

    return F.array(*[score(s) for s in SEASONS])


def seasons_of_scores(scores: Column) -> Column:
    """Seasons with 60 % of the best score, and 2, at least; year-round where none has 2."""

    def chosen(s: Column) -> Column:
        least = F.greatest(F.lit(2.0), F.array_max(s) * 0.6)
        return F.when(F.array_max(s) < 2, F.array(F.lit("year-round"))).otherwise(all_matches([(s[i] >= least, name) for i, name in enumerate(SEASONS)]))

    return bound(scores, chosen)


#: Allergens of an ingredient's folded name in output order: what names them, and what keeps the words from meaning them. Fixed values.
NAME_ALLERGENS = [
    ("milk", _rule("milk|cheese|cream|crema|yogurt|butter|ghee|buttermilk|whey|mozzarella|parmesan|cheddar|feta|gouda|brie|mascarpone|ricotta|burrata", WHOLE), PLANT_BASED),
    ("eggs", _rule("eggs?|mayonnaise|mayo|aioli", WHOLE), _rule("vegan|plant based", WHOLE)),
    ("fish", _rule("fish|salmon|trout|steelhead|cod|cobia|tilapia|tuna|halibut|barramundi|anchov|mahi|haddock", BEGINS), None),
    ("shellfish", _rule("shrimp|prawn|scallop|lobster|crab|mussel|clam|oyster", BEGINS), None),
    ("tree-nuts", _rule("almond|walnut|pecan|cashew|pistachio|hazelnut|pine nut|macadamia|brazil nut", BEGINS), None),
    ("peanuts", _rule("peanut", BEGINS), None),
    (
        "wheat",
        _rule("wheat|flour|panko|breadcrumb|bread|baguette|pasta|noodles?|couscous|bulgur|farro|freekeh|orzo|ravioli|tortellini|gnocchi|ciabatta|naan|flatbread|pizza dough", BEGINS),
        _rule(r"(?:corn|rice|almond|coconut|chickpea|cassava|gluten free)\s+flour", WHOLE) + "|" + _rule("(?:rice|glass|cellophane) noodles?", WHOLE),
    ),
    ("soy", _rule("soy|tofu|tempeh|edamame|miso", BEGINS), None),
    ("sesame", _rule("sesame|tahini", BEGINS), None),
]
#: Allergens by a recipe's tag. Fixed values.
TAG_ALLERGENS = {
    "milk": "milk", "eggs": "eggs", "egg": "eggs", "fish": "fish", "shellfish": "shellfish", "tree nuts": "tree-nuts", "tree-nuts": "tree-nuts", "peanuts": "peanuts", "peanut": "peanuts",
    "wheat": "wheat", "soy": "soy", "sesame": "sesame",
}
#: Ids by a folded name that is no alias. Fixed values.
SYNONYMS = {
    "extra virgin olive oil": "olive-oil", "extra-virgin olive oil": "olive-oil", "evoo": "olive-oil", "fresh mozzarella cheese": "mozzarella", "yellow onions": "onion",
    "yellow onion": "onion", "garlic cloves": "garlic", "garlic clove": "garlic",
}
#: Folders by meal type; other types are their own folder. Fixed values.
FOLDERS = {
    "main": "mains", "side": "sides", "sandwich": "sandwiches", "dessert": "desserts", "drink": "drinks", "snack": "snacks", "soup": "soups", "salad": "salads", "sauce": "sauces",
    "baked-good": "baked-goods",
}
#: Words of the leading dish of a title that tell its meal type, and those that overrule them. Fixed values.
ENTREES = _rule("beef|steak|chicken|pork|turkey|salmon|trout|barramundi|shrimp|scallop|pasta|penne|rigatoni|ravioli|tortelloni|meatball", BEGINS)
SAVORY_PIES = _rule("shepherd|cottage|pot pie|cornbread pie|beef|steak|chicken|pork|turkey|mushroom|truffle|gnocchi|penne|risotto|agnolotti", WHOLE)
DRINKS = _rule("smoothie|juice|lemonade|limeade|spritz|cocktail|mocktail|punch|latte|hot chocolate|iced tea", WHOLE)
BREAKFASTS = _rule("breakfast|brunch|waffles?|pancakes?|french toast|oatmeal|overnight oats?|frittata|omelet|scramble", WHOLE)
SOUPS = _rule("soup|stew|chowder|bisque", WHOLE) + r"|(?:^|\s)chili$"
SANDWICHES = _rule("sandwich(?:es)?|burger(?:s)?|taco(?:s)?|quesadilla(?:s)?|wrap(?:s)?|burrito(?:s)?|hot dog(?:s)?|slider(?:s)?|banh mi", WHOLE)
SALADS = _rule("salad|panzanella|slaw", WHOLE)
SAUCES = _rule("sauce|dressing|marinade|salsa|pesto|gravy|dip", WHOLE) + "$"
DESSERTS = _rule("cake|cookies?|brownies?|cheesecake|pie|cobbler|crisp|pudding|tiramisu|ice cream|sundae|dessert|truffles?", WHOLE)
BREADS = _rule("bread|biscuits?|muffins?|scones?|dinner rolls?", WHOLE)
SNACKS = _rule("snack|poppers?|bites?|trail mix", WHOLE)
SIDES = "^(?:garlic )?(?:mashed potatoes|green beans|rice pilaf|roasted vegetables)$"
#: Cuisines by words of a title and its tags, first match. Fixed values.
TITLE_CUISINES = [
    ("Mediterranean", _rule("mediterranean", WHOLE)), ("Mexican", _rule("mexican|taco|fajita|enchilada|quesadilla|burrito", BEGINS)),
    ("Italian", _rule("italian|risotto|ravioli|tortellini|gnocchi|parmigiana|bruschetta", BEGINS)), ("Greek", _rule("greek|souvlaki|gyro|tzatziki", BEGINS)),
    ("Korean", _rule("korean|bulgogi|bibimbap|gochujang", BEGINS)), ("Thai", _rule("thai|pad thai", WHOLE)), ("Indian", _rule("indian|tikka|masala|tandoori|korma", BEGINS)),
    ("Vietnamese", _rule("vietnamese|banh mi|pho", WHOLE)), ("Japanese", _rule("japanese|teriyaki|yakitori|katsu|miso", BEGINS)), ("Chinese", _rule("chinese|szechuan|sichuan|kung pao", WHOLE)),
    ("French", _rule("french|provencal|provençal|ratatouille", WHOLE)), ("Middle Eastern", _rule("middle eastern|shawarma|falafel|za atar|harissa", WHOLE)),
]
#: Meat and fish by words of a name, and names that only sound so. Fixed values.
MEATS = _rule(
    "chicken|beef|steak|pork|bacon|ham|turkey|duck|venison|lamb|sausage|prosciutto|salami|fish|salmon|trout|steelhead|cod|cobia|tilapia|tuna|halibut|barramundi|shrimp|prawn|scallop|"
    "lobster|crab|mussel|clam",
    BEGINS,
)
NOT_MEATS = _rule("vegan|plant based|steak spice|steak seasoning|steak sauce|beefsteak tomato", WHOLE)
#: Tags that say something else than what a dish is. Fixed values.
OTHER_TAGS = (*TAG_ALLERGENS, "veggie", "vegetarian", "vegan", "gluten-free", "gluten free", "new")
DIETS = ("vegetarian", "vegan", "gluten-free", "dairy-free", "nut-free", "egg-free", "low-sodium")


def preserved(name: Column) -> Column:
    return F.rlike(name, F.lit(PRESERVED))


def name_allergens(name: Column) -> Column:
    """Allergens of a folded name, in fixed order."""
    found = lambda p, unless: F.rlike(name, F.lit(p)) & (~F.rlike(name, F.lit(unless)) if unless else F.lit(True))
    return all_matches([(found(p, unless), label) for label, p, unless in NAME_ALLERGENS])


def folder(meal_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), meal_type), meal_type)


def leading_dish(title: Column) -> Column:
    """The folded title up to its first "with"."""
    return lookup_key(F.get(F.split(F.coalesce(title, F.lit("")), r"(?i)\s+with\s+"), F.lit(0)))


def dish_type(dish: Column) -> Column:
    """The meal type of a leading dish, by ordered rules."""
    has = lambda p: F.rlike(dish, F.lit(p))
    return (
        F.when(has(DRINKS), "drink").when(has(BREAKFASTS), "breakfast").when(has(SOUPS), "soup").when(has(SANDWICHES), "sandwich").when(has(SALADS), "salad")
        .when(has(SAUCES) & ~has(ENTREES) & (F.size(F.split(dish, " ")) <= 5), "sauce").when(~has(SAVORY_PIES) & has(DESSERTS), "dessert")
        .when(~has(ENTREES) & ~has(_rule("pot pie", WHOLE)) & has(BREADS), "baked-good").when(has(SNACKS), "snack").when(has(SIDES), "side").otherwise("main")
    )


def title_cuisine(text: Column) -> Column:
    """The cuisine of a folded title with its subtitle and tags; null where none is named."""
    return first_match(text, TITLE_CUISINES)


def _tag(tag: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(tag), r"^contains\s+", ""))


def _texts(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def dish_allergens(tags: Column, of_ingredients: Column) -> Column:
    """Allergens that tags name or ingredients have, in fixed order."""
    names = F.create_map(*[F.lit(x) for kv in TAG_ALLERGENS.items() for x in kv])
    found = F.concat(F.transform(_texts(tags), lambda t: F.try_element_at(names, _tag(t))), _texts(of_ingredients))
    return bound(found, lambda f: all_matches([(F.coalesce(F.array_contains(f, label), F.lit(False)), label) for label, _, _ in NAME_ALLERGENS]))


def is_meat(name: Column) -> Column:
    return F.rlike(name, F.lit(MEATS)) & ~F.rlike(name, F.lit(NOT_MEATS))


def dish_diets(tags: Column, found: Column, names: Column) -> Column:
    """Diets in fixed order: claimed by tags unless allergens or meat (of folded names) speak against them, and free
    from what no allergen shows."""

    def made(p: Column) -> Column:
        tagged = lambda *t: F.arrays_overlap(p["tags"], F.array(*map(F.lit, t)))
        holds = lambda *a: F.arrays_overlap(p["found"], F.array(*map(F.lit, a)))
        vegan = tagged("vegan") & ~p["meat"] & ~holds("milk", "eggs", "fish", "shellfish")
        chosen = {
            "vegetarian": tagged("vegan", "veggie", "vegetarian") & ~p["meat"], "vegan": vegan, "gluten-free": tagged("gluten-free", "gluten free") & ~holds("wheat"),
            "dairy-free": ~holds("milk"), "nut-free": ~holds("tree-nuts", "peanuts"), "egg-free": ~holds("eggs"),
        }
        return all_matches([(chosen[d], d) for d in DIETS if d in chosen])

    low = F.transform(F.filter(_texts(tags), lambda t: t.isNotNull()), F.lower)
    return bound(F.struct(low.alias("tags"), found.alias("found"), F.exists(_texts(names), is_meat).alias("meat")), made)


def dish_tags(meal_type: Column, difficulty: Column, tags: Column) -> Column:
    """Meal type, difficulty and the tags that say what a dish is, as slugs, and a mark for review; distinct."""
    own = import_slugs(F.filter(_texts(tags), lambda t: ~_tag(t).isin(*OTHER_TAGS)))
    all_tags = F.concat(F.array(meal_type, import_slug(difficulty)), own, F.array(F.lit("needs-review")))
    return F.array_distinct(F.filter(all_tags, lambda t: t != ""))
