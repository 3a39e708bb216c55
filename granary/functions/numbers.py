"""Quantities, durations and dates as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import bound

#: Vulgar fractions. Fixed values.
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
#: Unit names by alias; other units keep their name. Fixed values.
UNITS = {"ounce(oz)": "ounce", "ounces": "ounce", "tablespoons": "tablespoon", "teaspoons": "teaspoon", "cups": "cup", "cloves": "clove"}
#: Unit words of ingredient lines. Fixed values.
UNIT_WORDS = (
    "bag", "bags", "bottle", "bottles", "box", "boxes", "can", "cans", "clove", "cloves", "cup", "cups", "dash", "dashes", "drop", "drops", "envelope", "envelopes", "g", "gallon",
    "gallons", "gram", "grams", "kg", "large", "lb", "lbs", "liter", "liters", "medium", "ml", "ounce", "ounces", "oz", "package", "packages", "packet", "packets", "piece", "pieces",
    "pinch", "pinches", "pint", "pints", "pound", "pounds", "quart", "quarts", "small", "stick", "sticks", "tablespoon", "tablespoons", "tbsp", "teaspoon", "teaspoons", "tsp", "whole",
)
#: Words of preparation. Fixed values.
PREPARATION = (
    "beaten", "chopped", "cooked", "cored", "crushed", "cubed", "diced", "drained", "halved", "hulled", "melted", "minced", "peeled", "pitted", "quartered", "rinsed", "seeded", "shredded",
    "sifted", "sliced", "softened", "thawed", "toasted", "trimmed",
)
#: Parts of an ingredient line: a quantity with its range, an attached metric unit, a package, where item and preparation part. Fixed formats.
QUANTITY = r"(?i)^(\d+/\d+|\d+(?:\.\d+)?(?:\s+\d+/\d+)?)(?:\s*(?:-|to)\s*(\d+/\d+|\d+(?:\.\d+)?))?\s*"
METRIC = r"(?i)^(g|kg|ml|oz|lb|lbs)(?![0-9A-Za-z_])\s*"
PACKAGE = r"(?i)^\(([^)]+)\)\s*(can|bottle|box|package|packet|bag)s?\s*"
PARTED = r"^(.*?)(?:,|\s[-–—]\s)(.*)$"
#: Amounts that are units' names by mistake. Fixed values.
NOT_AMOUNTS = "(?i)^(?:unit|box|pack|package|ounce|ounces|tablespoon|teaspoon|cup|clove|bunch)$"


def _number(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("double"), F.lit(0.0))


def iso_minutes(text: Column) -> Column:
    """Days, hours and minutes of an ISO 8601 duration; anything else is 0."""
    pattern = r"(?i)^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?)?$"
    part = lambda i: _number(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, i))
    return (part(1) * 1440 + part(2) * 60 + part(3)).cast("long")


def english_minutes(text: Column) -> Column:
    """The sum of all hours and minutes that a text names, else its first number, else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    add = lambda found: F.aggregate(found, F.lit(0.0), lambda a, x: a + _number(x))
    hours = F.regexp_extract_all(low, F.lit(r"(\d+(?:\.\d+)?)\s*(?:hours?|hrs?)(?![0-9a-z_])"), F.lit(1))
    minutes = F.regexp_extract_all(low, F.lit(r"(\d+(?:\.\d+)?)\s*(?:minutes?|mins?)(?![0-9a-z_])"), F.lit(1))
    named = F.floor(add(hours) * 60 + add(minutes) + 0.5)
    bare = F.floor(F.nullif(F.regexp_extract(low, r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double") + 0.5)
    return F.when(F.size(hours) + F.size(minutes) > 0, named).otherwise(bare).cast("long")


def yield_of(text: Column) -> Column:
    """A struct of the first number (the lower one of a range; 1 if there is none or it is 0) and the unit after it."""
    whole = F.coalesce(text, F.lit(""))
    pattern = r"(?s)^.*?([\d.]+)(?:\s*[-–]\s*[\d.]+\+?)?\s*([^\r\n]*).*$"
    number = F.nullif(F.regexp_extract(whole, pattern, 1).try_cast("double"), F.lit(0.0))
    unit = F.nullif(F.trim(F.regexp_extract(whole, pattern, 2)), F.lit(""))
    return F.struct(F.coalesce(number, F.lit(1.0)).alias("quantity"), F.coalesce(unit, F.lit("servings")).alias("unit"))


def yield_quantity(text: Column) -> Column:
    return yield_of(text)["quantity"]


def inferred_yield(text: Column, default: int = 2) -> Column:
    """A struct of quantity, unit, inferred and reason: the upper number of a range of servings or portions, a single
    number of them, or the default."""
    low = F.lower(F.coalesce(text, F.lit("")))
    number = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).try_cast("int")
    upper = number(r"(?<![0-9a-z_])[2-9]\s*(?:-|–|to)\s*([2-9]|1\d)\s*(?:servings?|portions?)(?![0-9a-z_])")
    exact = number(r"(?<![0-9a-z_])([2-9])\s*(?:servings?|portions?)(?![0-9a-z_])")
    reason = F.when(upper.isNotNull(), F.lit("source range")).when(exact.isNull(), F.lit("source omitted yield"))
    return F.struct(F.coalesce(upper, exact, F.lit(default)).alias("quantity"), F.lit("servings").alias("unit"), reason.isNotNull().alias("inferred"), reason.alias("reason"))


def quantity_value(text: Column) -> Column:
    """A decimal, a fraction or a mixed number as a double; null for other texts."""
    clean = F.trim(text)
    mixed = r"^(?:(\d+)\s+)?(\d+)/(\d+)$"
    whole, over, under = (_number(F.regexp_extract(clean, mixed, i)) for i in (1, 2, 3))
    return F.when(F.rlike(clean, F.lit(r"^\d+(?:\.\d+)?$")), clean.try_cast("double")).when(F.rlike(clean, F.lit(mixed)) & (under > 0), whole + over / under)


def normal_unit(unit: Column) -> Column:
    """The unit's name; null for the word unit and the empty text; others as they are."""
    clean = F.trim(F.coalesce(unit, F.lit("")))
    names = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.when(F.lower(clean).isin("", "unit"), F.lit(None)).otherwise(F.coalesce(F.try_element_at(names, F.lower(clean)), clean))


def typed_quantity(text: Column) -> Column:
    """A struct of num (for a plain decimal) and raw (the trimmed text; null if it is empty)."""
    clean = F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit(""))
    return F.struct(F.when(F.rlike(clean, F.lit(r"^\d+(?:\.\d+)?$")), clean.try_cast("double")).alias("num"), clean.alias("raw"))


def normal_quantity(amount: Column, unit: Column) -> Column:
    """A struct of quantity (num for a number or mixed number, else raw) and unit, with missing, malformed and missing_unit."""

    def made(p: Column) -> Column:
        text, named = p["amount"], p["unit"]
        known = normal_unit(named)
        missing = text == ""
        malformed = ~missing & F.rlike(text, F.lit(NOT_AMOUNTS)) & known.isNull()
        mixed = F.rlike(text, F.lit(r"^\d+\s+\d+/\d+$"))
        plain = F.rlike(text, F.lit(r"^\d+(?:\.\d+)?$"))
        number = F.when(plain | mixed, quantity_value(text))
        usable = ~missing & ~malformed
        return F.struct(
            F.when(usable, number).alias("num"), F.when(usable & number.isNull(), text).alias("raw"), F.when(~malformed, known).alias("unit"),
            missing.alias("missing"), malformed.alias("malformed"), (usable & (named == "")).alias("missing_unit"),
        )

    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return bound(F.struct(clean(amount).alias("amount"), clean(unit).alias("unit")), made)


def number_text(value: Column) -> Column:
    """A double as text, whole ones without a point."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def format_quantity(num: Column, raw: Column, scale: Column) -> Column:
    """A number scaled and rounded to two places; a fraction is scaled too unless the scale is 1, other texts stay; empty for neither."""
    over, under = (F.regexp_extract(raw, r"^(\d+)/(\d+)$", i).try_cast("double") for i in (1, 2))
    fraction = F.when((scale != 1) & (under > 0), number_text(scaled(over / under, scale)))
    return F.coalesce(number_text(scaled(num, scale)), fraction, raw, F.lit(""))


def serving_scale(servings: Column, quantity: Column) -> Column:
    return servings / quantity


def total_minutes(prep: Column, cook: Column, inactive: Column) -> Column:
    return prep + cook + F.coalesce(inactive, F.lit(0))


def timer_minutes(steps: Column) -> Column:
    """The sum over steps of each one's longest duration in minutes; of a range the upper end."""
    ranged = r"\d+\s*(?:-|–|to)\s*(\d+)\s*(?:minutes?|mins?)(?![0-9a-z_])"

    def longest(step: Column) -> Column:
        low = F.lower(F.coalesce(step, F.lit("")))
        alone = F.regexp_extract_all(F.regexp_replace(low, ranged, ""), F.lit(r"(\d+)\s*(?:minutes?|mins?)(?![0-9a-z_])"), F.lit(1))
        found = F.transform(F.concat(F.regexp_extract_all(low, F.lit(ranged), F.lit(1)), alone), lambda x: x.try_cast("long"))
        return F.coalesce(F.array_max(found), F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.coalesce(steps, F.array().cast("array<string>")), longest), F.lit(0).cast("long"), lambda a, x: a + x)


def inferred_times(total: Column, prep: Column, steps: Column) -> Column:
    """A struct of prep_minutes and cook_minutes, with inferred, the names of those that the texts don't state."""

    def made(p: Column) -> Column:
        known_prep = F.coalesce(p["prep"], F.when(p["total"] < 15, F.least(F.lit(5), p["total"])).otherwise(10))
        known_total = F.coalesce(p["total"], F.greatest(F.lit(15), F.ceil((known_prep + timer_minutes(p["steps"])) / 5) * 5))
        first = F.least(known_prep, known_total).cast("long")
        notes = F.array(
            F.when(p["prep"].isNull(), F.lit("prep_minutes")), F.when(p["total"].isNull(), F.lit("total_minutes")), F.when(known_prep > known_total, F.lit("prep_minutes_clamped"))
        )
        return F.struct(first.alias("prep_minutes"), F.greatest(F.lit(0), known_total - first).cast("long").alias("cook_minutes"), F.array_compact(notes).alias("inferred"))

    return bound(F.struct(english_minutes(total).alias("total"), english_minutes(prep).alias("prep"), steps.alias("steps")), made)


#: Nutrients by source name: the target and the most that is believed. Fixed values.
NUTRIENTS = {
    "Calories": ("calories", 5000), "Protein": ("protein_g", 500), "Carbohydrate": ("carbohydrates_g", 500), "Fat": ("fat_g", 500), "Dietary Fiber": ("fiber_g", 200),
    "Sugar": ("sugar_g", 500), "Sodium": ("sodium_mg", 20000),
}


def nutrients(amounts: Column) -> Column:
    """An array of structs (nutrient, target, value, outlier) of a map from source name to text: the number a text
    begins with; negative ones and other texts are left out."""
    found = [
        F.struct(
            F.lit(name).alias("nutrient"), F.lit(target).alias("target"),
            F.regexp_extract(F.try_element_at(amounts, F.lit(name)), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double").alias("value"),
            F.lit(float(most)).alias("most"),
        )
        for name, (target, most) in NUTRIENTS.items()
    ]
    real = F.filter(F.array(*found), lambda x: x["value"] >= 0)
    return F.transform(real, lambda x: F.struct(x["nutrient"].alias("nutrient"), x["target"].alias("target"), x["value"].alias("value"), (x["value"] > x["most"]).alias("outlier")))


def parse_line(line: Column) -> Column:
    """An ingredient line as a struct of quantity, unit, item, preparation and optional."""
    return F.get(parse_lines(F.array(line)), F.lit(0))


def parse_lines(lines: Column) -> Column:
    """parse_line() of each line.

    Each step goes over what the one before made of all lines, so no expression is evaluated or planned more than once.
    """

    def spelt(raw: Column) -> Column:
        text = raw
        for sign, value in FRACTIONS.items():
            text = F.replace(text, F.lit(sign), F.lit(value))
        return F.regexp_replace(F.regexp_replace(text, r"(\d)(\d/\d)", "$1 $2"), r"\s+", " ")

    def measured(text: Column) -> Column:
        low, high = F.regexp_extract(text, QUANTITY, 1), F.regexp_extract(text, QUANTITY, 2)
        quantity = F.when(high != "", F.concat(low, F.lit("-"), high)).otherwise(low)
        return F.struct(text.alias("text"), quantity.alias("quantity"), F.regexp_replace(text, QUANTITY, "").alias("rest"))

    def kept(p: Column, *names: str) -> list[Column]:
        return [p[n].alias(n) for n in names]

    def worded(p: Column) -> Column:
        metric = F.when(p["quantity"] != "", F.regexp_extract(p["rest"], METRIC, 1)).otherwise(F.lit(""))
        word = F.regexp_replace(F.lower(F.regexp_extract(p["rest"], r"^([^\s,]+)", 1)), r"\.$", "")
        return F.struct(*kept(p, "text", "quantity", "rest"), metric.alias("metric"), word.alias("word"))

    def unit_of(p: Column) -> Column:
        attached, known = p["metric"] != "", p["word"].isin(*UNIT_WORDS)
        unit = F.when(attached, F.lower(p["metric"])).when(known, p["word"]).otherwise(F.lit(""))
        rest = F.when(attached, F.regexp_replace(p["rest"], METRIC, "")).when(known, F.regexp_replace(p["rest"], r"^[^\s,]+\s*", "")).otherwise(p["rest"])
        return F.struct(*kept(p, "text", "quantity"), unit.alias("unit"), rest.alias("rest"))

    def unpacked(p: Column) -> Column:
        boxed = F.startswith(p["rest"], F.lit("(")) & F.rlike(p["rest"], F.lit(PACKAGE))
        return F.struct(
            *kept(p, "text", "quantity"), F.when(boxed, F.lower(F.regexp_extract(p["rest"], PACKAGE, 2))).otherwise(p["unit"]).alias("unit"),
            F.when(boxed, F.trim(F.regexp_extract(p["rest"], PACKAGE, 1))).otherwise(F.lit("")).alias("packed"),
            F.when(boxed, F.regexp_replace(p["rest"], PACKAGE, "")).otherwise(p["rest"]).alias("rest"),
        )

    def parted(p: Column) -> Column:
        part = lambda i: F.regexp_extract(p["rest"], PARTED, i)
        cut = F.when(F.rlike(p["rest"], F.lit(PARTED)), F.struct(part(1).alias("item"), part(2).alias("tail")))
        return F.struct(*kept(p, "text", "quantity", "unit", "packed", "rest"), cut.alias("cut"))

    def itemized(p: Column) -> Column:
        item = F.trim(F.coalesce(p["cut"]["item"], p["rest"]))
        tail = F.coalesce(F.trim(p["cut"]["tail"]), F.lit(""))
        return F.struct(*kept(p, "text", "quantity", "unit", "packed"), F.regexp_replace(item, r"^[-–—]\s*", "").alias("item"), tail.alias("tail"))

    def led(p: Column) -> Column:
        lead = F.regexp_extract(p["item"], rf"(?i)^((?:(?:{'|'.join(PREPARATION)}),?\s+)+)\S", 1)
        return F.struct(*kept(p, "text", "quantity", "unit", "packed", "item", "tail"), lead.alias("lead"))

    def finished(p: Column) -> Column:
        item = F.trim(F.substr(p["item"], F.length(p["lead"]) + 1))
        preparation = F.array_join(F.filter(F.array(p["packed"], F.trim(p["lead"]), p["tail"]), lambda x: x != ""), ", ")
        optional = F.rlike(p["text"], F.lit(r"(?i)(?<![0-9a-z_])optional(?![0-9a-z_])"))
        fallback = F.when(p["text"] == "", F.lit("unknown ingredient")).otherwise(p["text"])
        return F.struct(F.when(item == "", fallback).otherwise(item).alias("item"), *kept(p, "quantity", "unit"), preparation.alias("preparation"), optional.alias("optional"))

    values = F.transform(lines, lambda line: spelt(F.trim(F.coalesce(line, F.lit("")))))
    for step in (measured, worded, unit_of, unpacked, parted, itemized, led, finished):
        values = F.transform(values, step)
    return values


def strict_date(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(text, "yyyy-MM-dd"))


def since_or_day(moment: Column, day: Column) -> Column:
    """A moment, or else the start of a day, as texts."""
    return F.coalesce(F.nullif(moment, F.lit("")), F.concat(day, F.lit("T00:00:00.000Z")))


def scaled(value: Column, factor: Column) -> Column:
    return F.floor(value * factor * 100 + 0.5) / 100
