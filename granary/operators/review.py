"""Reviews: overlap with the source, brand terms, reasons to hold, and what to do about them."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import rules, text
from granary.functions.text import bound, folded_tokens, prose
from granary.operators import similarity

def _texts(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def source_prose(description: Column, lines: Column) -> Column:
    return prose(F.array(description), _texts(lines))


def final_prose(subtitle: Column, description: Column, steps: Column) -> Column:
    return prose(F.array(subtitle, description), _texts(steps))


def content_text(name: Column, subtitle: Column, description: Column, ingredients: Column, steps: Column, tags: Column) -> Column:
    """All texts of a record; ingredients: structs of item and preparation."""
    lines = F.transform(ingredients, lambda i: F.concat(i["item"], F.lit(" "), F.coalesce(i["preparation"], F.lit(""))))
    return prose(F.array(name, subtitle, description), lines, _texts(steps), _texts(tags))


def overlap(source: Column, final: Column, source_steps: Column, final_steps: Column) -> Column:
    """A struct of the overlap of prose and of the most alike steps in percent, and both numbers of steps."""
    return F.struct(
        similarity.trigram_percent(source, final).alias("prose_percent"), similarity.max_step_percent(_texts(source_steps), _texts(final_steps)).alias("step_percent"),
        F.size(_texts(source_steps)).alias("source_steps"), F.size(_texts(final_steps)).alias("final_steps"),
    )


def prose_metrics(source: Column, final: Column) -> Column:
    """A struct of word counts and their change in percent."""
    size = lambda c: F.size(text.tokens(c))
    counted = F.struct(size(source).alias("source_words"), size(final).alias("final_words"))
    change = lambda p: similarity.change_percent(p["source_words"], p["final_words"])
    return bound(counted, lambda p: F.struct(p["source_words"].alias("source_words"), p["final_words"].alias("final_words"), change(p).alias("change_percent")))


def brand_terms(content: Column, publisher: Column, terms: list[tuple[str, str]]) -> Column:
    """Structs (term, generic) that a text holds: configured terms, the publisher's name, signs, and "copycat".

    Terms are the policy's, some dozens; against many terms or texts of a table use similarity.terms_in(). Of terms
    that differ in case only, the last one's struct stands in the first one's place.
    """

    def found(p: Column) -> Column:
        entry = lambda term, generic: F.struct(term.alias("term"), generic.alias("generic"))
        holds = lambda folded: F.contains(p["padded"], F.concat(F.lit(" "), folded, F.lit(" ")))
        known = [(" ".join(_folded(t)), t, g) for t, g in terms]
        hits = [F.when(holds(F.lit(folded)), entry(F.lit(t), F.lit(g))) for folded, t, g in known if folded]
        hits.append(F.when((F.length(p["publisher_key"]) >= 4) & holds(p["publisher_key"]), entry(p["publisher"], F.lit("publisher name"))))
        hits.append(F.when(F.rlike(p["content"], F.lit("[®™]")), entry(F.lit("®/™ symbol"), F.lit("generic product name"))))
        hits.append(F.when(F.rlike(p["content"], F.lit(rules.words("copycat"))), entry(F.lit("copycat"), F.lit("generic recipe title"))))
        return F.array_compact(F.array(*hits))

    def last_of_each(hits: Column) -> Column:
        names = F.array_distinct(F.transform(hits, lambda h: F.lower(h["term"])))
        return F.transform(names, lambda n: F.element_at(F.filter(hits, lambda h: F.lower(h["term"]) == n), -1))

    name = F.trim(F.coalesce(publisher, F.lit("")))
    padded = F.concat(F.lit(" "), F.array_join(folded_tokens(content), " "), F.lit(" "))
    given = F.struct(content.alias("content"), padded.alias("padded"), name.alias("publisher"), F.array_join(folded_tokens(name), " ").alias("publisher_key"))
    return bound(bound(given, found), last_of_each)


def _folded(term: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", term.lower())))


def automatic_reasons(facts: Column, generated: Column, record: Column, least: int = 85) -> Column:
    """Why an authored record needs a person's review.

    facts: status, reason, operations (action, endpoint), safety_flags; generated: status, reason, confidence,
    variation_changes; record: name, tags, ingredients (item, preparation), instructions (text), allergens, dietary.
    """

    def made(p: Column) -> Column:
        f, g, r = p["f"], p["g"], p["r"]
        steps = F.lower(F.array_join(F.transform(r["instructions"], lambda s: s["text"]), " "))
        done = F.transform(f["operations"], lambda o: F.concat_ws(" ", o["action"], o["endpoint"]))
        title = F.concat_ws(" ", r["name"], F.array_join(r["tags"], " "))
        safety = rules.food_safety(rules.active_foods(r["ingredients"]), steps, title, F.array_join(done, " "), F.array_join(f["safety_flags"], " "))
        items = F.lower(F.array_join(F.transform(r["ingredients"], lambda i: i["item"]), " "))
        declared, diets = _texts(r["allergens"]), _texts(r["dietary"])
        has = lambda *a: F.arrays_overlap(declared, F.array(*map(F.lit, a)))
        diet = lambda d: F.array_contains(diets, d)
        undeclared = [
            F.when(rules.any_of([text.contains_term(items, t) for t in terms]) & ~has(name), F.lit(f"possible undeclared {name} allergen")) for name, terms in rules.ALLERGENS.items()
        ]
        first = F.array(
            F.when(~f["status"].eqNullSafe(F.lit("usable")), F.concat(F.lit("fact extraction skipped: "), f["reason"])),
            F.when(~g["status"].eqNullSafe(F.lit("promote")), F.concat(F.lit("authoring skipped: "), g["reason"])),
            F.when(g["confidence"] < least, F.concat(F.lit("confidence "), g["confidence"].cast("string"), F.lit(f" is below {least}"))),
            F.when((g["status"] == "promote") & (F.size(g["variation_changes"]) < 1), F.lit("no editorial rewrite was recorded")),
        )
        rest = F.array(
            F.when(F.size(r["ingredients"]) < 2, F.lit("fewer than two ingredients")), F.when(F.size(r["instructions"]) < 1, F.lit("missing instructions")),
            F.when(F.size(r["tags"]) < 1, F.lit("missing tags")), *undeclared,
            F.when(has("milk") & diet("dairy-free"), F.lit("dairy-free conflicts with milk allergen")), F.when(has("eggs") & diet("egg-free"), F.lit("egg-free conflicts with egg allergen")),
            F.when(has("wheat") & diet("gluten-free"), F.lit("gluten-free conflicts with wheat allergen")),
            F.when(has("tree-nuts", "peanuts") & diet("nut-free"), F.lit("nut-free conflicts with nut allergen")),
            F.when(has("milk", "eggs", "fish", "shellfish") & diet("vegan"), F.lit("vegan conflicts with animal-derived ingredients")),
        )
        return F.array_distinct(F.concat(F.array_compact(first), safety, F.array_compact(rest)))

    return bound(F.struct(facts.alias("f"), generated.alias("g"), record.alias("r")), made)


def publication_review(prose_percent: Column, step_percent: Column, mode: Column, reasons: Column, risky: Column) -> Column:
    """The review (struct) that a deterministic disposition stands for."""
    passed, none = mode == "pass", F.array().cast("array<string>")
    whole = lambda c: F.least(F.lit(100), F.floor(c + 0.5)).cast("int")
    return F.struct(
        F.when(passed, F.lit("pass")).otherwise(F.lit("hold")).alias("decision"), F.lit(95).alias("confidence"), F.when(passed, F.lit("low")).otherwise(F.lit("medium")).alias("copyright_risk"),
        whole(prose_percent).alias("semantic_similarity"), whole(step_percent).alias("structural_similarity"), none.alias("distinctive_expression_matches"), none.alias("likely_brand_terms"),
        F.lit("low").alias("trademark_risk"), (~risky).alias("title_is_generic"), F.lit(False).alias("implied_affiliation"),
        F.when(passed, F.array(F.lit("Deterministic expression, structure, title, and brand checks passed."))).otherwise(reasons).alias("reasons"),
    )


def publication_reasons(review: Column, prose_percent: Column, step_percent: Column, brands: Column, least: int = 80) -> Column:
    """Why a review (struct), overlaps and brand terms (array) speak against publishing."""

    def made(p: Column) -> Column:
        r, shown = p["r"], lambda c: F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
        listed = lambda c, sep: F.array_join(c, sep)
        concern = F.coalesce(F.nullif(listed(r["reasons"], "; "), F.lit("")), F.lit("unspecified concern"))
        overlaps = rules.holding_reasons(p["prose"], p["step"], F.array().cast("array<string>"), F.lit(False))
        found = F.array(
            F.when(~r["decision"].eqNullSafe(F.lit("pass")), F.concat(F.lit("independent publication review held the recipe: "), concern)),
            F.when(r["confidence"] < least, F.concat(F.lit("publication-review confidence "), shown(r["confidence"].cast("double")), F.lit(f" is below {least}"))),
            F.when(~r["copyright_risk"].eqNullSafe(F.lit("low")), F.concat(F.lit("publication review found "), r["copyright_risk"], F.lit(" expression-copying risk"))),
            F.when(r["semantic_similarity"] >= 85, F.concat(F.lit("semantic similarity "), r["semantic_similarity"].cast("string"), F.lit("% is too high"))),
            F.when(r["structural_similarity"] >= 90, F.concat(F.lit("instruction-structure similarity "), r["structural_similarity"].cast("string"), F.lit("% is too high"))),
            F.when(F.size(r["distinctive_expression_matches"]) > 0, F.concat(F.lit("possible distinctive expression overlap: "), listed(r["distinctive_expression_matches"], " | "))),
            F.when(F.size(r["likely_brand_terms"]) > 0, F.concat(F.lit("publication review found possible brand terms: "), listed(r["likely_brand_terms"], ", "))),
            F.when(~r["trademark_risk"].eqNullSafe(F.lit("low")), F.concat(F.lit("publication review found "), r["trademark_risk"], F.lit(" trademark risk"))),
            F.when(~F.coalesce(r["title_is_generic"], F.lit(False)), F.lit("recipe title may identify a brand, publisher, or distinctive source title")),
            F.when(r["implied_affiliation"], F.lit("recipe presentation may imply affiliation or endorsement")),
        )
        branded = F.array(F.when(F.size(p["brands"]) > 0, F.concat(F.lit("configured brand terms require review: "), listed(p["brands"], ", "))))
        return F.array_distinct(F.array_compact(F.concat(found, overlaps, branded)))

    return bound(F.struct(review.alias("r"), prose_percent.cast("double").alias("prose"), step_percent.cast("double").alias("step"), brands.alias("brands")), made)


def copied_phrase(source: Column, final: Column, n: int = 8) -> Column:
    """The first phrase of n tokens of a final text that its source has; null if there is none."""
    both = F.struct(text.ngrams(folded_tokens(source), n).alias("a"), text.ngrams(folded_tokens(final), n).alias("b"))
    return bound(both, lambda p: F.get(F.filter(p["b"], lambda g: F.array_contains(p["a"], g)), F.lit(0)))


def promotion_issues(candidate: Column, record: Column) -> Column:
    """Why a candidate (candidate_version, review_status, source, extracted) can't become a record (source, subtitle,
    description, instructions, notes, tags)."""

    def made(p: Column) -> Column:
        c, r, phrase = p["c"], p["r"], p["phrase"]
        known = c["candidate_version"].eqNullSafe(F.lit("1.0.0")) & c["review_status"].eqNullSafe(F.lit("needs-review-and-original-wording"))
        given = lambda u: F.coalesce(u, F.lit("")) != ""
        return rules.all_matches([
            (~known, "input is not a supported review candidate"), (~given(c["source"]["url"]), "candidate is missing its source URL"),
            (~given(r["source"]["url"]) | ~r["source"]["url"].eqNullSafe(c["source"]["url"]), "final recipe must retain the candidate source URL"),
            (~r["source"]["adapted"].eqNullSafe(F.lit(True)), "final recipe source must set adapted to true"),
            (F.coalesce(F.array_contains(r["tags"], "needs-review"), F.lit(False)), "final recipe still has the needs-review tag"),
            (F.contains(F.to_json(r), F.lit("REWRITE REQUIRED")), "final recipe still contains a rewrite placeholder"),
        ], F.when(phrase.isNotNull(), F.concat(F.lit('final prose repeats source wording: "'), phrase, F.lit('"'))))

    # folding accents is a Python function, which can't stand in a lambda
    source = F.array_join(F.concat(F.array(candidate["extracted"]["description"]), _texts(candidate["extracted"]["instruction_lines"])), "\n")
    steps = F.transform(record["instructions"], lambda s: s["text"])
    final = F.array_join(F.concat(F.array(record["subtitle"], record["description"]), _texts(steps), _texts(record["notes"])), "\n")
    return bound(F.struct(candidate.alias("c"), record.alias("r"), copied_phrase(source, final).alias("phrase")), made)


#: Advice by words of reasons, all matches, and what is advised where none is found. Fixed values.
GUIDANCE = (
    ("confidence|authoring skipped", "Return a complete promote result with confidence supported by the supplied facts."),
    ("title|brand|trademark|affiliation", "Use a shorter generic title and remove all brand, publisher, copycat, endorsement, or affiliation language."),
    ("similar|overlap|cop|expression|structure|distinctive|wording|paraphrase", "Rewrite every sentence from scratch and regroup the necessary operations into a different concise functional structure."),
    ("safety|temperature|poultry|meat|fish|egg|shellfish|casserole", "Add the applicable explicit safe endpoint from the supplied federal temperature rules without changing ingredients."),
    ("allergen|dietary", "Classify dietary fields conservatively; do not claim a free-from diet that conflicts with an ingredient."),
)
OTHER_GUIDANCE = "Produce a more independent, complete, concise editorial rewrite while preserving every factual ingredient."


def guidance(reasons: Column) -> Column:
    low = F.lower(F.array_join(reasons, " "))
    found = rules.all_matches([(F.rlike(low, F.lit(p)), advice) for p, advice in GUIDANCE])
    return bound(found, lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(F.lit(OTHER_GUIDANCE))))


def record_status(content_reasons: Column, rights_issues: Column) -> Column:
    return F.when(F.size(content_reasons) > 0, F.lit("needs-review")).when(F.size(rights_issues) > 0, F.lit("publication-hold")).otherwise(F.lit("ready"))
