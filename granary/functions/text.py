"""Text functions. Built-in expressions, but for Unicode decomposition, entities and nested JSON (Arrow UDFs)."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space: ASCII's and Unicode's, the byte order mark among it. Fixed value.
SPACE = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def arrow_udf(f, kind: str):
    """A column function of a function of pandas series. The UDF is made when used, so workers can import this module."""
    return lambda *columns: F.pandas_udf(f, kind)(*columns)


def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


#: NFKD form.
decomposed = arrow_udf(_decomposed, "string")


def without_marks(text: Column) -> Column:
    return F.regexp_replace(decomposed(text), "[̀-ͯ]", "")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def folded_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of a lower-cased text without accents. Signs that decompose to capitals part words."""
    return F.regexp_extract_all(without_marks(F.lower(F.coalesce(text, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once a row: an expression inside a lambda is evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Distinct windows of n words joined by spaces; empty if there are fewer."""

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))

    return bound(words, windows)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct values; 0 if either is empty."""

    def share(p: Column) -> Column:
        x, y = p["a"], p["b"]
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))

    return bound(F.struct(a.alias("a"), b.alias("b")), share)


def percent(share: Column) -> Column:
    """One decimal, halves upwards."""
    return F.floor(share * 1000 + 0.5) / 10


def _dashed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-|-$", "")


def slug(text: Column, default: str = "recipe", most: int = 90, fold: bool = False) -> Column:
    """Lower-case words joined by dashes. fold removes accents; without it a decomposed accent becomes a dash."""
    source = F.lower(F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text))
    cut = F.substring(_dashed(without_marks(source) if fold else decomposed(source)), 1, most)
    return F.when(cut == "", F.lit(default)).otherwise(cut)


def import_slug(text: Column, most: int = 100) -> Column:
    """As slug, less registered signs, cut and trimmed again; no default."""
    plain = F.regexp_replace(decomposed(F.lower(F.coalesce(text, F.lit("")))), "[®™©]", "")
    return F.regexp_replace(F.substring(_dashed(plain), 1, most), "-$", "")


def lookup_key(text: Column) -> Column:
    """A name as a dictionary key: no signs, no remarks on being optional, words parted by one space."""
    plain = F.regexp_replace(F.lower(decomposed(F.coalesce(text, F.lit("")))), "[®™©*]", "")
    plain = F.regexp_replace(plain, r"\([^)]*(?:optional|not included)[^)]*\)", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def _each(f):
    """A series of arrays through a function of texts; null arrays and texts stay."""
    return lambda arrays: arrays.map(lambda a: None if a is None else [None if v is None else f(v) for v in a])


def _key(value: str) -> str:
    folded = re.sub("[®™©*]", "", unicodedata.normalize("NFKD", value).lower())
    return re.sub("[^a-z0-9]+", " ", re.sub(r"\([^)]*(?:optional|not included)[^)]*\)", "", folded)).strip()


def _slug(value: str, most: int = 100) -> str:
    dashed = re.sub("[^a-z0-9]+", "-", re.sub("[®™©]", "", unicodedata.normalize("NFKD", value.lower())))
    return re.sub("-$", "", re.sub("^-|-$", "", dashed)[:most])


def _keys(arrays: pd.Series) -> pd.Series:
    return _each(_key)(arrays)


def _slugs(arrays: pd.Series) -> pd.Series:
    return _each(_slug)(arrays)


def _fold(value: str) -> str:
    return re.sub("[A-Z]", " ", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", value.lower())))


def _folds(arrays: pd.Series) -> pd.Series:
    return _each(_fold)(arrays)


#: Lower-cased texts of arrays without accents.
folded_lists = arrow_udf(_folds, "array<string>")
#: lookup_key() and import_slug() of arrays: Python functions can't stand in a lambda of Spark.
lookup_keys, import_slugs = arrow_udf(_keys, "array<string>"), arrow_udf(_slugs, "array<string>")


def clean_name(text: Column, default: str = "Unspecified ingredient") -> Column:
    """A name without signs and remarks in parentheses on being optional."""
    plain = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[®™©]|\*+", "")
    plain = F.regexp_replace(plain, rf"(?i){SPACE}*\([^)]*(?:optional|not included)[^)]*\){SPACE}*", " ")
    plain = F.trim(F.regexp_replace(plain, f"{SPACE}+", " "))
    return F.when(plain == "", F.lit(default)).otherwise(plain)


def is_optional(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"(?i)(?<![0-9a-z_])(?:optional|not included)(?![0-9a-z_])")), F.lit(False))


def contains_term(text: Column, term: str) -> Column:
    """The term between non-letters, in its exact form, whatever the case."""
    return F.rlike(text, F.lit(f"(?i)(?:^|[^a-z]){re.escape(term)}(?:$|[^a-z])"))


def display_name(text: Column, most: int = 120, strict: bool = False) -> Column:
    """Squeezed, first letter in upper case; null where empty or too long, or an error if strict."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))
    bad = F.raise_error(F.lit(f"a name must have 1 to {most} characters")) if strict else F.lit(None)
    return F.when((plain != "") & (F.length(plain) <= most), F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, most))).otherwise(bad.cast("string"))


def title_artifact(title: Column) -> Column:
    """A title that begins with a week's or record's code, or has capitals and no small letter."""
    return F.rlike(F.coalesce(title, F.lit("")), F.lit(r"^(?i:\d{4}-w\d+|r\d+)(?![0-9A-Za-z_])|^[^a-z]*[A-Z][^a-z]*$"))


def risky_title(title: Column, publisher: Column) -> Column:
    """A title with a sign or a promotional word, or with the publisher's name (of four letters or more)."""
    low, name = F.lower(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(publisher, F.lit("")))
    promotional = F.rlike(low, F.lit(r"[®™]|(?<![0-9a-z_])(?:copycat|official|famous|world(?:'s)? best|award[- ]winning)(?![0-9a-z_])"))
    return promotional | ((F.length(name) >= 4) & F.contains(low, F.lower(name)))


def page_name(page: Column) -> Column:
    """The page's number with zeros up to five digits; longer ones whole, as lpad() would cut them."""
    shown = page.cast("string")
    return F.concat(F.lit("page-"), F.when(F.length(shown) < 5, F.lpad(shown, 5, "0")).otherwise(shown), F.lit(".json"))


def text_digest(**parts: Column) -> Column:
    """sha-256 of the JSON of some texts and arrays of texts, in the given order of keys; null counts as empty."""
    empty = lambda c, k: F.coalesce(c, F.array().cast("array<string>") if k == "instructions" else F.lit(""))
    return F.sha2(F.to_json(F.struct(*[empty(c, k).alias(k) for k, c in parts.items()])), 256)


def source_digest(description: Column, lines: Column) -> Column:
    return text_digest(description=description, instructions=lines)


def final_digest(subtitle: Column, description: Column, steps: Column) -> Column:
    return text_digest(subtitle=subtitle, description=description, instructions=steps)


def json_object(text: Column) -> Column:
    """The text of a JSON object, as a variant; null for anything else."""
    value = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)


def entries(values: Column) -> Column:
    """A map's entries with their places, as an array of structs (pos, key, value) in key order."""
    return F.transform(F.array_sort(F.map_entries(values)), lambda e, i: F.struct(i.alias("pos"), e["key"].alias("key"), e["value"].alias("value")))


def prose(*parts: Column) -> Column:
    """Non-empty parts and array elements joined by spaces."""
    return F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")), " ")


#: Named entities that are decoded. Fixed values.
ENTITIES = {
    "amp": "&", "apos": "'", "gt": ">", "hellip": "…", "ldquo": "“", "lsquo": "‘", "lt": "<", "mdash": "—", "nbsp": " ", "ndash": "–", "quot": '"', "rdquo": "”", "rsquo": "’",
}
_ENTITY = re.compile(r"&(?:#x([0-9a-f]+)|#([0-9]+)|([a-z][0-9a-z]+));", re.I)


def decode_entities(text: str) -> str:
    """One pass: what a decoded entity gives is not decoded again. Unknown names and numbers out of range stay."""

    def one(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3].lower(), m[0])
        number = int(m[1], 16) if m[1] else int(m[2])
        return chr(number) if number <= 0x10FFFF and not 0xD800 <= number <= 0xDFFF else m[0]

    return _ENTITY.sub(one, text)


def plain(text: object) -> str:
    """Tags to spaces, entities decoded, white space squeezed, none before punctuation."""
    decoded = decode_entities(re.sub(r"<[^>]*>", " ", "" if text is None else str(text)))
    squeezed = re.sub(f"{SPACE}+", " ", decoded)
    return re.sub(r" ([,.;:!?])", r"\1", squeezed).strip(" ")


def _plain_text(values: pd.Series) -> pd.Series:
    return values.map(plain)


plain_text = arrow_udf(_plain_text, "string")


_SCRIPT = re.compile(r"<script[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>", re.I | re.S)


def json_ld_nodes(html: str | None, kind: str = "recipe") -> list[str]:
    """Every object of a type in the page's JSON-LD scripts, as JSON with sorted keys; broken scripts are skipped."""
    found: list[str] = []
    for script in _SCRIPT.findall(html or ""):
        try:
            todo = [json.loads(script)]
        except ValueError:
            continue
        while todo:
            node = todo.pop(0)
            if isinstance(node, list):
                todo = node + todo
            elif isinstance(node, dict):
                types = node.get("@type")
                if kind in [str(t).lower() for t in (types if isinstance(types, list) else [types])]:
                    found.append(json.dumps(node, sort_keys=True, ensure_ascii=False))
                todo = list(node.values()) + todo
    return found


def _json_ld(values: pd.Series) -> pd.Series:
    return values.map(json_ld_nodes)


json_ld = arrow_udf(_json_ld, "array<string>")


_TAG = re.compile(r"<([a-z][\w:-]*)\b[^>]*>", re.I)
_SCOPE = re.compile(r"<[^>]+itemscope\b[^>]*itemtype\s*=\s*[\"']https?://schema\.org/Recipe[\"'][^>]*>", re.I)
_ITEM = re.compile(r"<li\b[^>]*>(.*?)</li>", re.I | re.S)


def _attribute(tag: str, name: str) -> str | None:
    """An attribute's value, quoted or not."""
    m = re.search(rf"\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", tag, re.I)
    return next((g for g in m.groups() if g is not None), None) if m else None


def _properties(scope: str) -> dict[str, list[tuple[int, str]]]:
    """Item properties with the places and values of their tags: the content attribute, or what stands before the next
    closing tag of the same name; a tag that is never closed has none."""
    out: dict[str, list[tuple[int, str]]] = {}
    for m in _TAG.finditer(scope):
        names = (_attribute(m[0], "itemprop") or "").split()
        if not names:
            continue
        value = _attribute(m[0], "content")
        if value is None:
            end = re.compile(rf"</{re.escape(m[1])}\s*>", re.I).search(scope, m.end())
            if end is None:
                continue
            value = scope[m.end() : end.start()]
        for name in names:
            out.setdefault(name, []).append((m.start(), value))
    return out


#: Properties of a microdata record that are taken once. Fixed values.
_SINGLE = ("description", "recipeYield", "prepTime", "cookTime", "totalTime", "recipeCategory", "recipeCuisine")


def microdata_record(html: str | None) -> dict | None:
    """The first recipe scope as a node like those of JSON-LD; null unless it has a name, ingredients and instructions.

    The name is the last one before the page's main entity. Instructions are the list items of their container, or
    the container itself. Ingredients are distinct.
    """
    m = _SCOPE.search(html or "")
    if not m:
        return None
    props = _properties(html[m.start() :])
    main = props.get("mainEntityOfPage", [(len(html), "")])[0][0]
    names = props.get("name", [])
    name = next((v for at, v in reversed(names) if at < main), names[0][1] if names else "")
    lines = list(dict.fromkeys(v for _, v in props.get("recipeIngredient", [])))
    container = props.get("recipeInstructions", [(0, "")])[0][1]
    steps = _ITEM.findall(container) or ([container] if container else [])
    if not (name and lines and steps):
        return None
    single = {k: props[k][0][1] for k in _SINGLE if k in props}
    return {"@type": "Recipe", "name": name, **single, "recipeIngredient": lines, "recipeInstructions": steps}


def _microdata(values: pd.Series) -> pd.Series:
    def one(html: str | None) -> str | None:
        got = microdata_record(html)
        return None if got is None else json.dumps(got, ensure_ascii=False)

    return values.map(one)


microdata = arrow_udf(_microdata, "string")


def canonical(value: object) -> str:
    """JSON with keys in code point order at all depths, compact; whole numbers without a point."""

    def exact(v: object) -> object:
        if isinstance(v, dict):
            return {k: exact(x) for k, x in v.items()}
        if isinstance(v, list):
            return [exact(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e21 else v

    return json.dumps(exact(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _canonical_json(values: pd.Series) -> pd.Series:
    """canonical() of JSON texts; null if one does not parse."""

    def one(v: str | None) -> str | None:
        try:
            return None if v is None else canonical(json.loads(v))
        except ValueError:
            return None

    return values.map(one)


canonical_json = arrow_udf(_canonical_json, "string")


def short_hash(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)
