"""Names to canonical ids: aliases, ambiguity, minted ids, groups and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import numbers, produce, text
from granary.functions.text import bound, lookup_key, short_hash


def alias_index(records: DataFrame, id_: str, names: list[str], arrays: list[str] = ()) -> DataFrame:
    """(key, id) of every name in columns and array columns, as lookup keys; empty keys are left out."""
    parts = [F.array(*[F.col(n).cast("string") for n in names])] + [F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays]
    keys = text.lookup_keys(F.array_compact(F.concat(*parts)))
    return records.select(F.col(id_).alias("id"), F.explode(F.array_distinct(keys)).alias("key")).where("key <> ''")


def ambiguous(index: DataFrame) -> DataFrame:
    """Keys that name more than one id."""
    return index.groupBy("key").agg(F.count_distinct("id").alias("n_ids")).where("n_ids > 1")


def checked(index: DataFrame) -> DataFrame:
    """(key, id), one row a key; an error where a key names more than one id."""
    several = F.raise_error(F.concat(F.lit("ambiguous alias: "), F.col("key"))).cast("string")
    found = index.groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    return found.select("key", F.when(F.col("id") == F.col("last"), F.col("id")).otherwise(several.cast(index.schema["id"].dataType)).alias("id"))


def resolved(rows: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """rows with the id of their name, null where none is known; of an ambiguous key the smallest."""
    one = index.groupBy("key").agg(F.min("id").alias("id"))
    return rows.withColumn("_key", lookup_key(F.col(key))).join(one.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def with_synonyms(rows: DataFrame, key: str, index: DataFrame, synonyms: dict[str, str] = produce.SYNONYMS) -> DataFrame:
    """As resolved(); a key that no record has may be a synonym of a known id."""
    names = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    known = index.select(F.col("id").alias("_other")).distinct()
    found = resolved(rows, key, index).withColumn("_other", F.when(F.col("id").isNull(), F.try_element_at(names, lookup_key(F.col(key)))))
    second = found.join(known.withColumn("_known", F.lit(True)), "_other", "left")
    return second.withColumn("id", F.coalesce("id", F.when(F.col("_known"), F.col("_other")))).drop("_other", "_known")


def unique_id(base: Column, taken: Column, seed: Column, most: int = 91) -> Column:
    """The base, or where it is taken its first 91 characters and a hash of the seed."""
    return F.when(taken, F.concat(F.substring(base, 1, most), F.lit("-"), short_hash(seed, 8))).otherwise(base)


def minted_ids(rows: DataFrame, key: str, base: str, seed: str, taken: DataFrame | None = None) -> DataFrame:
    """An id for each row: the base if no other row has it and it is not taken (id), else the base with the seed's last
    eight characters as a slug, or a hash of the key where that clashes too. Order plays no part."""
    suffix = F.substring(text.import_slug(F.col(seed).cast("string")), -8, 8)
    by_hash = short_hash(F.col(key).cast("string"), 8)
    shared = F.count(F.lit(1)).over(Window.partitionBy(base)) > 1
    named = rows.withColumn("_shared", shared)
    if taken is not None:
        used = taken.select(F.col("id").alias(base)).distinct().withColumn("_used", F.lit(True))
        named = named.join(used, base, "left").withColumn("_shared", F.col("_shared") | F.col("_used").isNotNull()).drop("_used")
    cut = lambda tail: F.concat(F.substring(base, 1, 91), F.lit("-"), tail)
    first = named.withColumn("minted_id", F.when(F.col("_shared"), cut(F.when(suffix == "", by_hash).otherwise(suffix))).otherwise(F.col(base)))
    place = F.row_number().over(Window.partitionBy("minted_id").orderBy(F.col(base) != F.col("minted_id"), F.col(key)))
    return first.withColumn("_nth", place).withColumn("minted_id", F.when(F.col("_nth") > 1, cut(by_hash)).otherwise(F.col("minted_id"))).drop("_shared", "_nth")


def _record(name: Column, unit: Column, southern: bool, notes: str, aliases: Column | None = None) -> Column:
    """An ingredient record (struct) without its id, inferred from a name."""

    def made(p: Column) -> Column:
        kind = produce.category(p["key"])
        return F.struct(
            p["name"].alias("name"), p["aliases"].alias("aliases"), F.array(kind).alias("categories"), produce.seasons(p["key"], kind, southern).alias("seasons"), p["unit"].alias("default_unit"),
            produce.name_allergens(p["key"]).alias("allergens"), F.lit(notes).alias("notes"),
        )

    none = F.array().cast("array<string>")
    return bound(F.struct(name.alias("name"), lookup_key(name).alias("key"), unit.alias("unit"), (none if aliases is None else aliases).alias("aliases")), made)


def planned_ingredients(usages: DataFrame, order: list[str], known: DataFrame, southern: bool = False) -> DataFrame:
    """(key, id, record) of names in usages (item, unit) that no known record (id, name, aliases) has.

    The first usage in order makes the record. Of keys with the same slug, the first gets it unless a known record
    has it, others get a hash of their key after it. A slug of one character gets a prefix.
    """
    index = alias_index(known, "id", ["id", "name"], ["aliases"])
    named = usages.withColumn("name", text.display_name(F.col("item"), strict=True)).withColumn("key", lookup_key(F.col("item")))
    place = F.struct(*order)
    first = named.groupBy("key").agg(F.min_by(F.struct("name", "unit"), place).alias("u"), F.min(place).alias("place")).join(index.select("key").distinct(), "key", "left_anti")
    slug = text.import_slug(F.col("u.name"))
    base = F.when(F.length(slug) >= 2, slug).otherwise(F.concat(F.lit("ingredient-"), F.when(slug != "", slug).otherwise(short_hash(F.col("key"), 8))))
    based = first.withColumn("base", base).join(known.select(F.col("id").alias("base")).distinct().withColumn("used", F.lit(True)), "base", "left")
    nth = F.row_number().over(Window.partitionBy("base").orderBy("place"))
    id_ = unique_id(F.col("base"), F.col("used").isNotNull() | (nth > 1), F.col("key"))
    unit = numbers.normal_unit(F.col("u.unit"))
    notes = "Category, seasonality, default unit, and allergens were inferred during automatic recipe promotion."
    record = _record(F.col("u.name"), F.when(F.length(unit) <= 40, unit), southern, notes)
    return based.withColumn("id", id_).select("key", "id", record.alias("record"))


def counted_usages(usages: DataFrame) -> DataFrame:
    """(name, unit, n): usages (name, unit) and how often each is there, so that a name is read once, not once a line."""
    return usages.groupBy("name", "unit").agg(F.count(F.lit(1)).alias("n"))


def with_keys(names: DataFrame) -> DataFrame:
    """names (name) with item, the cleaned name, and its key."""
    return names.withColumn("item", text.clean_name(F.col("name"))).withColumn("key", lookup_key(text.clean_name(F.col("name"))))


def ingredient_catalog(usages: DataFrame, known: DataFrame, southern: bool = False) -> DataFrame:
    """(key, id, record, is_new, fallback_season, n_usages) of every name that usages (name, unit) or counted usages (with n) have.

    Names with the same key are one ingredient: a known record (id, name, aliases) by its aliases or a synonym, else a
    new one by the first of its display names, the others its aliases, and its most frequent unit. Slugs that several
    keys share go to the first key.
    """
    cleaned = with_keys(counted_usages(usages) if "n" not in usages.columns else usages).withColumn("unit", numbers.normal_unit(F.col("unit")))
    units = mode_of(cleaned, "key", "unit", F.col("n")).select("key", F.col("unit").alias("default_unit"))
    groups = cleaned.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("names"), F.sum("n").alias("n_usages")).join(units, "key", "left")
    index = alias_index(known, "id", ["id", "name"], ["aliases"])
    found = with_synonyms(groups, "key", index)
    name = F.get("names", F.lit(0))
    slug = text.import_slug(name)
    fresh = found.where("id IS NULL").withColumn("base", F.when(slug != "", slug).otherwise(F.concat(F.lit("ingredient-"), short_hash(F.col("key"), 8))))
    fresh = fresh.join(known.select(F.col("id").alias("base")).distinct().withColumn("used", F.lit(True)), "base", "left")
    nth = F.row_number().over(Window.partitionBy("base").orderBy("key"))
    place = "Southern" if southern else "Northern"
    notes = f"Category and {place} Hemisphere seasonality were inferred during legacy import; verify before promotion."
    record = _record(name, F.col("default_unit"), southern, notes, F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))))
    fresh = fresh.withColumn("id", unique_id(F.col("base"), F.col("used").isNotNull() | (nth > 1), F.col("key"))).withColumn("record", record)
    key = lookup_key(F.col("record.name"))
    always = (F.array_join("record.seasons", ",") == "year-round") & ~produce.preserved(key) & F.get("record.categories", F.lit(0)).isin("produce", "herb")
    old = known.select("id", F.struct("name", "aliases", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "seasons", "default_unit", "allergens", F.lit(None).cast("string").alias("notes")).alias("record"))
    kept = found.where("id IS NOT NULL").join(old, "id").select("key", "id", "record", F.lit(False).alias("is_new"), F.lit(False).alias("fallback_season"), "n_usages")
    return kept.union(fresh.select("key", "id", "record", F.lit(True), always, "n_usages"))


def without_id(ingredients: Column) -> Column:
    """Items of those ingredients (structs) that have no id."""
    return F.transform(F.filter(ingredients, lambda i: F.coalesce(i["ingredient_id"], F.lit("")) == ""), lambda i: i["item"])


def mode_of(rows: DataFrame, key: str, value: str, times: Column | None = None) -> DataFrame:
    """The most frequent value of each key, ties to the smallest; a row counts once or as many times as it says."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.sum(F.lit(1) if times is None else times).alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("best"))
    return best.select(key, (-F.col("best.n")).alias("n"), F.col("best.v").alias(value))


def name_groups(rows: DataFrame, name: str, use: list[str]) -> DataFrame:
    """(key, names, usages): display names and usages (structs) of names with the same lookup key."""
    keyed = rows.withColumn("key", lookup_key(F.col(name)))
    return keyed.groupBy("key").agg(F.array_sort(F.collect_set(name)).alias("names"), F.array_sort(F.collect_list(F.struct(*use))).alias("usages"))


def duplicate_groups(rows: DataFrame, key: str, id_: str, order: str | None = None) -> DataFrame:
    """(key, n, ids): keys of several rows with their ids in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order or id_).alias("at"), F.col(id_).alias("id")))), lambda x: x["id"])
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), listed.alias("ids")).where("n > 1")


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
