"""Staged records: whether they can be used, their collection's audit, and their promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import produce, rules, text, urls
from granary.operators import gates, materialize, resolve
from granary.operators.publish import paged
from granary.sources.stores import kept

NAMED = ("source_text_hash", "normalized_text_hash", "model", "prompt_version", "transformed_at")


def stage_issues(stage: Column, extracted: Column) -> Column:
    """Why a staged record (struct of schema_version, candidate_file, content_reasons and record) needs a review; extracted: its candidate's."""
    n, r = stage["record"]["normalization"], stage["record"]
    source = text.source_digest(extracted["description"], extracted["instruction_lines"])
    final = text.final_digest(r["subtitle"], r["description"], F.transform(r["instructions"], lambda s: s["text"]))
    first = rules.all_matches([
        (~stage["schema_version"].eqNullSafe(F.lit("1.0.0")), "unsupported staged normalization schema version"),
        (~F.startswith(F.coalesce(stage["candidate_file"], F.lit("")), F.lit("scraping/output/")), "invalid staged candidate path"),
    ])
    rest = rules.all_matches([
        (n.isNull(), "missing normalization provenance"), (F.coalesce(n["requires_review"], F.lit(False)), "normalization requires human review"),
        (~n["source_review_status"].eqNullSafe(F.lit("passed")), "normalization source review did not pass"),
        (~n["source_text_hash"].eqNullSafe(source), "source expressive text changed after staging"), (~n["normalized_text_hash"].eqNullSafe(final), "staged normalized expressive text hash does not match"),
    ])
    return F.array_distinct(F.concat(first, F.coalesce(stage["content_reasons"], F.array().cast("array<string>")), rest))


def cache_issues(stage: Column, extracted: Column, version: str, model: str) -> Column:
    """Why a staged record (struct with pipeline_version and model) can't stand in for a new one."""
    n, r = stage["record"]["normalization"], stage["record"]
    source = text.source_digest(extracted["description"], extracted["instruction_lines"])
    final = text.final_digest(r["subtitle"], r["description"], F.transform(r["instructions"], lambda s: s["text"]))
    return rules.all_matches([
        (~stage["schema_version"].eqNullSafe(F.lit("1.0.0")), "unsupported staged normalization schema version"),
        (~stage["pipeline_version"].eqNullSafe(F.lit(version)), "staged pipeline version changed"), (~stage["model"].eqNullSafe(F.lit(model)), "staged model changed"),
        (~n["prompt_version"].eqNullSafe(F.lit(version)), "staged prompt version changed"), (~n["source_text_hash"].eqNullSafe(source), "source expressive text changed after staging"),
        (r.isNotNull() & ~n["normalized_text_hash"].eqNullSafe(final), "staged normalized expressive text hash does not match"),
    ])


def schema_issues(row: Column, checks: list[tuple[str, Column]]) -> Column:
    """All messages whose condition is not true of a row (null is not true); null rows have one."""
    found = rules.all_matches([(~F.coalesce(ok, F.lit(False)), message) for message, ok in checks])
    return F.when(row.isNull(), F.array(F.lit("is missing"))).otherwise(found)


def record_checks(r: Column) -> list[tuple[str, Column]]:
    """A finished record's constraints that are known: what must be there, and of what form."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    kinds = [label for label, _ in rules.MEAL_TYPES] + ["other"]
    return [
        ("schema_version must be 1.0.0", r["schema_version"] == "1.0.0"), ("id must be a slug", F.rlike(r["id"], F.lit("^[a-z0-9]+(?:-[a-z0-9]+)*$"))), ("name must not be empty", filled(r["name"])),
        ("meal_type must be a known one", r["meal_type"].isin(*kinds)), ("yield.quantity must be above 0", r["yield"]["quantity"] > 0),
        ("times must not be negative", (r["times"]["prep_minutes"] >= 0) & (r["times"]["cook_minutes"] >= 0)), ("ingredients must not be empty", F.size(r["ingredients"]) > 0),
        ("instructions must not be empty", F.size(r["instructions"]) > 0), ("source.url must be an address", F.rlike(r["source"]["url"], F.lit("^https?://"))),
    ]


def _errors(rows: DataFrame, file: str, found: Column) -> DataFrame:
    return rows.select(F.explode(F.transform(F.array_compact(found), lambda e: F.concat(F.col(file), F.lit(": "), e))).alias("error"))


def _says(when: Column, message: Column | str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(message) if isinstance(message, str) else message)


def collection_errors(listed: DataFrame, records: DataFrame, listed_foods: DataFrame, foods: DataFrame, final_foods: DataFrame, totals: dict, source_counts: DataFrame) -> DataFrame:
    """(error): everything wrong with a staged collection, each once.

    listed (file, recipe_id, source_name, source_url and the NAMED fields) and listed_foods (file, ingredient_id) are
    the manifest's entries; records and foods (file, record) the files; final_foods (record) what is published already;
    totals has publication_status, total_recipes and total_ingredients; source_counts (host, n) the manifest's counts.
    """
    manifest = "recipes-staging/manifest.json"
    found: list[DataFrame] = []
    spark = listed.sparkSession

    both = listed_foods.join(foods.select("file", F.col("record").alias("r")), "file", "left").join(final_foods.select(F.col("record.id").alias("_id"), F.col("record").alias("_final")), F.col("r.id") == F.col("_id"), "left")
    repeated = gates.within_quota(both.where("r IS NOT NULL"), "r.id", "file", F.lit(True), 1).where("NOT accepted").select("file", F.lit(True).alias("again")).distinct()
    both = both.join(repeated, "file", "left")
    found.append(_errors(both, "file", F.array(
        _says(F.col("r").isNull(), "file is missing"), _says(F.col("r.id") != F.col("ingredient_id"), "ingredient id does not match manifest"),
        _says(F.col("again"), F.concat(F.lit("duplicate staged ingredient id '"), "r.id", F.lit("'"))),
        _says(F.col("_final").isNotNull() & (F.to_json("_final") != F.to_json("r")), F.concat(F.lit("conflicts with finalized ingredient '"), "r.id", F.lit("'"))),
    )))

    r, n = F.col("r"), F.col("r.normalization")
    pairs = listed.join(records.select("file", F.col("record").alias("r")), "file", "left")
    for key, name in (("r.id", "again"), ("r.source.url", "again_url")):
        known = pairs.where(F.col(key).isNotNull())
        again = gates.within_quota(known, key, "file", F.lit(True), 1).where("NOT accepted").select("file", F.lit(True).alias(name)).distinct()
        pairs = pairs.join(again, "file", "left")
    final = text.final_digest(r["subtitle"], r["description"], F.transform(r["instructions"], lambda s: s["text"]))
    there = r.isNotNull()
    found.append(_errors(pairs, "file", F.array(
        _says(~there, "file is missing"), _says(there & ~r["id"].eqNullSafe(F.col("recipe_id")), "recipe id does not match manifest"),
        _says(F.col("again"), F.concat(F.lit("duplicate recipe id '"), "r.id", F.lit("'"))),
        _says(there & ((F.coalesce(r["source"]["url"], F.lit("")) == "") | (r["source"]["url"] != F.col("source_url"))), "source URL does not match manifest"),
        _says(there & ~r["source"]["name"].eqNullSafe(F.col("source_name")), "source name does not match manifest"),
        _says(there & ~r["source"]["adapted"].eqNullSafe(F.lit(True)), "source.adapted must be true"),
        _says(F.col("again_url"), F.concat(F.lit("duplicate source URL '"), "r.source.url", F.lit("'"))), _says(there & n.isNull(), "normalization provenance is missing"),
        _says(n.isNotNull() & ~(n["requires_review"].eqNullSafe(F.lit(False)) & n["source_review_status"].eqNullSafe(F.lit("passed"))), "normalization must have passed content review"),
        _says(n.isNotNull() & ~n["normalized_text_hash"].eqNullSafe(final), "normalized text hash does not match"),
        *[_says(n.isNotNull() & ~n[f].eqNullSafe(F.col(f)), f"normalization.{f} does not match manifest") for f in NAMED],
    )))

    known = foods.join(listed_foods, "file", "left_semi").select(F.col("record.id").alias("ingredient_id")).union(final_foods.select("record.id")).distinct()
    used = pairs.where(there).select("file", F.explode("r.ingredients").alias("i")).select("file", F.col("i.ingredient_id").alias("ingredient_id"))
    unknown = used.join(known, "ingredient_id", "left_anti")
    found.append(_errors(unknown, "file", F.array(F.concat(F.lit("unknown ingredient_id '"), F.coalesce("ingredient_id", F.lit("")), F.lit("'")))))
    found.append(_errors(records.join(listed, "file", "left_anti"), "file", F.array(F.lit("recipe is not listed in manifest"))))
    found.append(_errors(foods.join(listed_foods, "file", "left_anti"), "file", F.array(F.lit("ingredient is not listed in manifest"))))

    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    for a, b, total, message in ((listed, records, "total_recipes", "recipe totals do not match files"), (listed_foods, foods, "total_ingredients", "ingredient totals do not match files")):
        sizes = count(a).select(F.col("n").alias("a")).crossJoin(count(b).select(F.col("n").alias("b")))  # one row each
        found.append(sizes.where((F.col("a") != F.col("b")) | (F.col("b") != F.lit(totals[total]))).select(F.lit(f"{manifest}: {message}").alias("error")))
    hosts = pairs.where(F.coalesce("r.source.url", F.lit("")) != "").select("r.source.url").distinct().groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    differs = hosts.join(source_counts.select("host", F.col("n").alias("stated")), "host", "full_outer").where(~F.col("n").eqNullSafe(F.col("stated")))
    found.append(differs.limit(1).select(F.lit(f"{manifest}: source_counts do not match recipes").alias("error")))
    if totals["publication_status"] != "rights-pending":
        found.append(spark.createDataFrame([(f"{manifest}: publication_status must remain rights-pending",)], "error string"))
    return reduce(DataFrame.union, found).distinct()


def promoted(staged: DataFrame, final: DataFrame, staged_foods: DataFrame, final_foods: DataFrame, policy: DataFrame, as_of: Column, most_days: int, share_percent: float, least: int, limit: int | None = None) -> DataFrame:
    """(recipe_id, url, status, reasons) of staged records (file, record) that are not published with the same content.

    Staged records have distinct ids and addresses (collection_errors() says so); of others the first counts. In order of file: an address or id that is published with other content is a conflict; a source without rights, or
    beyond its caps or share of the collection with all that was promoted before, is a publication-hold; ingredients
    that are neither staged nor published, or published otherwise, are a conflict; else it is promoted.
    """
    url, digest = F.col("record.source.url"), F.col("record.normalization.normalized_text_hash")
    by_url = final.select(url.alias("url"), digest.alias("final_digest")).dropDuplicates(["url"])
    rows = staged.select("file", "record", F.col("record.id").alias("recipe_id"), url.alias("url"), digest.alias("digest")).join(by_url, "url", "left")
    rows = rows.where(F.col("final_digest").isNull() | (F.col("final_digest") != F.col("digest")))
    rows = paged(rows, "file", 1).withColumnRenamed("position", "seq").drop("page")
    if limit is not None:
        rows = rows.where(F.col("seq") <= limit)
    ids = final.select(F.col("record.id").alias("recipe_id")).distinct().withColumn("id_taken", F.lit(True))
    food = lambda df, name: df.select(F.col("record.id").alias("ingredient_id"), F.to_json("record").alias(name)).dropDuplicates(["ingredient_id"])
    used = rows.select("seq", F.posexplode("record.ingredients").alias("pos", "i")).select("seq", "pos", F.col("i.ingredient_id").alias("ingredient_id"))
    used = used.join(food(final_foods, "a"), "ingredient_id", "left").join(food(staged_foods, "b"), "ingredient_id", "left")
    issue = F.when(F.col("a").isNull() & F.col("b").isNull(), F.concat(F.lit("missing staged ingredient '"), "ingredient_id", F.lit("'"))).when(
        F.col("a") != F.col("b"), F.concat(F.lit("staged ingredient '"), "ingredient_id", F.lit("' conflicts with finalized data"))
    )
    problems = used.where(issue.isNotNull()).groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", issue.alias("m")))), lambda x: x["m"]).alias("food_issues"))
    rows = rows.join(ids, "recipe_id", "left").join(problems, "seq", "left")
    nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("seq"))
    rows = rows.withColumn("url_nth", nth("url")).withColumn("recipe_id_nth", nth("recipe_id"))
    taken = F.col("final_digest").isNotNull() | (F.col("url_nth") > 1)
    used_id = F.coalesce("id_taken", F.lit(False)) | (F.col("recipe_id_nth") > 1)
    rows = kept(rows.withColumn("_clean", ~taken & ~used_id & F.col("food_issues").isNull()), "staged")
    hosts = final.groupBy(urls.host(url).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    judged = gates.rights_verdict(rows.drop("record"), policy, hosts, as_of, most_days, share_percent, least, "_clean")
    none = F.array().cast("array<string>")
    held = F.size("rights_issues") > 0
    status = F.when(taken | used_id, "conflict").when(held, "publication-hold").when(F.col("food_issues").isNotNull(), "conflict").otherwise("promoted")
    reasons = (
        F.when(taken, F.array(F.lit("source URL is finalized with different normalized content"))).when(used_id, F.array(F.lit("recipe id is already finalized for another source")))
        .when(held, F.col("rights_issues")).otherwise(F.coalesce("food_issues", none))
    )
    return judged.select("recipe_id", "url", status.alias("status"), reasons.alias("reasons"))


def staged_outcome(
    stages: DataFrame, final: DataFrame, known_foods: DataFrame, policy: DataFrame, as_of: Column, most_days: int, share_percent: float, least: int, day: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes: file, status, reasons; records: file, record; foods: key, id, record) of promoting stages.

    stages has file, source (name, url), extracted (the candidate's) and stage (stage_issues()' struct with facts,
    generated, publication_review, model, pipeline_version and staged_at). In order of file: content issues hold a
    stage for review, a published address is finalized already, rights and caps hold it, and what is left is
    materialized again and must have the digests that were staged, or it failed.
    """
    issues = stage_issues(F.col("stage"), F.col("extracted"))
    rows = paged(stages, "file", 1).withColumnRenamed("position", "seq").drop("page").withColumn("content_issues", issues).withColumn("url", F.col("source.url"))
    published = final.select(F.col("record.source.url").alias("url")).distinct().withColumn("finalized", F.lit(True))
    rows = rows.join(published, "url", "left").withColumn("url_nth", F.row_number().over(Window.partitionBy("url").orderBy("seq")))
    rows = rows.withColumn("finalized", F.coalesce("finalized", F.lit(False)) | (F.col("url_nth") > 1)).withColumn("_clean", (F.size("content_issues") == 0) & ~F.col("finalized"))
    hosts = final.groupBy(urls.host(F.col("record.source.url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    judged = kept(gates.rights_verdict(rows, policy, hosts, as_of, most_days, share_percent, least, "_clean"), "judged")
    accepted = judged.where("accepted")
    usages = accepted.select("seq", F.posexplode("stage.facts.ingredients").alias("pos", "i")).select("seq", "pos", "i.item", "i.unit")
    foods = resolve.planned_ingredients(usages, ["seq", "pos"], known_foods)
    names = known_foods.select("id", "name", "aliases").union(foods.select("id", "record.name", F.array().cast("array<string>")))
    drafts = accepted.select(F.col("seq").alias("key"), "source", F.col("stage.generated.recipe").alias("draft"), F.col("stage.facts.ingredients").alias("ingredients"))
    made = materialize.materialized(drafts, names, final.select("record.id"), day).withColumnRenamed("key", "seq")
    finals = text.final_digest(F.col("record.subtitle"), F.col("record.description"), F.transform("record.instructions", lambda s: s["text"]))
    whole = made.join(accepted.select("seq", "file", "stage", "extracted"), "seq")
    source = text.source_digest(F.col("extracted.description"), F.col("extracted.instruction_lines"))
    same = (finals == F.col("stage.record.normalization.normalized_text_hash")) & (source == F.col("stage.record.normalization.source_text_hash"))
    lacking = F.size(resolve.without_id(F.col("record.ingredients"))) > 0
    failed = F.when(~same, F.lit("rematerialized recipe hashes do not match the staged normalization")).when(lacking, F.lit("canonical ingredient IDs are missing"))
    whole = whole.select("seq", "file", "record", failed.alias("failure"))
    none = F.array().cast("array<string>")
    out = judged.select("seq", "file", "content_issues", "finalized", "rights_issues").join(whole.select("seq", "failure"), "seq", "left")
    status = (
        F.when(F.size("content_issues") > 0, "needs-review").when(F.col("finalized"), "already-finalized").when(F.size("rights_issues") > 0, "publication-hold")
        .when(F.col("failure").isNotNull(), "failed").otherwise("promoted")
    )
    reasons = F.when(F.size("content_issues") > 0, F.col("content_issues")).when(F.col("finalized"), none).when(F.size("rights_issues") > 0, F.col("rights_issues")).otherwise(F.array_compact(F.array("failure")))
    return out.select("file", status.alias("status"), reasons.alias("reasons")), whole.where("failure IS NULL").select("file", "record"), foods


def staging_export(records: DataFrame, foods: DataFrame, generated_at: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(recipe entries, ingredient entries, host counts, totals) of a staging manifest, for records (record) and foods (id, record)."""
    n = F.col("record.normalization")
    file = F.concat(produce.folder(F.col("record.meal_type")), F.lit("/"), F.col("record.id"), F.lit(".json"))
    listed = records.select(
        file.alias("file"), F.col("record.id").alias("recipe_id"), F.col("record.source.name").alias("source_name"), F.col("record.source.url").alias("source_url"), *[n[f].alias(f) for f in NAMED]
    )
    listed_foods = foods.select(F.concat(F.lit("_ingredients/"), "id", F.lit(".json")).alias("file"), F.col("id").alias("ingredient_id"))
    hosts = listed.groupBy(urls.host(F.col("source_url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    totals = {"publication_status": "rights-pending", "generated_at": generated_at, "total_recipes": listed.count(), "total_ingredients": listed_foods.count()}
    return listed, listed_foods, hosts, totals


def manual_promotion(rows: DataFrame, stored: DataFrame, attested: bool) -> DataFrame:
    """(id, destination, issues) of rows (candidate, record): what a person's promotion would write, if issues is empty.
    Without the attestation that the wording is original nothing may be written; a stored id (id) is never replaced."""
    if not attested:
        raise ValueError("promotion needs the attestation that directions were written independently")
    from granary.operators.review import promotion_issues

    taken = stored.select("id").distinct().withColumn("stored", F.lit(True))
    found = rows.withColumn("id", F.col("record.id")).join(taken, "id", "left")
    issues = F.concat(promotion_issues(F.col("candidate"), F.col("record")), F.array_compact(F.array(F.when(F.col("stored"), F.lit("a finalized recipe exists already")))))
    return found.select("id", F.concat(produce.folder(F.col("record.meal_type")), F.lit("/"), "id", F.lit(".json")).alias("destination"), issues.alias("issues"))
