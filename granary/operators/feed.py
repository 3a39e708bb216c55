"""The publication feed: records with digests, numbered pages and a signed manifest, built beside the old one and
swapped in when it verifies."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import numbers, text, urls
from granary.functions.text import arrow_udf, bound, canonical
from granary.operators.publish import eligible, paged
from granary.sources.stores import current, kept, publish, replace_folder, write_text

VERSION = "1.1.0"


def required(value: Column, label: str) -> Column:
    """The value; an error where it is null or blank."""
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", value).otherwise(F.raise_error(F.lit(f"{label} must be a non-empty string")).cast("string"))


def source_url(url: Column) -> Column:
    """The address as it is published; an error where it can't be."""
    return required(urls.publishable(required(url, "source URL")), "an HTTP source URL without credentials")


def ingredient_line(i: Column) -> Column:
    """"[quantity [unit] ]item[, preparation][ (optional)]" of an ingredient (struct, quantity as a text)."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    amount = F.concat(F.when(some(i["quantity"]), F.concat(i["quantity"], F.lit(" "))).otherwise(F.lit("")), F.when(some(i["unit"]), F.concat(i["unit"], F.lit(" "))).otherwise(F.lit("")))
    tail = F.concat(F.when(some(i["preparation"]), F.concat(F.lit(", "), i["preparation"])).otherwise(F.lit("")), F.when(i["optional"], F.lit(" (optional)")).otherwise(F.lit("")))
    return F.concat(amount, i["item"], tail)


def is_eligible(record: Column) -> Column:
    n = record["normalization"]
    return (F.coalesce(record["source"]["url"], F.lit("")) != "") & eligible(record["source"]["url"], n["requires_review"], n["source_review_status"], n["source_text_hash"], n["normalized_text_hash"])


def _signed(records: pd.Series) -> pd.Series:
    return records.map(lambda v: canonical(with_digest(json.loads(v))))


def content_digest(record: dict) -> str:
    """sha-256 of the canonical JSON of a feed record without its digest and the time it was retrieved."""
    content = {k: v for k, v in record.items() if k != "content_hash"}
    content["source"] = {k: v for k, v in record["source"].items() if k != "retrieved_at"}
    return hashlib.sha256(canonical(content).encode()).hexdigest()


def with_digest(record: dict) -> dict:
    whole = {"nutrition": None, **record}
    return whole | {"content_hash": content_digest(whole)}


signed = arrow_udf(_signed, "string")


def feed_records(recipes: DataFrame, record: str = "record") -> DataFrame:
    """(archive_id, url, body) of the eligible records (a struct column), body as canonical JSON with its digest.

    A record without description has an empty one, without inactive minutes none, without nutrition null.
    """

    def made(p: Column) -> Column:
        r, url = p["r"], p["url"]
        moment = numbers.since_or_day(r["normalization"]["transformed_at"], r["updated_at"])
        wire = F.struct(
            p["archive_id"].alias("archive_id"), p["slug"].alias("slug"), F.lit("normalized-and-reviewed").alias("review_status"),
            F.struct(required(r["source"]["name"], "source name").alias("name"), url.alias("url"), required(moment, "time of the record").alias("retrieved_at")).alias("source"),
            required(r["name"], "name").alias("name"), F.coalesce(r["description"], F.lit("")).alias("description"), r["yield"].alias("yield"),
            F.struct(
                r["times"]["prep_minutes"].alias("prep_minutes"), r["times"]["cook_minutes"].alias("cook_minutes"), F.coalesce(r["times"]["inactive_minutes"], F.lit(0)).alias("inactive_minutes")
            ).alias("times"),
            F.transform(r["ingredients"], ingredient_line).alias("ingredient_lines"), F.transform(r["instructions"], lambda s: s["text"]).alias("instruction_lines"),
            F.coalesce(r["tags"], F.array().cast("array<string>")).alias("categories"), r["nutrition"].alias("nutrition"), r["normalization"].alias("normalization"),
        )
        return F.struct(p["archive_id"].alias("archive_id"), url.alias("url"), F.to_json(wire).alias("json"))

    whole = F.col(record)
    # folding is a Python function, which can't stand in a lambda
    slug = text.slug(required(F.coalesce(whole["id"], whole["name"]), "id or name"))
    # the address and its id are found once a row, whatever reads them
    with_url = lambda p: p.withField("url", source_url(p["r"]["source"]["url"]))
    with_id = lambda p: p.withField("archive_id", urls.archive_id(p["url"]))
    parts = F.struct(whole.alias("r"), slug.alias("slug"))
    rows = recipes.where(is_eligible(whole)).select(bound(bound(bound(parts, with_url), with_id), made).alias("r"))
    return rows.select("r.archive_id", "r.url", signed(F.col("r.json")).alias("body"))


def unique(records: DataFrame, *keys: str) -> DataFrame:
    """records; an error where two have the same value in one of the keys."""
    for key in keys:
        repeated = records.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        message = F.concat(F.lit(f"duplicate {key}: "), F.col(key))
        records = records.join(repeated, key).where(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_n")
    return records


def feed_pages(records: DataFrame, release: str, size: int = 250) -> DataFrame:
    """(page, file, record_count, sha256, archive_id_start, archive_id_end, body) in code point order of archive_id."""
    if size < 1:
        raise ValueError("a page must have a record at least")
    # each check joins the records with themselves, and ranges are sampled before they are dealt
    records = kept(records, "feed-records")
    placed = paged(unique(records, "url", "archive_id").select("archive_id", "body"), "archive_id", size)
    bodies = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "body"))), lambda x: x["body"]), ",")
    grouped = placed.groupBy("page").agg(F.count(F.lit(1)).alias("record_count"), F.min("archive_id").alias("archive_id_start"), F.max("archive_id").alias("archive_id_end"), bodies.alias("bodies"))
    body = F.concat(F.lit('{"page":'), F.col("page").cast("string"), F.lit(',"recipes":['), "bodies", F.lit(f'],"release_id":{json.dumps(release)},"schema_version":"{VERSION}"}}\n'))
    whole = grouped.withColumn("body", body)
    return whole.select("page", text.page_name(F.col("page")).alias("file"), "record_count", F.sha2("body", 256).alias("sha256"), "archive_id_start", "archive_id_end", "body")


def manifest_of(pages: DataFrame, release: str, generated_at: str) -> str:
    """The manifest as canonical JSON with its own digest; there is a descriptor a page, some hundred bytes each."""
    listed = [r.asDict() for r in pages.drop("body").orderBy("page").collect()]
    unsigned = {
        "schema_version": VERSION, "release_id": release, "generated_at": generated_at, "total_records": sum(p["record_count"] for p in listed), "total_pages": len(listed), "pages": listed,
    }
    return canonical(unsigned | {"manifest_hash": hashlib.sha256(canonical(unsigned).encode()).hexdigest()}) + "\n"


def build_feed(recipes: DataFrame, output: str, release: str, generated_at: str, size: int = 250, record: str = "record") -> dict:
    """Write the feed of eligible records beside output, verify it, and put it in output's place; the old one stays
    where anything fails. The same records give the same bytes. Returns the manifest."""
    spark = recipes.sparkSession
    replace_folder(spark, _verified(recipes, output, release, generated_at, size, record), output)
    return read_manifest(spark, output)


def publish_feed(recipes: DataFrame, output: str, release: str, generated_at: str, size: int = 250, record: str = "record") -> dict:
    """build_feed() as a new version of output: a crash at any time leaves readers, who read stores.current(), the old feed or the new one."""
    spark = recipes.sparkSession
    publish(spark, _verified(recipes, output, release, generated_at, size, record), output)
    return read_manifest(spark, current(spark, output))


def _verified(recipes: DataFrame, output: str, release: str, generated_at: str, size: int, record: str) -> str:
    """The path of a whole and verified feed beside output."""
    for name, value in (("output", output), ("release", release), ("generated_at", generated_at)):
        if not value.strip():
            raise ValueError(f"{name} must be a non-empty string")
    spark = recipes.sparkSession
    staging = f"{output.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    pages = feed_pages(feed_records(recipes, record), release, size)
    pages.select("file", F.regexp_replace("body", "\n$", "").alias("value")).write.partitionBy("file").option("lineSep", "\n").text(f"{staging}/pages")
    # descriptors come from what was written
    stored = _stored(spark, f"{staging}/pages")
    write_text(spark, f"{staging}/manifest.json", manifest_of(_described(stored).drop("problem"), release, generated_at))
    problems = feed_problems(spark, staging)
    found = [r["problem"] for r in problems.limit(20).collect()]
    if found:
        raise ValueError("; ".join(found))
    return staging


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()["value"])


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the pages under path; a page without rows leaves no file."""
    names = F.regexp_extract("path", "/file=([^/]+)/", 1)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return found.select(names.alias("file"), F.col("content").cast("string").alias("content")).where("file <> ''")


RECORD = (
    "struct<archive_id: string, content_hash: string, source: struct<url: string>, normalization: struct<requires_review: boolean, source_review_status: string>>"
)


def _described(stored: DataFrame) -> DataFrame:
    """Descriptors of stored pages, recomputed from their bytes."""
    page = F.from_json("content", "page long, release_id string, recipes array<struct<archive_id: string>>")
    read = stored.withColumn("p", page)
    return read.select(
        F.col("p.page").alias("page"), "file", F.size("p.recipes").cast("long").alias("record_count"), F.sha2("content", 256).alias("sha256"), F.get("p.recipes.archive_id", F.lit(0)).alias("archive_id_start"),
        F.element_at("p.recipes.archive_id", -1).alias("archive_id_end"), F.lit(None).cast("string").alias("problem"),
    )


def _digests(records: pd.Series) -> pd.Series:
    return records.map(lambda v: content_digest(json.loads(v)))


def feed_problems(spark: SparkSession, path: str) -> DataFrame:
    """(problem): everything that a feed's manifest and pages disagree on, recomputed from the stored bytes."""
    manifest = read_manifest(spark, path)
    unsigned = {k: v for k, v in manifest.items() if k != "manifest_hash"}
    listed, problems = manifest["pages"], []
    if manifest["manifest_hash"] != hashlib.sha256(canonical(unsigned).encode()).hexdigest():
        problems.append("manifest hash does not match canonical manifest JSON")
    if manifest["total_pages"] != len(listed):
        problems.append("manifest total_pages does not match page descriptors")
    for n, page in enumerate(listed, 1):
        if page["page"] != n or page["file"] != f"page-{n:05}.json":
            problems.append(f"page descriptor {n} has page {page['page']} and file '{page['file']}'")
    if manifest["total_records"] != sum(p["record_count"] for p in listed):
        problems.append("manifest total_records does not match page records")
    found = spark.createDataFrame([(p,) for p in problems], "problem string")
    if not listed:
        return found
    stored = _stored(spark, f"{path}/pages")
    wanted = spark.createDataFrame([tuple(p[k] for k in ("page", "file", "record_count", "sha256", "archive_id_start", "archive_id_end")) for p in listed],
                                   "page long, file string, record_count long, sha256 string, archive_id_start string, archive_id_end string")
    cells = lambda names: F.struct(*names)
    names = ["page", "record_count", "sha256", "archive_id_start", "archive_id_end"]
    a, b = wanted.select("file", cells(names).alias("w")), _described(stored).select("file", cells(names).alias("g"))
    issue = (
        F.when(F.col("g").isNull(), F.lit("is missing")).when(F.col("w").isNull(), F.lit("is not listed")).when(F.col("g.sha256") != F.col("w.sha256"), F.lit("hash does not match declared sha256"))
        .when(~F.col("g").eqNullSafe(F.col("w")), F.lit("does not match its descriptor"))
    )
    found = found.union(a.join(b, "file", "full_outer").where(issue.isNotNull()).select(F.concat("file", F.lit(" "), issue)))
    content = stored.select("file", F.from_json("content", f"release_id string, recipes array<{RECORD}>").alias("p"), F.from_json("content", "recipes array<string>").alias("raw"))
    found = found.union(content.where(~F.col("p.release_id").eqNullSafe(F.lit(manifest["release_id"]))).select(F.concat("file", F.lit(" release_id does not match manifest"))))
    each = content.select(F.explode(F.arrays_zip(F.col("p.recipes").alias("r"), F.col("raw.recipes").alias("json"))).alias("e")).select("e.r", "e.json")
    url, id_ = F.col("r.source.url"), F.col("r.archive_id")
    cleared = F.col("r.normalization.requires_review").eqNullSafe(F.lit(False)) & F.col("r.normalization.source_review_status").eqNullSafe(F.lit("passed"))
    checked = each.withColumn("digest", arrow_udf(_digests, "string")(F.col("json")))
    says = lambda when, what: F.when(when, F.concat(F.lit("recipe '"), id_, F.lit(f"' {what}")))
    wrong = F.array_compact(
        F.array(
            says(~urls.publishable(url).eqNullSafe(url), "source URL is not canonical"), says(~id_.eqNullSafe(urls.archive_id(url)), "archive_id does not match its canonical source URL"),
            says(~F.col("digest").eqNullSafe(F.col("r.content_hash")), "content_hash does not match its content"), says(~cleared, "is not cleared for publication"),
        )
    )
    found = found.union(checked.select(F.explode(wrong)))
    for name, column in (("source URL", url), ("archive_id", id_)):
        found = found.union(each.groupBy(column.alias("v")).count().where("count > 1").select(F.concat(F.lit(f"duplicate {name} '"), "v", F.lit("' in feed"))))
    return found
