"""JSON records, ledgers and keyed stores on any store Spark reads."""

from __future__ import annotations

import json
import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.functions.text import short_hash, slug
from granary.functions.urls import canonical
from granary.sources.stores import exists, replace_folder, write_text


def json_files(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """One record a .json file under folder, with path; a broken file fails the read. Sort by path where order counts."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True)
    return reader.option("mode", "FAILFAST").schema(schema).json(folder).withColumn("path", F.col("_metadata.file_path"))


def bundle(spark: SparkSession, folder: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records with path, rejected): the .json files that parse, and path and reason of the others."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), "value", F.try_parse_json("value").isNotNull().alias("ok"))
    good = rows.where("ok").select(F.from_json("value", schema).alias("r"), "path").select("r.*", "path")
    return good, rows.where("NOT ok").select("path", F.lit("malformed JSON").alias("reason"))


def json_array(spark: SparkSession, path: str, schema: StructType | str, key: str = "id") -> DataFrame:
    """The records of a file with a top-level array; an error where it is none, or a key is missing or not unique."""
    file = spark.read.text(path, wholetext=True)
    parsed = F.try_parse_json("value")
    checked = F.when(F.startswith(F.schema_of_variant(parsed), F.lit("ARRAY")), F.col("value")).otherwise(F.raise_error(F.lit("input must be a top-level JSON array")).cast("string"))
    struct = schema if isinstance(schema, str) else schema.simpleString()
    rows = file.select(F.explode(F.from_json(checked, f"array<{struct}>")).alias("r")).select("r.*")
    bad = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 OR {key} IS NULL").withColumnRenamed(key, "bad")
    none = bad.agg(F.count(F.lit(1)).alias("bad"))  # one row
    message = F.lit(f"every record needs a unique {key}")
    return rows.crossJoin(F.broadcast(none)).where(F.when(F.col("bad") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("bad")


def site_of(sites: DataFrame, site: str) -> dict:
    """The configured site (row of sites with id) of a name, or one of its own for an address."""
    if site.lower().startswith(("http://", "https://")):
        parts = urlsplit(site)
        return {"id": parts.hostname.removeprefix("www."), "name": parts.hostname, "base_url": f"{parts.scheme}://{parts.netloc}", "seeds": [site], "allow": [parts.path or "/"], "block": [], "max_pages": 1}
    found = sites.where(F.col("id") == site).limit(1).collect()
    if not found:
        raise ValueError(f"site '{site}' is not configured")
    return found[0].asDict(recursive=True)


def sites_of(rows: DataFrame, column: str, sites: DataFrame) -> DataFrame:
    """rows with site: a struct of id, name, base_url, seeds and configured, as site_of() gives it, for a table of names
    and addresses. An address is a site of its own, a name the row of sites (id, name, base_url, seeds) with that id; null
    where none has it and where the value is null."""
    given = F.col(column)
    address = F.rlike(given, F.lit("(?i)^https?://[^/?#]"))
    place = F.regexp_extract(given, r"^([A-Za-z]+)://([^/?#]+)", 2)
    name = F.lower(F.regexp_replace(F.regexp_replace(place, "^.*@", ""), ":[0-9]*$", ""))
    base = F.concat(F.lower(F.regexp_extract(given, "^([A-Za-z]+)", 1)), F.lit("://"), place)
    own = F.struct(F.regexp_replace(name, r"^www\.", "").alias("id"), name.alias("name"), base.alias("base_url"), F.array(given).alias("seeds"), F.lit(False).alias("configured"))
    known = sites.select(F.col("id").alias("_id"), F.struct("id", "name", "base_url", "seeds", F.lit(True).alias("configured")).alias("_known"))
    key = F.when(~F.coalesce(address, F.lit(True)), given)
    return rows.withColumn("_id", key).join(known, "_id", "left").withColumn("site", F.when(address, own).otherwise(F.col("_known"))).drop("_id", "_known")


def recovered(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Ledger rows (url, scraped_at, output, recovered) of stored candidates (source, path) whose address a ledger (url) lacks;
    of candidates with one address the first by time and path."""
    rows = candidates.where(F.coalesce("source.url", F.lit("")) != "").select(
        canonical(F.col("source.url")).alias("url"), F.col("source.retrieved_at").alias("scraped_at"), F.array("path").alias("output")
    )
    first = rows.groupBy("url").agg(F.min(F.struct("scraped_at", "output")).alias("r")).select("url", "r.scraped_at", "r.output", F.lit(True).alias("recovered"))
    return first.join(known.select(canonical(F.col("url")).alias("url")).distinct(), "url", "left_anti")


def ledger_rows(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """(url, scraped_at, output) of requested and final addresses of fetched pages (requested, final, scraped_at, output)
    that a ledger (url) lacks, each canonical address once."""
    both = fetched.select(F.explode(F.array("requested", "final")).alias("u"), "scraped_at", "output").select(canonical(F.col("u")).alias("url"), "scraped_at", "output")
    first = both.groupBy("url").agg(F.min_by(F.struct("scraped_at", "output"), "scraped_at").alias("r")).select("url", "r.scraped_at", "r.output")
    return first.join(known.select("url").distinct(), "url", "left_anti")


def store_name(name: Column, url: Column) -> Column:
    """The file of a candidate: its name's slug and twelve digits of its address's digest."""
    return F.concat(slug(name, fold=True), F.lit("-"), short_hash(url, 12), F.lit(".json"))


def catalog_json(recipes: DataFrame, ingredients: DataFrame, generated_at: str, version: str = "1.0.0") -> DataFrame:
    """(json): the whole catalog as one document, for readers that take it at once; both tables must be small. The
    tables themselves, as views, are what queries read (register())."""
    listed = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct("path", F.struct(*[c for c in df.columns if c != "path"]).alias("r")))).alias("x")).select(F.transform("x", lambda e: e["r"]).alias(name))
    both = listed(recipes, "recipes").crossJoin(listed(ingredients, "ingredients"))  # one row each
    return both.select(F.to_json(F.struct(F.lit(version).alias("schema_version"), F.lit(generated_at).alias("generated_at"), "recipes", "ingredients")).alias("json"))


def register(tables: dict[str, DataFrame]) -> None:
    """Make tables known to SQL by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def interchange(candidates: DataFrame, rejected: DataFrame, provider: str, version: str = "1.0.0") -> DataFrame:
    """(kind, json): a head row, then a row a candidate and a rejected file, so a bundle of any size is written in parallel."""
    head = F.to_json(F.struct(F.lit(version).alias("schema_version"), F.lit(provider).alias("provider")))
    rows = candidates.select(F.lit("recipe").alias("kind"), F.to_json(F.struct(*candidates.columns)).alias("json"))
    bad = rejected.select(F.lit("rejected").alias("kind"), F.to_json(F.struct(*rejected.columns)).alias("json"))
    return candidates.sparkSession.range(1).select(F.lit("bundle").alias("kind"), head.alias("json")).union(rows).union(bad)


#: What a review bundle says of itself; only such a folder may be replaced. Fixed values.
MARKER = {"bundle_kind": "meal-import-review", "review_required": True, "rights_attested": False}


def write_review_bundle(recipes: DataFrame, ingredients: DataFrame, audit: DataFrame, output: str, facts: dict, clean: bool = False) -> dict:
    """Write drafts, new ingredients and the audit beside output, then put them there. An older bundle is replaced only
    if clean is set and its manifest has the marker. Returns the manifest."""
    spark = recipes.sparkSession
    if exists(spark, output):
        if not clean:
            raise FileExistsError(f"{output} exists")
        old = json.loads(spark.read.text(f"{output}/manifest.json", wholetext=True).first()["value"]) if exists(spark, f"{output}/manifest.json") else {}
        if any(old.get(k) != v for k, v in MARKER.items()):
            raise ValueError(f"{output} is no review bundle")
    staging = f"{output.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    for name, df in (("recipes", recipes), ("ingredients", ingredients), ("audit", audit)):
        df.write.parquet(f"{staging}/{name}")
    read = spark.read.parquet
    counts = {r["category"]: r["n"] for r in read(f"{staging}/audit").groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {"recipe_count": read(f"{staging}/recipes").count(), "ingredient_candidate_count": read(f"{staging}/ingredients").count()}
    manifest = MARKER | {"schema_version": "1.0.0"} | facts | sizes | {"audit_counts": counts}
    write_text(spark, f"{staging}/manifest.json", json.dumps(manifest, indent=2) + "\n")
    replace_folder(spark, staging, output)
    return manifest


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; blank and broken lines are dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r"))
    return parsed.select("r.*")


def append_new(rows: DataFrame, key: str, path: str) -> None:
    """Append rows with keys that the parquet store at path does not have."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path).select(key).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = rows.select(key).limit(0)
    rows.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(path)
