"""Promotion over tables: every part is a staged record, and its columns say what becomes of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import staging
from granary.plans.catalog import _query, _t

_NORMAL = (
    "struct<source_text_hash: string, normalized_text_hash: string, model: string, prompt_version: string, transformed_at: string, requires_review: boolean, source_review_status: string>"
)
#: Hosts are brands; each brand's number gives its rights and how many records a run may take from it.
_PARTS = """p AS (SELECT *, lpad(p_partkey::VARCHAR, 12, '0') AS file, lower(replace(p_brand, '#', '-')) || '.example' AS host, substr(p_brand, 7)::INT AS b FROM part)"""
#: The rights' reasons of a host, and its cap's: no more clean rows before than the cap, which counts a run's rows alone.
_JUDGED = """rank AS (SELECT *, count(*) FILTER (WHERE clean) OVER (PARTITION BY host ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM {0}),
judged AS (SELECT *, CASE WHEN b = 13 THEN 'no publication-rights record exists for ' || host WHEN b % 4 = 0 THEN host || ' is marked draft-only'
  WHEN least(earlier, 3 + b) + 1 > 3 + b THEN host || ' exceeds its ' || (3 + b) || '-recipe per-run cap' ELSE '' END AS held FROM rank)"""


def _policy(spark, sf_dir):
    hosts = _t(spark, sf_dir, "part").select(F.lower(F.regexp_replace("p_brand", "#", "-")).alias("h"), F.substring("p_brand", 7, 9).cast("int").alias("b")).where("b <> 13").distinct()
    approved = F.col("b") % 4 != 0
    return hosts.select(
        F.concat("h", F.lit(".example")).alias("host"), F.when(approved, F.lit("approved")).otherwise(F.lit("draft-only")).alias("status"), F.lit("cc0").alias("basis"), F.lit("e").alias("evidence"),
        F.lit("2026-01-01").alias("reviewed_at"), F.lit("").alias("expires_at"), F.when(approved, F.col("b") + 3).otherwise(F.lit(0)).alias("max_per_run"), F.lit(0).alias("max_catalog"),
    )


def _rows(spark, sf_dir):
    file = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    url = F.concat(F.lit("https://"), F.lower(F.regexp_replace("p_brand", "#", "-")), F.lit(".example/"), F.col("p_partkey").cast("string"))
    return _t(spark, sf_dir, "part").withColumn("file", file).withColumn("url", url)


def _normal(source, final):
    return F.struct(
        source.alias("source_text_hash"), final.alias("normalized_text_hash"), F.lit("m").alias("model"), F.lit("1").alias("prompt_version"), F.lit("t").alias("transformed_at"),
        F.lit(False).alias("requires_review"), F.lit("passed").alias("source_review_status"),
    )


def _source(url):
    return F.struct(F.lit("S").alias("name"), url.alias("url"), F.lit(True).alias("adapted"))


@_query(f"""WITH {_PARTS},
s AS (SELECT *, 'part-' || (p_partkey // 2) AS recipe_id, list_contains(string_split(p_name, ' '), 'ring') AS missing, list_contains(string_split(p_name, ' '), 'red') AS odd FROM p WHERE p_size <> 1),
n AS (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY file) AS nth FROM s),
c AS (SELECT *, p_size = 2 AS taken, nth > 1 OR EXISTS (SELECT 1 FROM p AS f WHERE f.p_size <= 2 AND f.p_partkey = n.p_partkey // 2 * 2 + 1 AND f.p_size = 2) AS used FROM n),
d AS (SELECT *, NOT taken AND NOT used AND NOT missing AND NOT odd AS clean FROM c),
{_JUDGED.format('d')}
SELECT recipe_id, 'https://' || host || '/' || p_partkey AS url,
  CASE WHEN taken OR used THEN 'conflict' WHEN held <> '' THEN 'publication-hold' WHEN missing OR odd THEN 'conflict' ELSE 'promoted' END AS status,
  CASE WHEN taken THEN 'source URL is finalized with different normalized content' WHEN used THEN 'recipe id is already finalized for another source' WHEN held <> '' THEN held
  ELSE array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'ring' THEN 'missing staged ingredient ''ring''' WHEN 'red' THEN 'staged ingredient ''red'' conflicts with finalized data' END), lambda m: m IS NOT NULL), '; ') END AS reasons
FROM judged""")
def staging_promote(spark, sf_dir):
    """Parts of size 1 are published as they are, those of size 2 otherwise; two parts share an id; of the ingredients, a
    part's name's words, 'ring' is missing and 'red' is published otherwise."""
    rows = _rows(spark, sf_dir)
    half = F.concat(F.lit("part-"), F.floor(F.col("p_partkey") / 2).cast("string"))
    foods = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("ingredient_id")))
    record = lambda id_, digest: F.struct(id_.alias("id"), foods.alias("ingredients"), _source(F.col("url")).alias("source"), _normal(F.lit("s"), digest).alias("normalization"))
    staged = rows.select("file", record(half, F.sha2("p_type", 256)).alias("record"))
    # a published part of an odd key and size 2 holds the id that both parts of its pair would have
    final_id = F.when((F.col("p_size") == 2) & (F.col("p_partkey") % 2 == 1), half).otherwise(F.concat(F.lit("final-"), F.col("p_partkey").cast("string")))
    final = rows.where("p_size <= 2").select(record(final_id, F.when(F.col("p_size") == 1, F.sha2("p_type", 256)).otherwise(F.lit("other"))).alias("record"))
    words = rows.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    food = lambda df, note: df.select(F.struct(F.col("w").alias("id"), F.lit(note).alias("notes")).alias("record"))
    got = staging.promoted(
        staged, final, food(words.where("w <> 'ring'"), "staged"), food(words.where("w = 'red'"), "final"), _policy(spark, sf_dir), F.lit("2026-01-02").cast("timestamp"), 30, 100.0, 10**6
    )
    return got.select("recipe_id", "url", "status", F.array_join("reasons", "; ").alias("reasons"))


_FOOD = "item: string, quantity: string, unit: string, preparation: string, optional: boolean"
_DRAFT = (
    "struct<name: string, subtitle: string, description: string, meal_type: string, cuisine: string, yield: struct<quantity: double, unit: string>, times: struct<prep_minutes: int, cook_minutes: int, inactive_minutes: int>, "
    f"instructions: array<struct<text: string, timer_minutes: int>>, ingredients: array<struct<{_FOOD}>>, tags: array<string>, seasons: array<string>, dietary: array<string>, allergens: array<string>, equipment: array<string>>"
)


@_query(f"""WITH {_PARTS},
s AS (SELECT *, p_size = 3 AS close, p_size = 4 AS changed, p_size = 1 AS finalized FROM p),
d AS (SELECT *, NOT close AND NOT changed AND NOT finalized AS clean FROM s),
{_JUDGED.format('d')}
SELECT file, CASE WHEN close OR changed THEN 'needs-review' WHEN finalized THEN 'already-finalized' WHEN held <> '' THEN 'publication-hold' WHEN p_size = 5 THEN 'failed' ELSE 'promoted' END AS status,
  CASE WHEN close THEN 'too close' WHEN changed THEN 'source expressive text changed after staging' WHEN finalized THEN '' WHEN held <> '' THEN held
  WHEN p_size = 5 THEN 'rematerialized recipe hashes do not match the staged normalization' ELSE '' END AS reasons
FROM judged""")
def staged_outcome(spark, sf_dir):
    out, _, _ = _outcome(spark, sf_dir)
    return out.select("file", "status", F.array_join("reasons", "; ").alias("reasons"))


def _outcome(spark, sf_dir):
    """Parts of size 1 are published, of size 3 too close, of size 4 with another source text; those of size 5 were
    staged with steps that their drafts don't have."""
    rows = _rows(spark, sf_dir)
    lines = F.array(F.col("p_type"))
    none = F.array().cast("array<string>")
    steps = F.array(F.when(F.col("p_size") == 5, F.lit("Other.")).otherwise(F.concat(F.lit("Make "), F.col("p_name"), F.lit("."))))
    extracted = F.struct(F.col("p_name").alias("description"), lines.alias("instruction_lines"))
    source_hash = F.when(F.col("p_size") == 4, F.lit("old")).otherwise(text.source_digest(F.col("p_name"), lines))
    food = F.array(F.struct(F.col("p_name").alias("item"), F.lit("1").alias("quantity"), F.lit("cup").alias("unit"), F.lit("").alias("preparation"), F.lit(False).alias("optional")))
    record = F.struct(
        F.lit("").alias("subtitle"), F.lit("").alias("description"), F.transform(steps, lambda s: F.struct(s.alias("text"))).alias("instructions"),
        _normal(source_hash, text.final_digest(F.lit(""), F.lit(""), steps)).alias("normalization"),
    )
    drafted = F.struct(
        F.col("p_name").alias("name"), F.lit("").alias("description"), F.lit("main").alias("meal_type"),
        F.array(F.struct(F.concat(F.lit("Make "), F.col("p_name"), F.lit(".")).alias("text"), F.lit(0).alias("timer_minutes"))).alias("instructions"),
    )
    stage = F.struct(
        F.lit("1.0.0").alias("schema_version"), F.lit("scraping/output/s/x.json").alias("candidate_file"), F.lit("1").alias("pipeline_version"), F.lit("m").alias("model"), F.lit("t").alias("staged_at"),
        F.when(F.col("p_size") == 3, F.array(F.lit("too close"))).otherwise(none).alias("content_reasons"), record.alias("record"), F.struct(food.alias("ingredients")).alias("facts"),
        F.struct(F.from_json(F.to_json(drafted), _DRAFT).alias("recipe")).alias("generated"),
    )
    stages = rows.select("file", F.struct(F.lit("S").alias("name"), "url").alias("source"), extracted.alias("extracted"), stage.alias("stage"))
    final = rows.where("p_size = 1").select(F.struct(F.concat(F.lit("final-"), "file").alias("id"), _source(F.col("url")).alias("source")).alias("record"))
    known = spark.createDataFrame([("salt", "Salt", [])], "id string, name string, aliases array<string>")
    return staging.staged_outcome(stages, final, known, _policy(spark, sf_dir), F.lit("2026-01-02").cast("timestamp"), 30, 100.0, 10**6, F.lit("2026-01-02"))


@_query(f"""WITH {_PARTS}, d AS (SELECT *, p_size NOT IN (1, 3, 4) AS clean FROM p), {_JUDGED.format('d')},
made AS (SELECT *, replace(p_name, ' ', '-') AS base, row_number() OVER (PARTITION BY p_name ORDER BY file) AS nth FROM judged WHERE clean AND held = '')
SELECT file, base || CASE WHEN nth > 1 THEN '-' || substr(sha256('https://' || host || '/' || p_partkey), 1, 8) ELSE '' END AS id, base AS ingredient_id FROM made WHERE p_size <> 5""")
def staged_records(spark, sf_dir):
    """What staged_outcome publishes: of parts with one name the first has it as its id."""
    _, records, _ = _outcome(spark, sf_dir)
    return records.select("file", "record.id", F.get("record.ingredients", F.lit(0))["ingredient_id"].alias("ingredient_id"))
