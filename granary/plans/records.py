"""Queries of whole operators: search, resolution, gates, feeds, imports, promotion, sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text, urls
from granary.operators import crawl, feed, gates, legacy, materialize, personal, resolve, search, similarity, staging, validate
from granary.plans.catalog import _HOST, _KEY, _query, _t
from granary.plans.golden import cases
from granary.sources import records as sources
from granary.sources import stores


def _values(*rows: tuple) -> str:
    cell = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def _fixture(spark: SparkSession, schema: str, *rows: dict) -> DataFrame:
    lines = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "j string")
    return lines.select(F.from_json("j", f"struct<{schema}>").alias("r")).select("r.*")


# search


@_query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'a') AND p_size = 7 AND list_contains(string_split(p_type, ' '), split_part(p_type, ' ', 1))")
def facet_search(spark, sf_dir):
    kinds = F.split("p_type", " ")
    part = _t(spark, sf_dir, "part").withColumn("kinds", kinds)
    found = search.matches(" A ", [F.col("p_name"), F.col("p_brand"), F.col("p_type")], [(F.col("p_size").cast("string"), "7"), (F.col("p_brand"), "all")], [(F.col("kinds"), "all")])
    return part.where(found & F.array_contains("kinds", F.get("kinds", F.lit(0)))).select("p_partkey")


@_query("SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'red') AND contains(lower(p_name), 'r')")
def facet_arrays(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(search.matches("R", [F.col("p_name")], [], [(F.split(F.lower("p_name"), " "), "red")])).select("p_partkey")


@_query("SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def limit_in_order(spark, sf_dir):
    return search.first_in_order(_t(spark, sf_dir, "supplier"), [F.col("s_acctbal").desc(), "s_suppkey"], 10).select("s_suppkey")


@_query("SELECT n_name, row_number() OVER (ORDER BY n_nationkey)::INT AS place FROM nation WHERE n_regionkey = 1")
def restored_order(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").where("n_regionkey = 1")
    back = search.in_order_of(nation.orderBy(F.xxhash64("n_name")), _t(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("pos")), "n_name", "pos")
    return back.select("n_name", F.rank().over(Window.orderBy("pos")).alias("place"))


@_query("SELECT * FROM " + _values(("a", 1), ("A", 2), ("b", 3), ("B", 4), ("é", 5), ("f", 6)) + " AS v(word, place)")
def collation_order(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ("b", "f", "A", "é", "a", "B")], "word string")
    listed = search.collated(words, "word").agg(F.collect_list("word").alias("w"))
    return listed.select(F.posexplode("w").alias("place", "word")).select("word", (F.col("place") + 1).alias("place"))


_SPACES = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_DECODED = r"regexp_replace(html, '<[^>]*>', ' ', 'g')"
for _name, _sign in text.ENTITIES.items():
    if _name != "amp":
        _DECODED = f"replace({_DECODED}, '&{_name};', '{_sign.replace(chr(39), chr(39) * 2)}')"


@_query(rf"SELECT page_id, trim(regexp_replace(regexp_replace(replace({_DECODED}, '&amp;', '&'), '{_SPACES}', ' ', 'g'), ' ([,.;:!?])', '\1', 'g'), ' ') AS plain_text FROM pages")
def plain_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.plain_text("html").alias("plain_text"))


@_query(rf"""SELECT page_id FROM pages WHERE {_HOST} LIKE '%e%' AND (contains(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/en/') OR contains(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/fr/'))
AND NOT contains(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/1')""")
def allow_block_filter(spark, sf_dir):
    url = F.col("url")
    wanted = urls.listed(url, url, F.array(F.lit("/en/"), F.lit("/fr/")), F.array(F.lit("/1")))
    return _t(spark, sf_dir, "pages").where(wanted & F.contains(urls.host(url), F.lit("e"))).select("page_id")


# resolution


@_query(f"""WITH i AS (SELECT {_KEY.format('p_name')} AS k, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT l_orderkey, l_linenumber, id FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN i ON i.k = {_KEY.format("upper(p_name)")}""")
def alias_resolve(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    lines = _t(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.concat(F.upper("p_name"), F.lit("®* (Optional)")).alias("item"))
    lines = lines.withColumn("item", F.lower("item"))
    return resolve.resolved(lines, "item", resolve.alias_index(part, "p_partkey", ["p_name"])).select("l_orderkey", "l_linenumber", "id")


@_query(f"SELECT key, count(DISTINCT id)::BIGINT AS n_ids FROM (SELECT p_partkey AS id, {_KEY.format('p_name')} AS key FROM part UNION SELECT p_partkey, {_KEY.format('p_brand')} FROM part) WHERE key <> '' GROUP BY key HAVING count(DISTINCT id) > 1")
def ambiguous_alias(spark, sf_dir):
    return resolve.ambiguous(resolve.alias_index(_t(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand"]))


@_query("SELECT * FROM " + _values(("EVOO", "olive-oil"), ("Yellow Onions", "onion"), ("Sea salt", "salt"), ("garlic clove", None), ("Olive-Oil", "olive-oil"), ("Tofu", None)) + " AS v(item, id)")
def synonym_resolve(spark, sf_dir):
    known = spark.createDataFrame([("olive-oil", "Olive Oil", []), ("onion", "Onion", ["Red onion"]), ("salt", "Salt", ["Sea Salt"])], "id string, name string, aliases array<string>")
    rows = spark.createDataFrame([(x,) for x in ("EVOO", "Yellow Onions", "Sea salt", "garlic clove", "Olive-Oil", "Tofu")], "item string")
    return resolve.with_synonyms(rows, "item", resolve.alias_index(known, "id", ["id", "name"], ["aliases"])).select("item", "id")


_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@_query(f"SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY b) > 1 OR b IN (SELECT {_SLUG.format('p_name')} FROM part WHERE p_partkey % 10 = 0) THEN substr(b, 1, 91) || '-' || right(p_partkey::VARCHAR, 8) ELSE b END AS minted_id FROM (SELECT p_partkey, {_SLUG.format('p_name')} AS b FROM part)")
def mint_ids(spark, sf_dir):
    part = _t(spark, sf_dir, "part").withColumn("base", text.slug(F.col("p_name")))
    taken = part.where("p_partkey % 10 = 0").select(F.col("base").alias("id"))
    return resolve.minted_ids(part, "p_partkey", "base", "p_partkey", taken).select("p_partkey", "minted_id")


@_query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN substr(b, 1, 91) || '-' || substr(sha256(p_name), 1, 8) ELSE b END AS id FROM (SELECT p_partkey, p_name, {_SLUG.format('p_brand')} AS b FROM part)")
def unique_recipe_id(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", resolve.unique_id(text.slug(F.col("p_brand")), F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("id"))


@_query(f"""WITH u AS (SELECT p_partkey * 2 AS seq, p_name || ' optional' AS item, {_KEY.format('p_name')} || ' optional' AS key, {_SLUG.format('p_name')} || '-optional' AS base FROM part
UNION ALL SELECT p_partkey * 2 + 1, p_name || ' (optional)', {_KEY.format('p_name')}, {_SLUG.format('p_name')} || '-optional' FROM part),
k AS (SELECT 'known-' || p_partkey AS id, {_KEY.format('p_name')} AS key FROM part WHERE p_partkey % 5 = 2),
f AS (SELECT key, min(seq) AS seq, arg_min(base, seq) AS base FROM u WHERE key NOT IN (SELECT key FROM k) GROUP BY key)
SELECT key, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY seq) > 1 THEN substr(base, 1, 91) || '-' || substr(sha256(key), 1, 8) ELSE base END AS id, 'cup' AS unit FROM f""")
def planned_ingredients(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    usages = part.select((F.col("p_partkey") * 2).alias("seq"), F.concat("p_name", F.lit(" optional")).alias("item"), F.lit("Cups").alias("unit"))
    usages = usages.union(part.select(F.col("p_partkey") * 2 + 1, F.concat("p_name", F.lit(" (optional)")), F.lit("cups")))
    known = part.where("p_partkey % 5 = 2").select(F.concat(F.lit("known-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return resolve.planned_ingredients(usages, ["seq"], known).select("key", "id", F.col("record.default_unit").alias("unit"))


@_query("SELECT p_brand, n, min(p_type) AS p_type FROM (SELECT *, max(n) OVER (PARTITION BY p_brand) AS m FROM (SELECT p_brand, p_type, count(*)::BIGINT AS n FROM part GROUP BY ALL)) WHERE n = m GROUP BY p_brand, n")
def mode_unit(spark, sf_dir):
    return resolve.mode_of(_t(spark, sf_dir, "part"), "p_brand", "p_type")


@_query(f"SELECT key, string_agg(DISTINCT n, ';' ORDER BY n) AS names, string_agg(u, ';' ORDER BY id) AS usages FROM (SELECT {_KEY.format('p_brand')} AS key, p_brand AS n, p_partkey AS id, p_partkey || ':' || p_size AS u FROM part) GROUP BY key")
def key_groups(spark, sf_dir):
    groups = resolve.name_groups(_t(spark, sf_dir, "part"), "p_brand", ["p_partkey", "p_size"])
    shown = F.transform("usages", lambda u: F.concat_ws(":", u["p_partkey"].cast("string"), u["p_size"].cast("string")))
    return groups.select("key", F.array_join("names", ";").alias("names"), F.array_join(shown, ";").alias("usages"))


@_query("SELECT p_name, count(*)::BIGINT AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY p_name HAVING count(*) > 1")
def dup_title_ids(spark, sf_dir):
    return resolve.duplicate_groups(_t(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_name", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


# gates


@_query("""WITH RECURSIVE s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
f AS (SELECT 0::BIGINT AS i, list_transform(range(25), lambda x: 0::BIGINT) AS c, 0::BIGINT AS t, FALSE AS ok
UNION ALL SELECT s.i, CASE WHEN t + 1 < 20 OR (c[s_nationkey + 1] + 1) * 100.0 <= 10.0 * (t + 1) THEN list_transform(range(25), lambda x: c[x + 1] + (x = s_nationkey)::BIGINT) ELSE c END,
t + (t + 1 < 20 OR (c[s_nationkey + 1] + 1) * 100.0 <= 10.0 * (t + 1))::BIGINT, t + 1 < 20 OR (c[s_nationkey + 1] + 1) * 100.0 <= 10.0 * (t + 1) FROM f JOIN s ON s.i = f.i + 1)
SELECT s_suppkey, s_nationkey::VARCHAR AS nation, ok AS accepted FROM f JOIN s ON s.i = f.i""")
def concentration_fold(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"))
    return gates.share_gate(rows, "nation", "s_suppkey", 10.0, 20).select("s_suppkey", "nation", "accepted")


@_query(f"""WITH p AS (SELECT page_id, url, {_HOST} AS host FROM pages), k AS (SELECT host, count(*) AS held FROM p WHERE page_id % 10 = 0 GROUP BY host),
q AS (SELECT p.*, coalesce(held, 0) AS held, length(p.host) % 3 = 0 AS unknown, length(p.host) % 5 = 0 AS draft FROM p LEFT JOIN k ON k.host = p.host),
r AS (SELECT *, coalesce(sum((NOT unknown AND NOT draft)::INT) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM q),
s AS (SELECT *, least(earlier, greatest(0, least(2, 3 - held))) AS run FROM r)
SELECT page_id, host, NOT unknown AND NOT draft AND run + 1 <= 2 AND held + run + 1 <= 3 AS accepted,
CASE WHEN unknown THEN 'no publication-rights record exists for ' || host ELSE array_to_string(list_filter([CASE WHEN draft THEN host || ' is marked draft-only' END,
CASE WHEN run + 1 > 2 THEN host || ' exceeds its 2-recipe per-run cap' END, CASE WHEN held + run + 1 > 3 THEN host || ' exceeds its 3-recipe catalog cap' END], lambda x: x IS NOT NULL), '; ') END AS issues FROM s""")
def rights_gate(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url")
    hosts = pages.select(urls.host(F.col("url")).alias("host"))
    held = pages.where("seq % 10 = 0").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.length("host") % 5 == 0, "draft-only").otherwise("approved")
    policy = hosts.distinct().where(F.length("host") % 3 != 0).select(
        "host", status.alias("status"), F.lit("cc0").alias("basis"), F.lit("x").alias("evidence"), F.lit("2026-01-01").alias("reviewed_at"), F.lit("").alias("expires_at"), F.lit(2).alias("max_per_run"), F.lit(3).alias("max_catalog")
    )
    got = gates.rights_verdict(pages, policy, held, F.lit("2026-01-02").cast("timestamp"), 30, 100.0, 10**9)
    return got.select(F.col("seq").alias("page_id"), "host", "accepted", F.array_join("rights_issues", "; ").alias("issues"))


_RIGHTS = "host string, status string, basis string, evidence string, reviewed_at string, expires_at string, max_per_run int, max_catalog int, notes string"


@_query("SELECT * FROM " + _values(
    ("a", "approved", "cc0", "e2", 3, 9, "n"), ("b", "draft-only", "unverified", "", 0, 0, "kept"), ("c", "approved", "first-party", "e", 0, 0, ""), ("d", "approved", "cc0", "e", 1, 1, "d"),
) + " AS v(host, status, basis, evidence, max_per_run, max_catalog, notes)")
def rights_upsert(spark, sf_dir):
    policy = spark.createDataFrame([("a", "draft-only", "unverified", "", "", "", 3, 4, "n"), ("b", "approved", "cc0", "e", "2026-01-01", "", 5, 6, "kept"), ("d", "approved", "cc0", "e", "2026-01-01", "", 1, 1, "d")], _RIGHTS)
    changes = spark.createDataFrame([("a", True, "cc0", "e2", "2026-01-01", None, None, 9, None), ("b", False, None, None, None, None, None, None, None), ("c", True, "first-party", "e", "2026-01-01", "", None, None, None)], _RIGHTS.replace("status string", "approve boolean"))
    return gates.upserted_rights(policy, changes).select("host", "status", "basis", "evidence", "max_per_run", "max_catalog", "notes")


# feeds

_FEED_URL = "'https://shop' || s_nationkey || '.example/p/' || s_suppkey"
_NORMALIZED = ("'{\"model\":\"m\",\"model_version\":\"m\",\"normalized_text_hash\":\"' || sha256('b' || s_suppkey) || '\",\"prompt_version\":\"1\",\"requires_review\":false,\"semantic_similarity\":10,"
               "\"source_review_status\":\"passed\",\"source_text_hash\":\"' || sha256('a' || s_suppkey) || '\",\"structural_similarity\":20,\"transformed_at\":\"2026-01-01T00:00:00.000Z\"}'")  # fmt: skip


def _wire(digest: str, moment: str) -> str:
    return (
        f"'{{\"archive_id\":\"' || archive_id || '\",\"categories\":[\"x\"]{digest},\"description\":\"\",\"ingredient_lines\":[\"1 cup flour\",\"0.5 cup water, warm (optional)\"],\"instruction_lines\":[\"Mix.\"],\"name\":\"' || s_name || "
        f"'\",\"normalization\":' || {_NORMALIZED} || ',\"nutrition\":null,\"review_status\":\"normalized-and-reviewed\",\"slug\":\"r-' || s_suppkey || '\",\"source\":{{\"name\":\"Shop\"{moment},\"url\":\"' || url || "
        f"'\"}},\"times\":{{\"cook_minutes\":10,\"inactive_minutes\":0,\"prep_minutes\":5}},\"yield\":{{\"quantity\":4,\"unit\":\"servings\"}}}}'"
    )


_FEED = f"""r AS (SELECT *, 'shop' || s_nationkey || '.example:' || substr(sha256({_FEED_URL}), 1, 24) AS archive_id, {_FEED_URL} AS url FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0),
h AS (SELECT *, sha256({_wire('', '')}) AS content_hash FROM r),
w AS (SELECT archive_id, url, content_hash, {_wire(chr(44) + '"content_hash":"' + "' || content_hash || '" + '"', ',"retrieved_at":"2026-01-01T00:00:00.000Z"')} AS body FROM h)"""


def _feed_recipes(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    line = lambda item, q, prep, opt: F.struct(F.lit(item).alias("item"), F.lit(q).alias("quantity"), F.lit("cup").alias("unit"), F.lit(prep).cast("string").alias("preparation"), F.lit(opt).alias("optional"))
    review = F.when(F.col("s_suppkey") % 7 != 0, F.lit(False))
    status = F.when(F.col("s_suppkey") % 5 != 0, F.lit("passed")).otherwise(F.lit("held"))
    normalization = F.struct(
        F.sha2(F.concat(F.lit("a"), key), 256).alias("source_text_hash"), F.sha2(F.concat(F.lit("b"), key), 256).alias("normalized_text_hash"), F.lit("m").alias("model"), F.lit("m").alias("model_version"),
        F.lit("1").alias("prompt_version"), F.lit("2026-01-01T00:00:00.000Z").alias("transformed_at"), F.lit(10).alias("semantic_similarity"), F.lit(20).alias("structural_similarity"),
        review.alias("requires_review"), status.alias("source_review_status"),
    )
    url = F.concat(F.lit("HTTPS://www.Shop"), F.col("s_nationkey").cast("string"), F.lit(".example/p/"), key, F.lit("#x"))
    none = F.lit(None)
    record = F.struct(
        F.concat(F.lit("r-"), key).alias("id"), F.col("s_name").alias("name"), none.cast("string").alias("description"), F.struct(F.lit(4.0).alias("quantity"), F.lit("servings").alias("unit")).alias("yield"),
        F.struct(F.lit(5).alias("prep_minutes"), F.lit(10).alias("cook_minutes"), none.cast("int").alias("inactive_minutes")).alias("times"),
        F.array(line("flour", "1", None, False), line("water", "0.5", "warm", True)).alias("ingredients"), F.array(F.struct(F.lit(1).alias("step"), F.lit("Mix.").alias("text"))).alias("instructions"),
        F.array(F.lit("x")).alias("tags"), none.cast("map<string, double>").alias("nutrition"), F.struct(F.lit("Shop").alias("name"), url.alias("url")).alias("source"), normalization.alias("normalization"),
        F.lit("2026-01-01").alias("updated_at"),
    )
    return _t(spark, sf_dir, "supplier").select(record.alias("record"))


@_query(f"WITH {_FEED} SELECT archive_id, url, content_hash, sha256(body) AS body_hash FROM w")
def feed_records(spark, sf_dir):
    rows = feed.feed_records(_feed_recipes(spark, sf_dir))
    return rows.select("archive_id", "url", F.get_json_object("body", "$.content_hash").alias("content_hash"), F.sha2("body", 256).alias("body_hash"))


@_query(f"""WITH {_FEED}, p AS (SELECT *, row_number() OVER (ORDER BY archive_id) AS i FROM w)
SELECT page, 'page-' || lpad(page::VARCHAR, 5, '0') || '.json' AS file, count(*)::BIGINT AS record_count, sha256('{{"page":' || page || ',"recipes":[' || string_agg(body, ',' ORDER BY i) || '],"release_id":"r1","schema_version":"1.1.0"}}' || chr(10)) AS sha256,
min(archive_id) AS archive_id_start, max(archive_id) AS archive_id_end FROM (SELECT *, ceil(i / 10.0)::BIGINT AS page FROM p) GROUP BY page""")
def feed_pages(spark, sf_dir):
    return feed.feed_pages(feed.feed_records(_feed_recipes(spark, sf_dir)), "r1", 10).drop("body")


@_query("SELECT * FROM " + _values(("again", "same bytes"), ("page-00099.json is not listed", "found"), ("page-00099.json release_id does not match manifest", "found")) + " AS v(problem, state)")
def feed_verify(spark, sf_dir):
    recipes, out = _feed_recipes(spark, sf_dir), stores.scratch(spark, "feed")
    first = feed.build_feed(recipes, out, "r1", "2026-01-01T00:00:00.000Z", 10)
    second = feed.build_feed(recipes.repartition(3), out, "r1", "2026-01-01T00:00:00.000Z", 10)
    stores.write_text(spark, f"{out}/pages/file=page-00099.json/part-0.txt", "{}\n")
    same = spark.createDataFrame([("again", "same bytes" if first == second else "other bytes")], "problem string, state string")
    return same.union(feed.feed_problems(spark, out).select("problem", F.lit("found")))


# imports

_MEALS = [
    {"id": "summer-salad", "name": "Summer Tomato Salad", "tags": ["Veggie", "Gluten-free"], "ingredients": [{"name": "Tomato", "amount": "2", "unit": "unit"}], "prepTime": "", "totalTime": "20 minutes"},
    {"id": "lentil-soup", "name": "Hearty Lentil Soup", "ingredients": [{"name": "Lentil", "amount": "1", "unit": "cup"}], "prepTime": "5 minutes", "totalTime": "1 hour 5 minutes"},
    {"id": "berry-drink", "name": "Strawberry Spritz", "ingredients": [{"name": "Strawberry", "amount": "1/2", "unit": "cup"}]},
    {"id": "banana-cake", "name": "Banana Cake", "ingredients": [{"name": "Banana", "amount": "2", "unit": "unit"}]},
    {"id": "vegan-conflict", "name": "Vegan Butter Bowl", "tags": ["Vegan"], "ingredients": [{"name": "Butter", "amount": "1", "unit": "tablespoon"}]},
    {"id": "gluten-conflict", "name": "Contradictory Flour Bowl", "tags": ["Gluten-free"], "ingredients": [{"name": "Wheat Flour", "amount": "1", "unit": "cups"}]},
    {"id": "odd-11111111", "name": "Same Title", "subName": "4 servings", "tags": ["Spicy"], "nutritionalValues": {"Calories": "100", "Fat": "900"}, "instructions": [],
     "ingredients": [{"name": "Kosher Salt", "amount": "", "unit": ""}, {"name": "Garlic Cloves", "amount": "unit", "unit": ""}, {"name": "Olive Oil* (optional)", "amount": "", "unit": ""}, {"name": "rice", "amount": "2", "unit": ""}]},
    {"id": "odd-22222222", "name": "Same Title", "subName": "2-4 portions", "tags": ["x"], "nutritionalValues": {"Calories": "90"}, "ingredients": [{"name": "Rice®", "amount": "1 1/2", "unit": "cups"}, {"name": "rice", "amount": "1", "unit": "cups"}]},
]
_KNOWN = [("tomato", "Tomato", ["summer", "fall"], []), ("lentil", "Lentil", ["year-round"], []), ("strawberry", "Strawberry", ["spring", "summer"], []), ("banana", "Banana", ["year-round"], []), ("butter", "Butter", ["year-round"], ["milk"]), ("garlic", "Garlic", ["year-round"], [])]


def _import(spark):
    filled = [{"subName": "", "totalTime": "30 minutes", "prepTime": "10 minutes", "difficulty": "Easy", "tags": [], "nutritionalValues": {}, "instructions": [{"order": 1, "text": "Cook until done."}], "url": f"https://x.example/{m['id']}"} | m for m in _MEALS]
    meals = _meals(spark, filled)
    known = spark.createDataFrame([(i, n, [], ["x"], s, None, a) for i, n, s, a in _KNOWN], "id string, name string, aliases array<string>, categories array<string>, seasons array<string>, default_unit string, allergens array<string>")
    return legacy.transformed(legacy.checked_meals(meals), known)


def _meals(spark, filled):
    lines = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in filled], "j string")
    return lines.select(F.from_json("j", legacy.MEALS).alias("r")).select("r.*")


@_query("SELECT * FROM " + _values(
    ("summer-salad", "summer-tomato-salad", "salads", "summer", 10, 10, "vegetarian,gluten-free,dairy-free,nut-free,egg-free", "", "salad,easy,needs-review", "2 servings", "", 1),
    ("lentil-soup", "hearty-lentil-soup", "soups", "fall,winter", 5, 60, "dairy-free,nut-free,egg-free", "", "soup,easy,needs-review", "2 servings", "", 1),
    ("berry-drink", "strawberry-spritz", "drinks", "spring,summer", 10, 20, "dairy-free,nut-free,egg-free", "", "drink,easy,needs-review", "2 servings", "", 1),
    ("banana-cake", "banana-cake", "desserts", "year-round", 10, 20, "dairy-free,nut-free,egg-free", "", "dessert,easy,needs-review", "2 servings", "", 1),
    ("vegan-conflict", "vegan-butter-bowl", "mains", "year-round", 10, 20, "vegetarian,nut-free,egg-free", "milk", "main,easy,needs-review", "2 servings", "", 1),
    ("gluten-conflict", "contradictory-flour-bowl", "mains", "year-round", 10, 20, "dairy-free,nut-free,egg-free", "wheat", "main,easy,needs-review", "2 servings", "", 1),
    ("odd-11111111", "same-title-11111111", "mains", "year-round", 10, 20, "dairy-free,nut-free,egg-free", "", "main,easy,spicy,needs-review", "4 servings", "calories=100", 1),
    ("odd-22222222", "same-title-22222222", "mains", "year-round", 10, 20, "dairy-free,nut-free,egg-free", "", "main,easy,x,needs-review", "4 servings", "calories=90", 1),
) + " AS v(source_id, recipe_id, folder, seasons, prep, cook, dietary, allergens, tags, yield_text, nutrition, n_steps)")
def legacy_import(spark, sf_dir):
    return shown_recipes(_import(spark))


def shown_recipes(imported):
    recipes, _, _ = imported
    nutrition = F.transform(F.array_sort(F.map_entries(F.coalesce("nutrition", F.create_map().cast("map<string, double>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string")))
    return recipes.select(
        "source_id", "recipe_id", "folder", F.array_join("seasons", ",").alias("seasons"), F.col("times.prep_minutes").cast("int").alias("prep"), F.col("times.cook_minutes").cast("int").alias("cook"),
        F.array_join("dietary", ",").alias("dietary"), F.array_join("allergens", ",").alias("allergens"), F.array_join("tags", ",").alias("tags"),
        F.concat_ws(" ", F.col("yield.quantity").cast("string"), "yield.unit").alias("yield_text"), F.array_join(nutrition, ",").alias("nutrition"), F.size("instructions").alias("n_steps"),
    )


@_query("SELECT * FROM " + _values(
    ("summer-salad", 0, "tomato", "Tomato", "2||", False), ("lentil-soup", 0, "lentil", "Lentil", "1|cup|", False), ("berry-drink", 0, "strawberry", "Strawberry", "1/2|cup|", False), ("banana-cake", 0, "banana", "Banana", "2||", False),
    ("vegan-conflict", 0, "butter", "Butter", "1|tablespoon|", False), ("gluten-conflict", 0, "wheat-flour", "Wheat Flour", "1|cup|", False), ("odd-11111111", 0, "kosher-salt", "Kosher Salt", "to taste||inferredMeasurements", False),
    ("odd-11111111", 1, "garlic", "Garlic Cloves", "||malformedMeasurements", False), ("odd-11111111", 2, "olive-oil", "Olive Oil", "||missingMeasurements", True), ("odd-11111111", 3, "rice", "rice", "2||missingUnits", False),
    ("odd-22222222", 0, "rice", "Rice", "1.5|cup|", False), ("odd-22222222", 1, "rice", "rice", "1|cup|", False),
) + " AS v(source_id, pos, ingredient_id, item, amount, optional)")
def legacy_lines(spark, sf_dir):
    return shown_lines(_import(spark))


def shown_lines(imported):
    recipes, _, audit = imported
    each = recipes.select("source_id", F.posexplode("ingredients").alias("pos", "i"))
    notes = audit.where("category IN ('inferredMeasurements', 'malformedMeasurements', 'missingMeasurements', 'missingUnits')").select(F.col("recipe_id").alias("source_id"), F.col("detail").alias("item"), "category")
    rows = each.select("source_id", "pos", "i.ingredient_id", "i.item", "i.quantity", "i.unit", F.coalesce("i.optional", F.lit(False)).alias("optional")).join(notes, ["source_id", "item"], "left")
    number = F.when(F.col("quantity.num") == F.floor("quantity.num"), F.floor("quantity.num").cast("string")).otherwise(F.col("quantity.num").cast("string"))
    parts = [F.coalesce(c, F.lit("")) for c in (F.coalesce(number, F.col("quantity.raw")), F.col("unit"), F.col("category"))]
    return rows.select("source_id", "pos", "ingredient_id", "item", F.concat_ws("|", *parts).alias("amount"), "optional")


@_query("SELECT * FROM " + _values(
    ("missingSourceTags", 3), ("missingSubtitles", 6), ("inferredPrepTime", 1), ("assumedYield", 7), ("missingNutrition", 6), ("dietaryConflicts", 2), ("malformedMeasurements", 1), ("missingMeasurements", 1), ("missingUnits", 1),
    ("inferredMeasurements", 1), ("nutritionOutliers", 1), ("duplicateTitles", 2),
) + " AS v(category, n)")
def legacy_audit(spark, sf_dir):
    return shown_audit(_import(spark))


def shown_audit(imported):
    _, _, audit = imported
    return legacy.audit_counts(audit).select("category", F.col("n").cast("int").alias("n"))


@_query("SELECT * FROM " + _values(
    ("wheat-flour", "Wheat Flour", "", "baking", "year-round", "cup", "wheat"), ("kosher-salt", "Kosher Salt", "", "spice", "year-round", None, ""), ("olive-oil", "Olive Oil", "", "oil", "year-round", None, ""),
    ("rice", "Rice", "rice", "grain", "year-round", "cup", ""),
) + " AS v(id, name, aliases, category, seasons, unit, allergens)")
def legacy_ingredients(spark, sf_dir):
    return shown_ingredients(_import(spark))


def shown_ingredients(imported):
    _, new, _ = imported
    return new.select(
        "id", "record.name", F.array_join("record.aliases", ";").alias("aliases"), F.get("record.categories", F.lit(0)).alias("category"), F.array_join("record.seasons", ",").alias("seasons"),
        F.col("record.default_unit").alias("unit"), F.array_join("record.allergens", ",").alias("allergens"),
    )


# materialization and promotion

_FOOD = "item: string, quantity: string, unit: string, preparation: string, optional: boolean"
_DRAFT = (
    "struct<name: string, subtitle: string, description: string, meal_type: string, cuisine: string, yield: struct<quantity: double, unit: string>, "
    f"times: struct<prep_minutes: int, cook_minutes: int, inactive_minutes: int>, ingredients: array<struct<{_FOOD}>>, instructions: array<struct<text: string, timer_minutes: int>>, tags: array<string>, "
    "seasons: array<string>, dietary: array<string>, allergens: array<string>, equipment: array<string>>"
)


def _drafted(**change) -> dict:
    return {
        "name": " Lemon Cake ", "subtitle": "", "description": "Good. ", "meal_type": "dessert", "cuisine": "", "yield": {"quantity": 4, "unit": " "}, "times": {"prep_minutes": 5, "cook_minutes": 10, "inactive_minutes": 0},
        "ingredients": [{"item": "Butter", "quantity": "2", "unit": "cup", "preparation": "", "optional": False}], "instructions": [{"text": " Mix. ", "timer_minutes": 0}, {"text": "Bake.", "timer_minutes": 30}],
        "tags": ["Quick!", "quick", ""], "seasons": [], "dietary": ["vegan", "dairy-free", "nut-free"], "allergens": ["eggs"], "equipment": [" oven ", "oven", ""],
    } | change


def _made(spark):
    facts = [{"item": "lemon juice", "quantity": "1/2", "unit": "", "preparation": "strained", "optional": True}]
    rows = _fixture(spark, f"key: string, source: struct<name: string, url: string>, draft: {_DRAFT}, ingredients: array<struct<{_FOOD}>>",
                    {"key": "a", "source": {"name": "S", "url": "u1"}, "draft": _drafted()}, {"key": "b", "source": {"name": "S", "url": "u2"}, "draft": _drafted(), "ingredients": facts},
                    {"key": "c", "source": {"name": "S", "url": "u3"}, "draft": _drafted(name="Old", dietary=[], allergens=[], ingredients=[], equipment=None)})
    known = spark.createDataFrame([("butter", "Butter", ["unsalted butter"]), ("lemon-juice", "Juice of lemon", ["Lemon Juice"])], "id string, name string, aliases array<string>")
    return materialize.materialized(rows, known, spark.createDataFrame([("old",)], "id string"), F.lit("2026-01-01"))


@_query("SELECT key, replace(replace(json, '#u2', substr(sha256('u2'), 1, 8)), '#u3', substr(sha256('u3'), 1, 8)) AS json FROM " + _values(
    ("a", '{"schema_version":"1.0.0","id":"lemon-cake","name":"Lemon Cake","description":"Good.","meal_type":"dessert","yield":{"quantity":4.0,"unit":"servings"},"times":{"prep_minutes":5,"cook_minutes":10},'
     '"ingredients":[{"ingredient_id":"butter","item":"Butter","quantity":{"num":2.0,"raw":"2"},"unit":"cup"}],"instructions":[{"step":1,"text":"Mix."},{"step":2,"text":"Bake.","timer_minutes":30}],"tags":["quick"],'
     '"dietary":["nut-free"],"allergens":["eggs","milk"],"equipment":["oven"],"source":{"name":"S","url":"u1","adapted":true},"created_at":"2026-01-01","updated_at":"2026-01-01"}'),
    ("b", '{"schema_version":"1.0.0","id":"lemon-cake-#u2","name":"Lemon Cake","description":"Good.","meal_type":"dessert","yield":{"quantity":4.0,"unit":"servings"},"times":{"prep_minutes":5,"cook_minutes":10},'
     '"ingredients":[{"ingredient_id":"lemon-juice","item":"lemon juice","quantity":{"raw":"1/2"},"preparation":"strained","optional":true}],"instructions":[{"step":1,"text":"Mix."},{"step":2,"text":"Bake.","timer_minutes":30}],"tags":["quick"],'
     '"dietary":["dairy-free","nut-free"],"allergens":["eggs"],"equipment":["oven"],"source":{"name":"S","url":"u2","adapted":true},"created_at":"2026-01-01","updated_at":"2026-01-01"}'),
    ("c", '{"schema_version":"1.0.0","id":"old-#u3","name":"Old","description":"Good.","meal_type":"dessert","yield":{"quantity":4.0,"unit":"servings"},"times":{"prep_minutes":5,"cook_minutes":10},'
     '"ingredients":[],"instructions":[{"step":1,"text":"Mix."},{"step":2,"text":"Bake.","timer_minutes":30}],"tags":["quick"],"source":{"name":"S","url":"u3","adapted":true},"created_at":"2026-01-01","updated_at":"2026-01-01"}'),
) + " AS v(key, json)")
def materialized(spark, sf_dir):
    return _made(spark).select("key", F.to_json("record").alias("json"))


@_query("""SELECT key, sha256('{"description":"d","instructions":["x"]}') AS source_text_hash, sha256('{"subtitle":"","description":"Good.","instructions":["Mix.","Bake."]}') AS normalized_text_hash, 'm1' AS model, 'p2' AS prompt_version, 7 AS semantic, FALSE AS requires_review
FROM (VALUES ('a'), ('b'), ('c')) AS v(key)""")
def provenance(spark, sf_dir):
    extracted = F.struct(F.lit("d").alias("description"), F.array(F.lit("x")).alias("instruction_lines"))
    return shown_provenance(_made(spark), extracted, F.lit(7))


def shown_provenance(made, extracted, semantic):
    review = F.struct(semantic.alias("semantic_similarity"), F.lit(9).alias("structural_similarity"))
    rows = made.select("key", materialize.provenance(extracted, F.col("record"), review, " m1 ", "p2", F.lit("t")).alias("p"))
    return rows.select("key", "p.source_text_hash", "p.normalized_text_hash", "p.model", "p.prompt_version", F.col("p.semantic_similarity").alias("semantic"), "p.requires_review")


@_query("SELECT doc_id, 'written ' || length(coalesce(text, '')) AS draft FROM documents WHERE doc_id % 10 = 3")
def authored_drafts(spark, sf_dir):
    def author(batches):
        for pdf in batches:
            yield pdf.assign(draft=["written " + str(len(t or "")) for t in pdf["text"]])[["doc_id", "draft"]]

    rows = _t(spark, sf_dir, "documents").where("doc_id % 10 = 3").select("doc_id", "text")
    return materialize.authored(rows, author, "doc_id long, draft string")


_EXTRACT = "struct<description: string, instruction_lines: array<string>>"
_NORMAL = "struct<source_text_hash: string, normalized_text_hash: string, model: string, prompt_version: string, transformed_at: string, requires_review: boolean, source_review_status: string>"
_STAGED = (
    "struct<id: string, subtitle: string, description: string, meal_type: string, instructions: array<struct<text: string>>, ingredients: array<struct<ingredient_id: string>>, "
    f"source: struct<name: string, url: string, adapted: boolean>, normalization: {_NORMAL}>"
)


def _digest(**parts) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def _staged_record(name: str, host: str = "a.example", steps: tuple = ("Mix.",), food: str = "salt", **change) -> dict:
    n = {"source_text_hash": _digest(description="d", instructions=["x"]), "normalized_text_hash": _digest(subtitle="", description="", instructions=list(steps)), "model": "m", "prompt_version": "1",
         "transformed_at": "t", "requires_review": False, "source_review_status": "passed"}
    record = {"id": name, "meal_type": "main", "instructions": [{"text": s} for s in steps], "ingredients": [{"ingredient_id": food}], "source": {"name": "S", "url": f"https://{host}/{name}", "adapted": True}}
    return record | {"normalization": n | change.pop("normalization", {})} | change


def _policy(spark):
    return spark.createDataFrame([("a.example", "approved", "cc0", "e", "2026-01-01", "", 2, 0), ("b.example", "draft-only", "cc0", "e", "2026-01-01", "", 0, 0)], "host string, status string, basis string, evidence string, reviewed_at string, expires_at string, max_per_run int, max_catalog int")


@_query("SELECT * FROM " + _values(
    ("ok-1", "promoted", ""), ("ok-2", "promoted", ""), ("ok-3", "publication-hold", "a.example exceeds its 2-recipe per-run cap"), ("drafty", "publication-hold", "b.example is marked draft-only"),
    ("nowhere", "publication-hold", "no publication-rights record exists for c.example"), ("changed", "conflict", "source URL is finalized with different normalized content"), ("taken", "conflict", "recipe id is already finalized for another source"),
    ("hungry", "conflict", "missing staged ingredient 'saffron'"), ("odd-food", "conflict", "staged ingredient 'oil' conflicts with finalized data"),
) + " AS v(recipe_id, status, reasons)")
def staging_promote(spark, sf_dir):
    made = _staged_record
    rows = [("1", made("hungry", food="saffron")), ("2", made("odd-food", food="oil")), ("3", made("ok-1")), ("4", made("drafty", "b.example")), ("5", made("nowhere", "c.example")), ("6", made("changed", steps=("New.",))),
            ("7", made("same")), ("8", made("taken")), ("9", made("ok-2")), ("99", made("ok-3"))]
    staged = _fixture(spark, f"file: string, record: {_STAGED}", *[{"file": f, "record": r} for f, r in rows])
    final = _fixture(spark, f"record: {_STAGED}", {"record": made("changed")}, {"record": made("same")}, {"record": made("taken", "z.example")})
    food = lambda id_, notes: {"record": {"id": id_, "notes": notes}}
    staged_foods = _fixture(spark, "record: struct<id: string, notes: string>", food("salt", "x"), food("oil", "new"))
    final_foods = _fixture(spark, "record: struct<id: string, notes: string>", food("oil", "old"))
    got = staging.promoted(staged, final, staged_foods, final_foods, _policy(spark), F.lit("2026-01-02").cast("timestamp"), 30, 100.0, 10**6)
    return got.select("recipe_id", "status", F.array_join("reasons", "; ").alias("reasons"))


@_query("SELECT * FROM " + _values(
    ("mains/gone.json: file is missing",), ("mains/two.json: duplicate recipe id 'one'",), ("mains/two.json: recipe id does not match manifest",), ("mains/two.json: source URL does not match manifest",),
    ("mains/two.json: duplicate source URL 'https://a.example/one'",), ("mains/bad.json: normalized text hash does not match",), ("mains/bad.json: normalization must have passed content review",),
    ("mains/bad.json: unknown ingredient_id 'saffron'",), ("mains/bad.json: source.adapted must be true",), ("mains/extra.json: recipe is not listed in manifest",), ("_ingredients/oil.json: conflicts with finalized ingredient 'oil'",),
    ("_ingredients/new.json: ingredient is not listed in manifest",), ("recipes-staging/manifest.json: ingredient totals do not match files",), ("recipes-staging/manifest.json: source_counts do not match recipes",),
    ("recipes-staging/manifest.json: publication_status must remain rights-pending",), ("mains/bad.json: normalization.model does not match manifest",),
) + " AS v(error)")
def staging_audit(spark, sf_dir):
    one = _staged_record("one")
    bad = _staged_record("bad", food="saffron", source={"name": "S", "url": "https://a.example/bad", "adapted": False}, normalization={"normalized_text_hash": "0", "requires_review": None})
    records = _fixture(spark, f"file: string, record: {_STAGED}", {"file": "mains/one.json", "record": one}, {"file": "mains/two.json", "record": one}, {"file": "mains/bad.json", "record": bad}, {"file": "mains/extra.json", "record": _staged_record("extra")})
    entry = lambda r, file, **change: {"file": file, "recipe_id": r["id"], "source_name": "S", "source_url": r["source"]["url"]} | {k: r["normalization"][k] for k in staging.NAMED} | change
    two = entry(one, "mains/two.json", recipe_id="two", source_url="https://a.example/two")
    listed = _fixture(spark, "file: string, recipe_id: string, source_name: string, source_url: string, " + ", ".join(f"{k}: string" for k in staging.NAMED),
                      entry(one, "mains/one.json"), two, entry(bad, "mains/bad.json", model="other"), entry(one, "mains/gone.json"))
    kind = "file: string, record: struct<id: string, notes: string>"
    foods = _fixture(spark, kind, {"file": "_ingredients/salt.json", "record": {"id": "salt"}}, {"file": "_ingredients/oil.json", "record": {"id": "oil", "notes": "a"}}, {"file": "_ingredients/new.json", "record": {"id": "new"}})
    listed_foods = spark.createDataFrame([("_ingredients/salt.json", "salt"), ("_ingredients/oil.json", "oil")], "file string, ingredient_id string")
    final_foods = _fixture(spark, "record: struct<id: string, notes: string>", {"record": {"id": "oil", "notes": "b"}})
    counts = spark.createDataFrame([("a.example", 1)], "host string, n long")
    totals = {"publication_status": "ready", "total_recipes": 4, "total_ingredients": 2}
    return staging.collection_errors(listed, records, listed_foods, foods, final_foods, totals, counts)


def _stage(extracted: dict, steps: tuple = ("Mix.",), **change) -> dict:
    draft = _drafted(name="Rice Bowl", description="", instructions=[{"text": s, "timer_minutes": 0} for s in steps], ingredients=[])
    n = {"source_text_hash": _digest(description=extracted["description"], instructions=extracted["instruction_lines"]), "normalized_text_hash": _digest(subtitle="", description="", instructions=list(steps)), "prompt_version": "1",
         "requires_review": False, "source_review_status": "passed"}
    return {
        "schema_version": "1.0.0", "candidate_file": "scraping/output/s/x.json", "pipeline_version": "1", "model": "m", "staged_at": "t", "content_reasons": [],
        "record": {"instructions": [{"text": s} for s in steps], "normalization": n | change.pop("normalization", {})}, "facts": {"ingredients": [{"item": "rice", "quantity": "1", "unit": "cup", "preparation": "", "optional": False}]},
        "generated": {"recipe": draft},
    } | change


_STAGE = (
    "struct<schema_version: string, candidate_file: string, pipeline_version: string, model: string, staged_at: string, content_reasons: array<string>, "
    f"record: struct<subtitle: string, description: string, instructions: array<struct<text: string>>, normalization: {_NORMAL}>, facts: struct<ingredients: array<struct<{_FOOD}>>>, generated: struct<recipe: {_DRAFT}>>"
)


def _outcome(spark):
    e = {"description": "d", "instruction_lines": ["x"]}
    row = lambda n, url, stage, extracted=e: {"file": f"{n}.json", "source": {"name": "S", "url": url}, "extracted": extracted, "stage": stage}
    rows = [
        row(1, "https://a.example/1", _stage(e)), row(2, "https://a.example/2", _stage(e, content_reasons=["too close"])), row(3, "https://a.example/old", _stage(e)), row(4, "https://b.example/4", _stage(e)),
        row(5, "https://a.example/5", _stage(e, ("Stir.",))), row(6, "https://a.example/6", _stage(e)), row(7, "https://a.example/7", _stage(e, schema_version="2"), {"description": "other", "instruction_lines": []}),
    ]
    stages = _fixture(spark, f"file: string, source: struct<name: string, url: string>, extracted: {_EXTRACT}, stage: {_STAGE}", *rows)
    final = _fixture(spark, f"record: {_STAGED}", {"record": _staged_record("old")})
    known = spark.createDataFrame([("salt", "Salt", [])], "id string, name string, aliases array<string>")
    return staging.staged_outcome(stages, final, known, _policy(spark), F.lit("2026-01-02").cast("timestamp"), 30, 100.0, 10**6, F.lit("2026-01-02"))


@_query("SELECT * FROM " + _values(
    ("1.json", "promoted", ""), ("2.json", "needs-review", "too close"), ("3.json", "already-finalized", ""), ("4.json", "publication-hold", "b.example is marked draft-only"), ("5.json", "promoted", ""),
    ("6.json", "publication-hold", "a.example exceeds its 2-recipe per-run cap"), ("7.json", "needs-review", "unsupported staged normalization schema version; source expressive text changed after staging"),
) + " AS v(file, status, reasons)")
def staged_outcome(spark, sf_dir):
    out, _, _ = _outcome(spark)
    return out.select("file", "status", F.array_join("reasons", "; ").alias("reasons"))


@_query("""SELECT * FROM (VALUES ('1.json', 'rice-bowl', 'rice'), ('5.json', 'rice-bowl-' || substr(sha256('https://a.example/5'), 1, 8), 'rice')) AS v(file, id, ingredient_id)""")
def staged_records(spark, sf_dir):
    _, records, _ = _outcome(spark)
    return records.select("file", "record.id", F.get("record.ingredients", F.lit(0))["ingredient_id"].alias("ingredient_id"))


@_query("""SELECT 'mains/' || id || '.json' AS file, id AS recipe_id, 1 AS n_foods FROM (VALUES ('one'), ('two')) AS v(id)""")
def staging_export(spark, sf_dir):
    records = _fixture(spark, f"record: {_STAGED}", {"record": _staged_record("one")}, {"record": _staged_record("two")})
    foods = _fixture(spark, "id: string, record: struct<id: string>", {"id": "salt", "record": {"id": "salt"}})
    listed, listed_foods, hosts, totals = staging.staging_export(records, foods, "2026-01-01T00:00:00.000Z")
    errors = staging.collection_errors(listed, listed.select("file").join(records.select(F.concat(F.lit("mains/"), "record.id", F.lit(".json")).alias("file"), "record"), "file"), listed_foods,
                                       foods.select(F.concat(F.lit("_ingredients/"), "id", F.lit(".json")).alias("file"), "record"), foods.select("record").limit(0), totals, hosts)
    return listed.select("file", "recipe_id").crossJoin(errors.agg((F.count(F.lit(1)) + totals["total_ingredients"]).cast("int").alias("n_foods")))


def _cached(x):
    p = F.from_json(x, f"struct<s: {_STAGE}, e: {_EXTRACT}>")
    return text.bound(p, lambda q: F.array_join(staging.cache_issues(q["s"], q["e"], "1", "m"), "; "))


_E = {"description": "d", "instruction_lines": ["x"]}
cases(
    "stage_reuse", _cached,
    ({"s": _stage(_E), "e": _E}, ""), ({"s": _stage(_E, pipeline_version="0", model="x"), "e": _E}, "staged pipeline version changed; staged model changed"),
    ({"s": _stage(_E), "e": {"description": "new", "instruction_lines": ["x"]}}, "source expressive text changed after staging"),
    ({"s": _stage(_E, normalization={"prompt_version": "0", "normalized_text_hash": "x"}), "e": _E}, "staged prompt version changed; staged normalized expressive text hash does not match"),
)


@_query("SELECT * FROM " + _values(("one", "mains/one.json", ""), ("two", "mains/two.json", "input is not a supported review candidate; a finalized recipe exists already")) + " AS v(id, destination, issues)")
def manual_promotion(spark, sf_dir):
    candidate = f"candidate: struct<candidate_version: string, review_status: string, source: struct<url: string>, extracted: {_EXTRACT}>"
    record = "record: struct<id: string, meal_type: string, subtitle: string, description: string, instructions: array<struct<text: string>>, notes: array<string>, tags: array<string>, source: struct<url: string, adapted: boolean>>"
    good = {"candidate_version": "1.0.0", "review_status": "needs-review-and-original-wording", "source": {"url": "u"}, "extracted": _E}
    final = lambda n: {"id": n, "meal_type": "main", "instructions": [{"text": "Mix."}], "tags": ["x"], "source": {"url": "u", "adapted": True}}
    rows = _fixture(spark, f"{candidate}, {record}", {"candidate": good, "record": final("one")}, {"candidate": good | {"review_status": "x"}, "record": final("two")})
    got = staging.manual_promotion(rows, spark.createDataFrame([("two",)], "id string"), attested=True)
    return got.select("id", "destination", F.array_join("issues", "; ").alias("issues"))


# crawling


@_query("SELECT 'https://s.example/recipe/' || x AS url, i::BIGINT AS seq, 4 AS accepted, 1 AS skipped, 4 AS visited, 1 AS blocked, 1 AS failed FROM (VALUES (0, 1), (2, 2), (3, 3), (4, 4)) AS v(x, i)")
def crawl_discover(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    link = lambda *p: F.concat(F.lit('<a href="/'), *p, F.lit('">x</a>'))
    body = F.concat(link(F.lit("recipe/"), key, F.lit("#top")), link(F.lit("recipe/"), (F.col("n_nationkey") + 1).cast("string")), link(F.lit("about")), link(F.lit("list/"), (F.col("n_nationkey") + 1).cast("string")))
    pages = _t(spark, sf_dir, "nation").select(F.concat(F.lit("https://s.example/list/"), key).alias("url"), body.alias("text"), F.lit("text/html").alias("content_type"))
    seeds = spark.createDataFrame([(0, "https://s.example/list/0"), (1, "https://s.example/private"), (2, "https://s.example/list/gone")], "pos long, url string")
    site = {"base_url": "https://s.example/", "allow": ["/recipe/"], "follow": ["/list/"]}
    found, counts = crawl.discover(seeds, pages, site, 4, lambda u: ~F.contains(u, F.lit("private")), lambda u: ~F.endswith(u, F.lit("/1")), urls.canonical)
    visited = counts["fetched"]
    return found.select(urls.canonical(F.col("url")).alias("url"), "seq", *[F.lit(n).alias(c) for c, n in (("accepted", counts["accepted"]), ("skipped", counts["skipped"]), ("visited", visited), ("blocked", counts["blocked"]), ("failed", counts["failed"]))])


# personal documents


def _personal(x):
    """A document after some edits, in short."""
    p = F.from_json(x, "struct<op: string, doc: string, plan: string, recipes: string, json: string>")

    def shown(d):
        items = F.transform(F.flatten(F.transform(d["meal_plans"], lambda m: m["items"])), lambda i: F.concat_ws(":", i["id"], i["day"], i["position"].cast("string")))
        ids = F.transform(d["imported_recipes"], lambda r: F.concat_ws("=", F.get_json_object(r, "$.id"), F.get_json_object(r, "$.name")))
        filters = d["preferences"]["filters"]
        return F.when(d.isNotNull(), F.concat_ws("|", F.array_join(items, ","), F.array_join(ids, ","), filters["meal_type"], filters["season"]))

    def edited(q, d):
        add = lambda e, n, day: personal.added(e, F.lit(n), F.lit("r"), F.lit(day), F.lit(4))
        return (
            F.when(q["op"] == "add", add(add(d, "i1", "Monday"), "i2", "Monday")).when(q["op"] == "remove", personal.removed(d, F.lit("x1"))).when(q["op"] == "clear", personal.cleared(d))
            .when(q["op"] == "filter", personal.with_filters(d, season=F.lit("fall"), meal_type=F.lit(None).cast("string"))).when(q["op"] == "import", personal.imported(d, q["json"])).otherwise(d)
        )

    # each is bound, so that a row is read once, edited once and shown once
    read = lambda q: personal.read_document(q["doc"], q["plan"], q["recipes"])
    return text.bound(p, lambda q: text.bound(text.bound(read(q), lambda d: edited(q, d)), shown))


def _stored(*items: dict, imports: tuple = ()) -> str:
    plan = {"id": "w", "name": "W", "items": list(items)}
    return json.dumps({"schema_version": "1.0.0", "preferences": {"dietary": [], "filters": {"meal_type": "all", "season": "all", "dietary": "all"}}, "meal_plans": [plan, {"id": "o", "name": "O", "items": [{"id": "x1", "day": "Friday", "position": 0}]}], "cookbooks": [], "imported_recipes": list(imports)})


def _own(id_: str, name: str, **change) -> dict:
    return {"id": id_, "name": name, "meal_type": "main", "yield": {"quantity": 1}, "times": {"prep_minutes": 1}, "ingredients": [], "instructions": [], "tags": []} | change


_ITEM = {"id": "x1", "recipe_id": "r", "day": "Monday", "position": 0}
cases(
    "personal_document", _personal,
    ({"op": "read"}, "||all|all"), ({"op": "read", "doc": _stored(_ITEM)}, "x1:Monday:0,x1:Friday:0||all|all"), ({"op": "read", "doc": '{"schema_version":"0"}'}, "||all|all"), ({"op": "read", "doc": "{broken"}, "||all|all"),
    ({"op": "read", "plan": '{"Tuesday":["a","b"],"Monday":["c"]}', "recipes": json.dumps([_own("c", "C")])}, "monday-0-c:Monday:0,tuesday-0-a:Tuesday:0,tuesday-1-b:Tuesday:1|c=C|all|all"),
    ({"op": "add", "doc": _stored(_ITEM)}, "x1:Monday:0,i1:Monday:1,i2:Monday:2,x1:Friday:0||all|all"), ({"op": "remove", "doc": _stored(_ITEM)}, "x1:Friday:0||all|all"), ({"op": "clear", "doc": _stored(_ITEM)}, "x1:Friday:0||all|all"),
    ({"op": "filter"}, "||all|fall"), ({"op": "import", "doc": _stored(imports=(_own("a", "A"), _own("b", "B"))), "json": json.dumps([_own("c", "C"), _own("a", "A2")])}, "x1:Friday:0|a=A2,b=B,c=C|all|all"),
    ({"op": "import", "json": json.dumps(_own("c", "C"))}, "|c=C|all|all"), ({"op": "import", "json": json.dumps({"recipes": [_own("c", "C"), _own("d", "D")]})}, "|c=C,d=D|all|all"),
    ({"op": "import", "json": json.dumps([_own("c", "", tags=None)])}, None), ({"op": "import", "json": _stored(_ITEM)}, "x1:Monday:0,x1:Friday:0||all|all"),
)
cases(
    "record_shape", personal.is_recipe,
    (_own("a", "A"), "true"), (_own("", "A"), "false"), (_own("a", "A", tags="x"), "false"), (_own("a", "A", times=None), "false"), ("[]", "false"), ("{broken", "false"), (None, "false"),
)


@_query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'mine' ELSE n_name END AS name FROM nation UNION ALL SELECT 99, 'new'")
def library_union(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    own = nation.where("n_nationkey % 4 = 0").select("n_nationkey", F.lit("mine").alias("name")).union(spark.createDataFrame([(99, "new")], "n_nationkey int, name string"))
    return personal.library(nation, own, "n_nationkey").select("n_nationkey", "name")


# sources, sinks and rolls


@_query("""SELECT kind, n::BIGINT AS n, keys::BIGINT AS keys FROM (SELECT 'json' AS kind, count(*) AS n, sum(n_nationkey) AS keys FROM nation UNION ALL SELECT 'array', count(*), sum(n_nationkey) FROM nation
UNION ALL SELECT 'ledger', count(*), sum(n_nationkey) FROM nation UNION ALL SELECT 'bundle', count(*), sum(n_nationkey) FROM nation UNION ALL SELECT 'rejected', 1, 0
UNION ALL SELECT 'view', count(*), sum(n_nationkey) FROM nation UNION ALL SELECT 'catalog', 1, count(*) FROM nation UNION ALL SELECT 'interchange', count(*) + 2, 0 FROM nation)""")
def source_round_trip(spark, sf_dir):
    nation, at = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), stores.scratch(spark, "sources")
    lines = nation.select(F.to_json(F.struct("*")).alias("value"))
    lines.write.text(f"{at}/lines")
    nation.repartition(3).write.json(f"{at}/json")
    stores.write_text(spark, f"{at}/json/odd/broken.json", "{broken")
    stores.write_text(spark, f"{at}/ledger.jsonl", "\n".join(["", "{broken", *[r["value"] for r in lines.orderBy("value").collect()]]) + "\n")
    listed = lines.agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("value")), ","), F.lit("]")).alias("value")).first()["value"]
    stores.write_text(spark, f"{at}/array.json", listed)
    for i, row in enumerate(lines.orderBy("value").collect()):
        if i < 25:
            stores.write_text(spark, f"{at}/one/{i:02}.json", row["value"])
    stores.write_text(spark, f"{at}/bad/broken.json", "{broken")
    schema = nation.schema
    good, _ = sources.bundle(spark, f"{at}/one", schema)
    _, bad = sources.bundle(spark, f"{at}/bad", schema)
    rows = sources.json_files(spark, f"{at}/one", schema)
    ledger = sources.ledger(spark, f"{at}/ledger.jsonl", "n_nationkey int, n_name string")
    array = sources.json_array(spark, f"{at}/array.json", schema, "n_nationkey")
    sources.register({"granary_nations": nation})
    view = spark.sql("SELECT * FROM granary_nations")
    whole = sources.catalog_json(rows, nation.withColumn("path", F.col("n_name")).limit(0), "t").select(F.size(F.from_json(F.get_json_object("json", "$.recipes"), "array<string>")).cast("long").alias("keys"))
    bundle = sources.interchange(nation, bad, "p")
    count = lambda kind, df, keys=None: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), (F.sum("n_nationkey") if keys is None else keys).cast("long").alias("keys"))
    out = count("json", rows)
    for kind, df, keys in (("array", array, None), ("ledger", ledger, None), ("bundle", good, None), ("rejected", bad, F.lit(0)), ("view", view, None), ("catalog", whole, F.max("keys")), ("interchange", bundle, F.lit(0))):
        out = out.union(count(kind, df, keys))
    return out


@_query(f"SELECT page_id, {_SLUG.format('split_part(url, chr(47), 4)')} || '-' || substr(sha256(url), 1, 12) || '.json' AS file FROM pages WHERE split_part(url, '/', 4) <> ''")
def store_names(spark, sf_dir):
    part = F.split_part("url", F.lit("/"), F.lit(4))
    return _t(spark, sf_dir, "pages").where(part != "").select("page_id", sources.store_name(part, F.col("url")).alias("file"))


@_query("""SELECT * FROM (VALUES ('https://a.example/1', 't1', 'f1'), ('https://a.example/2', 't1', 'f1'), ('https://b.example/x?a=1', 't2', 'f2')) AS v(url, scraped_at, output)""")
def ledger_append(spark, sf_dir):
    fetched = spark.createDataFrame([("https://a.example/1#x", "https://a.example/2", "t1", ["f1"]), ("https://b.example/x?utm_a=1&a=1", "https://b.example/x?a=1", "t2", ["f2"]), ("https://c.example/", "https://c.example/", "t3", [])], "requested string, final string, scraped_at string, output array<string>")
    known = spark.createDataFrame([("https://c.example/",)], "url string")
    return sources.ledger_rows(fetched, known).select("url", "scraped_at", F.array_join("output", ",").alias("output"))


@_query("""SELECT * FROM (VALUES ('https://a.example/1', 't', 'p1', TRUE)) AS v(url, scraped_at, output, recovered)""")
def ledger_recover(spark, sf_dir):
    stored = spark.createDataFrame([(("https://a.example/1#x", "t"), "p1"), (("https://b.example/", "t"), "p2"), ((None, None), "p3")], "source struct<url: string, retrieved_at: string>, path string")
    got = sources.recovered(stored, spark.createDataFrame([("https://b.example/#y",)], "url string"))
    return got.select("url", "scraped_at", F.array_join("output", ",").alias("output"), "recovered")


@_query("SELECT * FROM " + _values(("by id", "Site One", "https://one.example"), ("by address", "www.two.example", "https://www.two.example")) + " AS v(how, name, base_url)")
def site_config(spark, sf_dir):
    sites = _fixture(spark, "id: string, name: string, base_url: string, seeds: array<string>", {"id": "one", "name": "Site One", "base_url": "https://one.example"})
    found = [("by id", sources.site_of(sites, "one")), ("by address", sources.site_of(sites, "https://www.two.example/r/1?x=2"))]
    return spark.createDataFrame([(how, s["name"], s["base_url"]) for how, s in found], "how string, name string, base_url string")


@_query("SELECT * FROM " + _values(("first", 8, 4, 6), ("again", 8, 4, 6)) + " AS v(turn, recipes, ingredients, subtitles)")
def review_bundle(spark, sf_dir):
    return shown_bundle(spark, _import(spark))


def shown_bundle(spark, imported):
    # made once, written twice
    recipes, new, audit = (stores.kept(df, name) for df, name in zip(imported, ("recipes", "ingredients", "audit"), strict=True))
    out = stores.scratch(spark, "review")
    made = [("first", sources.write_review_bundle(recipes, new, audit, out, {"hemisphere": "northern"})), ("again", sources.write_review_bundle(recipes, new, audit, out, {"hemisphere": "northern"}, clean=True))]
    return spark.createDataFrame([(t, m["recipe_count"], m["ingredient_candidate_count"], m["audit_counts"]["missingSubtitles"]) for t, m in made], "turn string, recipes int, ingredients int, subtitles int")


@_query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (1, 3)")
def selected_ids(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").withColumn("key", F.col("s_suppkey").cast("string"))
    found, _ = legacy.selected(rows, "key", ["1", "3", "none"])
    return found.select("s_suppkey")


@_query("SELECT 'none' AS key")
def unknown_ids(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").withColumn("key", F.col("s_suppkey").cast("string"))
    return legacy.selected(rows, "key", ["1", "3", "none"])[1]


@_query("SELECT n_nationkey, n_name, CASE n_nationkey % 3 WHEN 0 THEN 'left' ELSE 'right' END AS side FROM nation WHERE n_nationkey % 3 <> 2")
def collections_equal(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return validate.differences(nation.where("n_nationkey % 3 <> 1"), nation.where("n_nationkey % 3 <> 0"))


@_query("SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 0 THEN 'low' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality <> 0 AND toxic = 1 THEN 'mixed' END], lambda x: x IS NOT NULL), ',') AS errors FROM labels")
def error_union(spark, sf_dir):
    low, toxic = F.when(F.col("quality") == 0, F.array(F.lit("low"))), F.when(F.col("toxic") == 1, F.array(F.lit("toxic")))
    both = F.when((F.col("quality") != 0) & (F.col("toxic") == 1), F.array(F.lit("toxic"), F.lit("mixed")))
    return _t(spark, sf_dir, "labels").select("doc_id", F.array_join(validate.all_errors(low, toxic, both), ",").alias("errors"))


@_query("""SELECT 'status' AS kind, event_type AS name, count(*)::BIGINT AS n FROM events GROUP BY event_type UNION ALL SELECT * FROM (SELECT 'word', word, count(*)::BIGINT AS n FROM
(SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS word FROM benchmark) WHERE length(word) >= 4 GROUP BY word ORDER BY n DESC, word LIMIT 10)""")
def run_analytics(spark, sf_dir):
    words = similarity.word_counts(_t(spark, sf_dir, "benchmark"), "text", 4)
    return validate.run_analytics(_t(spark, sf_dir, "events"), "event_type", words, 10)


@_query("SELECT conv_id, sum(n)::BIGINT AS total, max(n)::INT AS longest FROM (SELECT conv_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS n FROM conversations) GROUP BY conv_id")
def sums_of_steps(spark, sf_dir):
    n = F.size(text.tokens(F.col("text")))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(n).alias("total"), F.max(n).alias("longest"))


@_query("""SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0""")
def feed_eligible(spark, sf_dir):
    rows = _feed_recipes(spark, sf_dir).where(feed.is_eligible(F.col("record")))
    return rows.select(F.regexp_extract("record.id", "[0-9]+$", 0).cast("long").alias("s_suppkey"))


@_query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_upsert(spark, sf_dir):
    from granary.streaming import ledgers

    at = stores.scratch(spark, "upsert")
    events = _t(spark, sf_dir, "events").select("event_id", "user_id")
    for half in (0, 1):
        events.where(f"event_id % 2 = {half}").write.mode("append").parquet(f"{at}/in")
        ledgers.upsert_latest(spark.readStream.schema(events.schema).parquet(f"{at}/in"), "user_id", "event_id", f"{at}/out", f"{at}/ck")
    return ledgers.latest(spark, f"{at}/out").select("event_id", "user_id")
