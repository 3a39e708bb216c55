"""Queries over the driver's tables, one for each operator family, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import numbers, rules, text, urls
from granary.operators import gates, increments, publish, resolve, search, similarity, validate

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
#: Queries over chosen inputs in whose place queries over tables stand; the tests run them too.
INPUTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
STOPWORDS = "a an and are as at be by for from in into is it of on or that the their then this to until with".split()
_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
#: Tokens after accents are removed.
_FOLDED = "regexp_extract_all(strip_accents(lower(coalesce({0}, ''))), '[a-z0-9]+')"
_GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - {n} + 2, 1)), lambda i: array_to_string({0}[i:i + {n} - 1], ' ')))"


def _query(sql: str | None = None):
    def add(f):
        if f.__name__ in _FOUND:
            INPUTS[f.__name__] = _FOUND[f.__name__]
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A narrow table's rows dealt to as many tasks as a shuffle has: by its size in bytes, a task or two would do all of a rule's work."""
    return _t(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


# text


@_query(f"""WITH a AS (SELECT doc_id, unnest({_GRAMS.format("w", n=8)}) AS g FROM (SELECT doc_id, {_FOLDED.format("text")} AS w FROM documents)),
b AS (SELECT item_id, g, min(pos) AS pos FROM (SELECT item_id, i AS pos, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, {_FOLDED.format("text")} AS w FROM benchmark), unnest(range(1, greatest(len(w) - 6, 1))) AS u(i)) GROUP BY item_id, g)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, arg_min(b.g, pos) AS first_phrase FROM a JOIN b ON a.g = b.g GROUP BY doc_id, item_id""")
def copied_phrase(spark, sf_dir):
    return similarity.copied_phrases(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@_query(f"SELECT doc_id, len({_TOKENS.format('text')})::BIGINT AS n_tokens FROM documents")
def tokenize_count(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@_query(f"SELECT doc_id, len({_GRAMS.format('w', n=3)})::BIGINT AS n_trigrams FROM (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents)")
def ngram_count(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(text.ngrams(text.tokens(F.col("text")), 3)).cast("long").alias("n_trigrams"))


@_query(f"""SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS word FROM documents)
WHERE length(word) >= 4 AND word NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)}) GROUP BY word ORDER BY n DESC, word LIMIT 25""")
def word_frequency_top25(spark, sf_dir):
    return similarity.top(similarity.word_counts(_t(spark, sf_dir, "documents"), "text", 4, STOPWORDS), "n", "word")


_TURNS = "(SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS reply FROM conversations)"


def _turns(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))).where("reply IS NOT NULL")


@_query(f"""SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS word, {_TOKENS.format('reply')} AS f FROM {_TURNS} WHERE reply IS NOT NULL)
WHERE length(word) >= 4 AND NOT list_contains(f, word) GROUP BY word""")
def source_only_words(spark, sf_dir):
    return similarity.removed_words(_turns(spark, sf_dir), "text", "reply")


@_query(f"""SELECT conv_id, turn, CASE WHEN a > 0 THEN floor((b / a - 1) * 1000 + 0.5) / 10 ELSE 0.0 END::DOUBLE AS change_percent
FROM (SELECT conv_id, turn, len({_TOKENS.format('text')})::DOUBLE AS a, len({_TOKENS.format('reply')})::DOUBLE AS b FROM {_TURNS} WHERE reply IS NOT NULL)""")
def prose_change_pct(spark, sf_dir):
    size = lambda c: F.size(text.tokens(F.col(c))).cast("double")
    return _turns(spark, sf_dir).select("conv_id", "turn", similarity.change_percent(size("text"), size("reply")).alias("change_percent"))


_SIM = f"""WITH t AS (SELECT conv_id, turn, {_FOLDED.format('text')} AS x, {_FOLDED.format('reply')} AS y FROM {_TURNS} WHERE reply IS NOT NULL),
g AS (SELECT conv_id, turn, {_GRAMS.format('x', n=3)} AS a, {_GRAMS.format('y', n=3)} AS b FROM t),
s AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE floor(len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) * 1000 + 0.5) / 10 END::DOUBLE AS likeness FROM g)"""


@_query(_SIM + " SELECT conv_id, turn, likeness FROM s")
def jaccard_pairs(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", similarity.trigram_percent(F.col("text"), F.col("reply")).alias("likeness"))


@_query(_SIM + """ SELECT conv_id, turn, CASE WHEN likeness >= 50 THEN 'hold' WHEN likeness >= 20 THEN 'model' ELSE 'pass' END AS mode,
CASE WHEN likeness >= 50 THEN 'source/final prose trigram overlap is ' || CASE WHEN likeness = floor(likeness) THEN floor(likeness)::BIGINT::VARCHAR ELSE likeness::VARCHAR END || '%'
WHEN likeness >= 20 THEN 'deterministic similarity is borderline and requires model review' ELSE '' END AS reasons FROM s""")
def review_disposition(spark, sf_dir):
    likeness = similarity.trigram_percent(F.col("text"), F.col("reply"))
    made = rules.disposition(likeness, F.lit(0.0), F.array().cast("array<string>"), F.lit(False))
    return _turns(spark, sf_dir).select("conv_id", "turn", made.alias("d")).select("conv_id", "turn", "d.mode", F.array_join("d.reasons", "; ").alias("reasons"))


@_query(f"""WITH t AS (SELECT conv_id, role, {_GRAMS.format('w', n=3)} AS g FROM (SELECT conv_id, role, {_FOLDED.format('text')} AS w FROM conversations)),
p AS (SELECT a.conv_id, CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0.0 ELSE floor(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(a.g || b.g)) * 1000 + 0.5) / 10 END AS s
FROM t AS a JOIN t AS b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant')
SELECT c.conv_id, coalesce(max(s), 0.0)::DOUBLE AS max_step FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN p ON p.conv_id = c.conv_id GROUP BY c.conv_id""")
def max_step_similarity(spark, sf_dir):
    steps = lambda role: F.collect_list(F.when(F.col("role") == role, F.coalesce("text", F.lit(""))))
    grouped = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(steps("user").alias("a"), steps("assistant").alias("b"))
    return grouped.select("conv_id", similarity.max_step_percent(F.col("a"), F.col("b")).alias("max_step"))


@_query(f"""WITH b AS (SELECT DISTINCT n_name AS term, lower(n_name) AS f FROM nation UNION SELECT DISTINCT word, word FROM (VALUES ('worthless'), ('the of'), ('by and')) AS v(word)),
d AS (SELECT doc_id, ' ' || array_to_string({_FOLDED.format('text')}, ' ') || ' ' AS t FROM documents)
SELECT DISTINCT doc_id, term FROM d JOIN b ON contains(t, ' ' || f || ' ')""")
def brand_terms(spark, sf_dir):
    more = F.explode(F.array(F.lit("worthless"), F.lit("the of"), F.lit("by and"))).alias("term")
    names = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("term"))
    return similarity.terms_in(_t(spark, sf_dir, "documents"), "doc_id", "text", names.union(names.limit(1).select(more)))


# addresses


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"


_CANONICAL = rf"""SELECT page_id, CASE WHEN q = '' THEN p ELSE p || '?' || q END AS canonical_url FROM (SELECT page_id, regexp_extract(b, '^[^?]*', 0) AS p,
array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:utm_[^=]*|fbclid|gclid)(?:=|$)')),
lambda x, i: {{'k': regexp_extract(x, '^[^=]*', 0), 'i': i, 'p': x}})), lambda s: s.p), '&') AS q FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages))"""


@_query(_CANONICAL)
def url_canonical(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical_url"))


@_query(rf"""SELECT page_id, CASE WHEN starts_with(r, '/') THEN s || '://' || h || r ELSE s || '://' || h || '/' || r END AS publish_url FROM (SELECT page_id, {_HOST} AS h,
lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://[^/?]*(.*)$', 1) AS r FROM pages)""")
def url_publish_form(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", urls.publishable(F.col("url")).alias("publish_url"))


@_query(f"SELECT page_id, {_HOST} AS host FROM pages")
def hostname(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@_query(f"SELECT host, count(*)::BIGINT AS n FROM (SELECT {_HOST} AS host FROM pages) GROUP BY host")
def host_counts(spark, sf_dir):
    return _t(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT page_id, {_HOST} || ':' || substr(sha256(url), 1, 24) AS archive_id FROM pages")
def archive_id(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", urls.archive_id(F.col("url")).alias("archive_id"))


@_query(r"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY first_at) - 1)::BIGINT AS pos, link FROM (SELECT page_id, link, min(i) AS first_at
FROM (SELECT page_id, i, regexp_extract(lower(url), '^[a-z]+://[^/?#]+', 0) || replace(replace(url_encode(hs[i]), '%2F', '/'), '%2C', ',') AS link
FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*"([^"]+)"', 1) AS hs FROM pages), unnest(range(1, len(hs) + 1)) AS u(i)) GROUP BY page_id, link)""")
def link_extract(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(urls.links("html", "url")).alias("pos", "link")).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


@_query("""SELECT p_partkey, p_name AS name, '{"@type":"Recipe","name":"' || p_name || '","size":' || p_size || '}' AS node FROM part""")
def jsonld_extract(spark, sf_dir):
    body = F.to_json(F.struct(F.lit("Recipe").alias("@type"), F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    html = F.concat(F.lit('<p>x</p><script type="application/ld+json">{"@graph":['), body, F.lit(']}</script><script type="application/ld+json">broken</script>'))
    nodes = _t(spark, sf_dir, "part").select("p_partkey", F.explode(text.json_ld(html)).alias("found")).withColumn("node", text.canonical_json("found"))
    return nodes.select("p_partkey", F.get_json_object("node", "$.name").alias("name"), "node")


@_query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# search and plans


@_query("SELECT l_orderkey, l_linenumber, floor(l_quantity * 1.5 * 100 + 0.5) / 100 AS scaled FROM lineitem")
def scale_quantity(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.scaled(F.col("l_quantity"), F.lit(1.5)).alias("scaled"))


@_query("""SELECT user_id, event_id, first_at FROM (SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id) AS first_at,
row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def union_last_wins(spark, sf_dir):
    return search.last_wins(_t(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "first_at")


@_query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_wins(spark, sf_dir):
    return search.first_wins(_t(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


@_query("""SELECT o_orderkey, c_name, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS position
FROM orders JOIN customer ON o_custkey = c_custkey""")
def plan_join(spark, sf_dir):
    joined = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return search.next_position(joined, "o_custkey", "o_orderkey").select("o_orderkey", "c_name", "position")


# quantities and dates


@_query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INT AS age_days FROM orders")
def date_age(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.lit("2000-01-01").cast("date"), numbers.strict_date(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("age_days"))


# rules


@_query("""SELECT doc_id, quality, toxic, array_to_string(list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low quality' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM labels""")
def review_reasons(spark, sf_dir):
    found = rules.all_matches([(F.col("toxic") == 1, "toxic"), (F.col("quality") == 0, "low quality")])
    return _t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.array_join(found, "; ").alias("reasons"))


# entity resolution


_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@_query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def fk_anti(spark, sf_dir):
    rich = _t(spark, sf_dir, "customer").where("c_acctbal > 0")
    return resolve.dangling(_t(spark, sf_dir, "orders"), "o_custkey", rich, "c_custkey").select("o_orderkey")


@_query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


# gates


@_query("""SELECT doc_id, source, toxic = 0 AND sum((toxic = 0)::INT) OVER (PARTITION BY source ORDER BY doc_id) <= 5 AS accepted FROM documents JOIN labels USING (doc_id)""")
def host_quota(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "toxic")
    return gates.within_quota(rows, "source", "doc_id", F.col("toxic") == 0, 5).select("doc_id", "source", "accepted")


@_query("SELECT event_type, count(*)::BIGINT AS n, floor(count(*)::DOUBLE / sum(count(*)) OVER () * 1000 + 0.5) / 10 AS share FROM events GROUP BY event_type")
def status_rollup(spark, sf_dir):
    counted = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("event_type", "n", text.percent(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))


@_query("SELECT source, lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source, lang")
def site_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


# integrity


@_query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def dup_ids(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_orderkey", "l_linenumber"))
    return validate.repeats(rows, "l_partkey", "at").select("l_orderkey", "l_linenumber", "l_partkey")


@_query("SELECT conv_id, count(*)::BIGINT AS n, min(turn) AS low, max(turn) AS high FROM conversations GROUP BY conv_id HAVING min(turn) <> 1 OR max(turn) <> count(*) OR count(DISTINCT turn) <> count(*)")
def step_contiguity(spark, sf_dir):
    return validate.step_gaps(_t(spark, sf_dir, "conversations"), "conv_id", "turn")


@_query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unlisted' ELSE 'different' END AS issue FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def manifest_full_outer(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    present = orders.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return validate.manifest_issues(orders.where("o_orderkey % 3 <> 0"), present, "o_orderkey", "o_orderstatus")


@_query("""SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 8 = 0""")
def changed_only(spark, sf_dir):
    staged = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    final = staged.where("doc_id % 4 = 0").withColumn("digest", F.when(F.col("doc_id") % 8 == 0, F.lit("old")).otherwise(F.col("digest")))
    return validate.changed(staged, final, "doc_id", "digest")


@_query("""SELECT 'low balance' AS category, c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'no orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def audit_long(spark, sf_dir):
    customer = _t(spark, sf_dir, "customer")
    low = customer.where("c_acctbal < 0").select(F.lit("low balance").alias("category"), F.col("c_custkey").alias("id"))
    idle = resolve.dangling(customer, "c_custkey", _t(spark, sf_dir, "orders"), "o_custkey")
    return low.union(idle.select(F.lit("no orders"), "c_custkey"))


# publishing


@_query("SELECT doc_id, sha256('{\"description\":\"' || doc_id || '\",\"instructions\":[\"' || source || '\"]}') AS text_hash FROM documents")
def text_hash(spark, sf_dir):
    body = F.to_json(F.struct(F.col("doc_id").cast("string").alias("description"), F.array("source").alias("instructions")))
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(body, 256).alias("text_hash"))


_PAGED = "SELECT *, row_number() OVER (ORDER BY k) AS position FROM (SELECT lpad(doc_id::VARCHAR, 9, '0') AS k, source FROM documents WHERE source IS NOT NULL)"


@_query(f"""SELECT ceil(position / 250.0)::BIGINT AS page, min(k) AS first_id, max(k) AS last_id, count(*)::BIGINT AS n,
sha256(string_agg(k || ' ' || source, chr(10) ORDER BY position) || chr(10)) AS page_hash FROM ({_PAGED}) GROUP BY 1""")
def pages_manifest(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("k"), "source")
    return publish.manifest(publish.paged(rows, "k", 250), "k", F.concat_ws(" ", "k", "source"))


@_query("SELECT name, row_number() OVER (ORDER BY name) AS position FROM (SELECT DISTINCT n_name AS name FROM nation UNION SELECT chr(57344) UNION SELECT chr(65536) UNION SELECT 'A')")
def codepoint_sort(spark, sf_dir):
    names = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    more = names.limit(1).select(F.explode(F.array(F.lit("\ue000"), F.lit("\U00010000"), F.lit("A"))).alias("name"))
    return publish.paged(names.union(more).distinct(), "name", 10).select("name", "position")


# increments


@_query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND event_id % 3 = 0)")
def ledger_new_urls(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    lowest = events.agg(F.min("event_type").alias("event_type"))
    return increments.unseen(events, "user_id", events.where("event_id % 3 = 0").join(lowest, "event_type")).select("event_id", "user_id")


@_query("""WITH RECURSIVE l AS (SELECT c_nationkey % 25 AS src, (c_nationkey + 3) % 25 AS dst FROM customer UNION SELECT c_nationkey % 25, (c_nationkey * 2) % 25 FROM customer),
r AS (SELECT 0 AS node, 0 AS level UNION SELECT dst, level + 1 FROM r JOIN l ON src = node WHERE level < 4) SELECT node, min(level) AS level FROM r GROUP BY node""")
def frontier_levels(spark, sf_dir):
    customer = _t(spark, sf_dir, "customer")
    key = F.col("c_nationkey")
    links = customer.select((key % 25).alias("src"), F.explode(F.array((key + 3) % 25, key * 2 % 25)).alias("dst")).distinct()
    return increments.frontier(links.where("src = 0").select(F.col("src").alias("node")), links, 4)


# ingredients and queues


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') OR o_orderkey % 3 = 0")
def queue_resume(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "O", F.lit("failed")).when(F.col("o_orderstatus") == "P", F.lit("needs-review")).otherwise(F.lit("ready"))
    records = orders.select("o_orderkey", status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("2")).otherwise(F.lit("3")).alias("version"))
    return increments.remaining(orders, "o_orderkey", records, "3", retry_held=True).select("o_orderkey")


@_query("SELECT n_nationkey, 'https://x.example/' || n_name || '?p=' || i AS seed FROM nation, unnest(range(1, greatest(n_regionkey, 1) + 1)) AS u(i)")
def seed_pages(spark, sf_dir):
    first = F.concat(F.lit("https://x.example/"), F.col("n_name"), F.lit("?p=1"))
    sites = _t(spark, sf_dir, "nation").select("n_nationkey", F.array(first).alias("seeds"), F.concat(F.lit("https://x.example/"), F.col("n_name"), F.lit("?p={page}")).alias("template"), F.lit(0).alias("low"), F.col("n_regionkey").cast("int").alias("high"))
    return increments.seed_pages(sites, "n_nationkey", "seeds", "template", "low", "high")


@_query("SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 OR (c_custkey % 9 = 0 AND c_mktsegment IS NOT NULL)")
def deep_conflict(spark, sf_dir):
    staged = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    segment = F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    balance = F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    return validate.conflicts(staged, staged.select("c_custkey", segment.alias("c_mktsegment"), balance.alias("c_acctbal")), "c_custkey")


@_query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'version changed' END, CASE WHEN doc_id % 3 = 0 THEN 'source changed' END], lambda x: x IS NOT NULL), '; ') AS issues FROM documents""")
def stage_freshness(spark, sf_dir):
    text_ = F.coalesce("text", F.lit(""))
    kept = F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat(text_, F.lit("!"))).otherwise(text_), 256)
    version = F.when(F.col("doc_id") % 5 == 0, F.lit("2")).otherwise(F.lit("3"))
    issues = validate.staleness(version, "3", kept, F.col("text"), F.sha2("lang", 256), F.col("lang"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(issues, "; ").alias("issues"))


# queries of further modules join the same list
from granary.plans import golden, records  # noqa: E402, F401
from granary.plans import extended, imports, promotion, tables  # noqa: E402, F401  the last three stand in place of some queries of the first


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
