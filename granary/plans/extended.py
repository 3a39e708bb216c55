"""Operators that the survey names as extensions: joins on time, event time, ranked search, mergeable sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import minting, publish, ranges, ranking, rollups, search, substring
from granary.plans.catalog import _query, _t
from granary.sources.stores import kept, scratch
from granary.streaming import events as streams

# joins on time


@_query("""WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL)
SELECT event_id, coalesce(o_orderkey, -1) AS o_orderkey, o_totalprice FROM events ASOF LEFT JOIN o ON o_custkey = user_id AND o_orderdate <= ts""")
def asof_order(spark, sf_dir):
    """Each event with the latest earlier order of its user, -1 if there is none."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), "o_orderkey", "o_totalprice")
    found = ranges.as_of(_t(spark, sf_dir, "events").select("event_id", "user_id", "ts"), orders, "user_id", "ts", "o_orderkey")
    return found.select("event_id", F.coalesce("match.o_orderkey", F.lit(-1)).alias("o_orderkey"), "match.o_totalprice")


@_query("""SELECT a.event_id, coalesce(b.event_id, -1) AS earlier_id, b.value AS earlier_value
FROM (SELECT * FROM events WHERE event_type <> 'click') AS a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts) AS b
ON a.user_id = b.user_id AND b.ts <= a.ts""")
def asof_click(spark, sf_dir):
    """Each other event with its user's latest click before it, -1 if there is none."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = ranges.as_of(events.where("event_type <> 'click'"), events.where("event_type = 'click'"), "user_id", "ts", "event_id")
    return found.select("event_id", F.coalesce("match.event_id", F.lit(-1)).alias("earlier_id"), F.col("match.value").alias("earlier_value"))


@_query("""SELECT a.event_id, count(*)::BIGINT AS n_before, min(b.event_id) AS first_id FROM events AS a JOIN events AS b ON a.user_id = b.user_id AND b.event_type = 'click'
AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts WHERE a.event_type = 'purchase' GROUP BY a.event_id""")
def interval_pairs(spark, sf_dir):
    """A purchase's clicks of the six hours before it."""
    events = _t(spark, sf_dir, "events")
    pairs = ranges.within(events.where("event_type = 'purchase'"), events.where("event_type = 'click'"), "user_id", "ts", 6 * 3600)
    return pairs.groupBy(F.col("l.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("n_before"), F.min("r.event_id").alias("first_id"))


@_query("""SELECT a.event_id, count(*)::BIGINT AS n_inside FROM events AS a JOIN events AS b ON a.user_id = b.user_id
AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) AND epoch_us(a.ts) + floor(a.value * 60000000)::BIGINT WHERE a.event_type = 'error' GROUP BY a.event_id""")
def range_points(spark, sf_dir):
    """An error lasts as many minutes as its value: how many events of its user fall into it."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts)").alias("at"), F.floor(F.col("value") * 60000000).cast("long").alias("lasts"))
    spans = events.where("event_type = 'error'").select("event_id", "user_id", F.col("at").alias("start"), (F.col("at") + F.col("lasts")).alias("end"))
    pairs = ranges.containing(events.select("event_id", "user_id", "at"), spans, "user_id", "at", "start", "end")
    return pairs.groupBy(F.col("r.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("n_inside"))


# event time


@_query("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN ts - before < INTERVAL 2 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)),
s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*)::BIGINT AS n FROM g GROUP BY user_id, run)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime("end", '%Y-%m-%d %H:%M:%S.%f') AS "end", n FROM s WHERE epoch_us("end") <= (SELECT epoch_ms(max(ts)) * 1000 - 600000000 FROM events)""")
def event_sessions(spark, sf_dir):
    """Sessions of users with gaps of two hours, given when the watermark of ten minutes has passed them."""
    found = streams.available(streams.sessions(streams.stream_of(spark, f"{sf_dir}/events.parquet", "ts"), "user_id", "ts", "2 hours", "10 minutes"), "sessions")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return found.select("user_id", shown("start"), shown("end"), "n")


@_query("""SELECT a.event_id, b.event_id AS click_id FROM events AS a JOIN events AS b ON a.user_id = b.user_id AND b.event_type = 'click' AND a.event_type = 'purchase'
AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts""")
def stream_interval_join(spark, sf_dir):
    """Purchases with their user's clicks of the hour before, joined as two streams."""
    stream = lambda kind: streams.stream_of(spark, f"{sf_dir}/events.parquet", "ts").where(F.col("event_type") == kind)
    pairs = streams.pairs_within(stream("purchase"), stream("click"), "user_id", "ts", "1 HOUR", "30 days")
    return streams.available(pairs.select(F.col("l.event_id").alias("event_id"), F.col("r.event_id").alias("click_id")), "pairs")


# ranked search


@_query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS average FROM d),
tf AS (SELECT doc_id, len(ws) AS size, word, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS word FROM d) GROUP BY ALL),
w AS (SELECT word, ln(1 + ((SELECT n FROM s) - count(*) + 0.5) / (count(*) + 0.5)) AS weight FROM tf GROUP BY word),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS word FROM benchmark),
r AS (SELECT item_id, doc_id, sum(floor(weight * (tf::DOUBLE * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / average))) * 1000000))::BIGINT AS score FROM q JOIN w USING (word) JOIN tf USING (word), s GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10""")
def ranked_search(spark, sf_dir):
    """The ten documents that rank first for each benchmark passage."""
    found = ranking.index(_t(spark, sf_dir, "documents"), "doc_id", "text")
    results, _ = ranking.search(found, _t(spark, sf_dir, "benchmark"), "item_id", "text")
    return results.select(F.col("query").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


# sketches


@_query("""WITH e AS (SELECT strftime(ts, '%Y-%m') AS month, * FROM events)
SELECT month, event_type, count(*)::BIGINT AS n, round(sum(value), 2)::DOUBLE AS total, count(DISTINCT user_id)::BIGINT AS n_users, TRUE AS users_close, TRUE AS median_close FROM e GROUP BY ROLLUP (month, event_type)""")
def event_rollup(spark, sf_dir):
    """Exact numbers of a rollup beside those of merged daily sketches, and whether they agree within the sketches' errors."""
    events = _t(spark, sf_dir, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    days = kept(rollups.daily(events, "ts", ["month", "event_type"], "user_id", "value"), "days")
    got = rollups.merged(days, ["month", "event_type"])
    below = F.count_if(F.col("value") < F.col("median")) / F.count(F.lit(1))
    none = lambda c: F.coalesce(F.col(c), F.lit("*"))
    exact = events.rollup("month", "event_type").agg(F.count_distinct("user_id").alias("n_users"))
    both = got.withColumn("_m", none("month")).withColumn("_e", none("event_type")).join(exact.select(none("month").alias("_m"), none("event_type").alias("_e"), "n_users"), ["_m", "_e"])
    # the rank of the sketch's median among all values of its group
    ranks = events.select(F.explode(F.array(F.struct("month", "event_type"), F.struct("month", F.lit("*").alias("event_type")), F.struct(F.lit("*").alias("month"), F.lit("*").alias("event_type")))).alias("g"), "value")
    ranks = ranks.select(F.col("g.month").alias("_m"), F.col("g.event_type").alias("_e"), "value").join(both.select("_m", "_e", "median"), ["_m", "_e"]).groupBy("_m", "_e").agg(below.alias("below"))
    close = lambda c: F.abs(F.col(c) - F.col("n_users")) <= F.greatest(F.lit(1.0), F.col("n_users") * 0.06)
    rows = both.join(ranks, ["_m", "_e"])
    return rows.select(
        "month", "event_type", "n", F.round(F.col("total").cast("double"), 2).alias("total"), "n_users", (close("users") & close("users_theta")).alias("users_close"),
        (F.abs(F.col("below") - 0.5) <= 0.05).alias("median_close"),
    )


# substrings and ids


@_query("""SELECT needle, page_id FROM pages, (VALUES ('nav><ul'), ('THERE'), ('ße'), ('an'), ('zzqq'), ('%')) AS v(needle) WHERE contains(lower(html), lower(needle))""")
def indexed_substring(spark, sf_dir):
    """Pages that hold a needle in any case, by posting lists of trigrams; needles of less than three characters are looked for in all."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "html")
    index = substring.index(pages, "page_id", "html")
    needles = ("nav><ul", "THERE", "ße", "an", "zzqq", "%")
    found = [substring.holding(pages, index, "page_id", "html", n).select(F.lit(n).alias("needle"), "page_id") for n in needles]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


@_query("""SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS id FROM part""")
def minted_across_batches(spark, sf_dir):
    """Ids of part names that come in two batches of a stream: a name of both has one id."""
    at = scratch(spark, "names")
    part = _t(spark, sf_dir, "part").withColumn("half", F.pmod("p_partkey", F.lit(2)))
    part.select(F.col("p_name").alias("name"), "half").repartition(1).write.partitionBy("half").parquet(f"{at}/in")
    stream = spark.readStream.schema("name string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{at}/in")
    minting.mint_available(stream, "name", f"{at}/ids", f"{at}/state")
    return minting.minted(spark, f"{at}/ids").select("key", "id")


@_query("""SELECT p_partkey, row_number() OVER (ORDER BY p_size % 3, p_name, p_partkey) AS position FROM part""")
def utf16_sort(spark, sf_dir):
    """Places of names in the order of UTF-16 code units, after a letter, a character beyond U+FFFF or a ligature below it."""
    first = F.element_at(F.array(*map(F.lit, ("z", "\U0001f600", "\ufb01"))), (F.col("p_size") % 3 + 1).cast("int"))
    named = _t(spark, sf_dir, "part").select("p_partkey", search.utf16_key(F.concat(first, "p_name")).alias("name"))
    return publish.paged(named.withColumn("_key", F.struct("name", "p_partkey")), "_key", 1).select("p_partkey", "position")
