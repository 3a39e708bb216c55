"""A bounded crawl over pages that are stored already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import urls
from granary.operators.publish import paged


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage where the session names a shared folder; a local session keeps it in memory."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.cache()


def discover(
    seeds: DataFrame, pages: DataFrame, site: dict, most: int, allowed: Callable[[Column], Column] = lambda u: F.lit(True),
    accept: Callable[[Column], Column] = lambda u: F.lit(True), key: Callable[[Column], Column] = lambda u: u,
) -> tuple[DataFrame, dict]:
    """(found addresses with their place, counts) of a first-in-first-out walk from seeds (pos, url) over pages (url,
    text, content_type, null text: it could not be read).

    site has base_url and may have allow, block, follow, sitemap_hosts and sitemap_allow. Every page is visited once;
    its links are taken in order: site maps and pages to follow join the queue, wanted addresses are taken once by
    their key and returned if accepted, and the walk ends when ``most`` are. allowed, accept and key are functions of
    a column. Levels of the queue are walked as a whole; what the limit would not have reached is cut off by place.
    """
    base, array = F.lit(site["base_url"]), lambda name: F.array(*map(F.lit, site.get(name) or ())).cast("array<string>")
    spark = seeds.sparkSession
    queue = seeds.select(F.col("pos").cast("long").alias("seq"), "url")
    visited, taken, found = (spark.createDataFrame([], f"{c} string") for c in ("url", "key", "url"))
    found = found.withColumn("seq", F.lit(0).cast("long")).limit(0)
    counts = dict.fromkeys(("visited", "blocked", "failed", "fetched", "candidates", "skipped", "accepted"), 0)
    ended = False
    while True:
        first = queue.groupBy("url").agg(F.min("seq").alias("seq")).join(visited, "url", "left_anti")
        level = first.join(pages.select("url", "text", "content_type"), "url", "left").withColumn("ok", allowed(F.col("url")))
        links = level.where("ok AND text IS NOT NULL").select("seq", F.col("url").alias("page"), "content_type", F.posexplode(urls.links("text", "url")).alias("pos", "link"))
        link = F.col("link")
        kind = (
            F.when(urls.is_sitemap(link, F.col("content_type")), F.when(urls.in_sitemap(link, base, array("sitemap_hosts"), array("sitemap_allow")), F.lit("queue")))
            .when(urls.listed(link, base, array("allow"), array("block")), F.lit("wanted"))
            .when(urls.followable(link, base, array("follow"), array("block")), F.lit("queue"))
        )
        links = links.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("key", F.when(F.col("kind") == "wanted", key(link)))
        level, links = _kept(level), _kept(links)
        if level.isEmpty():
            ended = True
            break
        place = F.struct("seq", "pos")
        wanted = links.where("kind = 'wanted'").groupBy("key").agg(F.min(place).alias("place"), F.min_by("link", place).alias("url")).join(taken, "key", "left_anti")
        wanted = _kept(wanted.withColumn("good", accept(F.col("url"))))
        left = most - counts["accepted"]
        # places among all, so that the last address that the limit leaves room for is one row, and no task has them all
        good = paged(wanted.where("good").withColumn("_order", F.struct("place")), "_order", 1).where(F.col("position") <= left)
        last = good.agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("place")).first()
        if last["n"] >= left:
            at = F.struct(F.lit(last["place"]["seq"]).alias("seq"), F.lit(last["place"]["pos"]).alias("pos"))
            wanted, level = wanted.where(F.col("place") <= at), level.where(F.col("seq") <= last["place"]["seq"])
        seen = level.agg(F.count(F.lit(1)), F.count_if(~F.col("ok")), F.count_if(F.col("ok") & F.col("text").isNull()), F.count_if(F.col("ok") & F.col("text").isNotNull())).first()
        got = wanted.agg(F.count(F.lit(1)), F.count_if(~F.col("good")), F.count_if("good")).first()
        for name, n in zip(("visited", "blocked", "failed", "fetched", "candidates", "skipped", "accepted"), (*seen, *got), strict=True):
            counts[name] += n
        found = found.unionByName(good.select("url", (F.col("position") + F.lit(counts["accepted"] - got[2])).alias("seq")))
        if last["n"] >= left:
            break
        visited, taken = _kept(visited.union(level.select("url"))), _kept(taken.union(wanted.select("key")))
        ahead = links.where("kind = 'queue'").join(visited, F.col("link") == visited["url"], "left_anti").groupBy(F.col("link").alias("url")).agg(F.min(place).alias("_order"))
        queue = _kept(paged(ahead, "_order", 1).select(F.col("position").alias("seq"), "url"))
    return found, counts | {"reached_limit": counts["accepted"] >= most, "drained": ended and counts["accepted"] < most}


def status_message(site: Column, state: Column, found: Column, wanted: Column, problems: Column) -> Column:
    """What increments.crawl_state() says, in words."""
    none = F.concat(F.lit("ALERT: "), site, F.lit(" has no new recipe URLs. All configured sitemap and pagination sources were exhausted."))
    last = F.concat(
        F.lit("ALERT: "), site, F.lit(" reached the end of its configured sitemap and pagination sources. No additional URLs were found beyond this final batch ("), found.cast("string"), F.lit(" URL(s)).")
    )
    unsure = F.concat(
        F.lit("ALERT: "), site, F.lit(" found fewer than "), wanted.cast("string"), F.lit(" new recipe URLs, but "), problems.cast("string"),
        F.lit(" discovery page(s) failed or were blocked, so exhaustion could not be confirmed."),
    )
    more = F.concat(site, F.lit(" found a full batch; more recipe URLs may remain."))
    return F.when((state == "exhausted") & (found == 0), none).when(state == "exhausted", last).when(state == "incomplete", unsure).otherwise(more)
