"""Ledgers, queues and frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unseen(rows: DataFrame, key: str, ledger: DataFrame) -> DataFrame:
    return rows.join(ledger.select(key).distinct(), key, "left_anti")


def frontier(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(node, level): breadth-first levels from seeds (node) along links (src, dst), to a depth. Each level is
    checkpointed to the shared folder where the session names one, and else kept, so that none is walked twice. A walk
    that stops after a number of addresses is crawl.discover()."""
    seen = seeds.select("node").distinct().withColumn("level", F.lit(0))
    edge = seen
    for level in range(1, depth + 1):
        reached = edge.join(links, edge["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        edge = reached.join(seen, "node", "left_anti").withColumn("level", F.lit(level))
        edge = edge.checkpoint() if edge.sparkSession.conf.get("spark.checkpoint.dir", None) else edge.cache()
        seen = seen.unionByName(edge)
    return seen


def remaining(queue: DataFrame, key: str, records: DataFrame, version: str, retry_held: bool = False) -> DataFrame:
    """Queue rows whose key has no completed record (key, status, version); records of another version don't count."""
    open_again = ["failed", *(["needs-review", "publication-hold"] if retry_held else [])]
    done = records.where(F.col("version").eqNullSafe(F.lit(version)) & ~F.coalesce("status", F.lit("")).isin(open_again))
    return unseen(queue, key, done)


def seed_pages(sites: DataFrame, site: str, seeds: str, template: str, start: str, end: str) -> DataFrame:
    """(site, seed): each site's distinct seeds and, where it has a template, one address a page from start (1 at
    least) to end (start at least)."""
    first = F.greatest(F.lit(1), F.coalesce(start, F.lit(1)))
    pages = F.transform(F.sequence(first, F.greatest(first, F.coalesce(end, first))), lambda i: F.replace(F.col(template), F.lit("{page}"), i.cast("string")))
    known = F.filter(F.coalesce(seeds, F.array().cast("array<string>")), lambda s: s != "")
    more = F.when(F.coalesce(template, F.lit("")) != "", pages).otherwise(F.array().cast("array<string>"))
    return sites.select(site, F.explode(F.array_distinct(F.concat(known, more))).alias("seed"))


def crawl_state(found: Column, wanted: Column, problems: Column, drained: Column) -> Column:
    """exhausted or incomplete where sources ended with fewer new rows than wanted, else more."""
    ended = F.coalesce(drained & (found < wanted), F.lit(False))
    return F.when(ended & (F.coalesce(problems, F.lit(0)) == 0), F.lit("exhausted")).when(ended, F.lit("incomplete")).otherwise(F.lit("more"))
