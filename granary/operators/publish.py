"""Deterministic paged exports with digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.stores import kept


def paged(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with position (from 1) and page, in code point order of a unique column.

    The rows are dealt by ranges, sorted and written once, each with its part and its place there, so that what counts
    the parts and what numbers the rows see the same ranges. A position is the place and the sum of the counts of the
    parts before; there is a count a part, and no window over everything.
    """
    at, part, before = "_at", F.shiftright("_at", 33), Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn(at, F.monotonically_increasing_id())
    ranged = kept(ranged, "ranged")
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_part", part).join(F.broadcast(counts), "_part")
    position = F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("position", position).withColumn("page", F.ceil(F.col("position") / size).cast("long")).drop("_part", at, "_before")


def manifest(pages: DataFrame, key: str, body: Column) -> DataFrame:
    """page, first and last key, rows and the digest of the page's lines with a line feed after each; a page has ``size`` rows at most."""
    lines = F.sort_array(F.collect_list(F.struct("position", body.alias("body"))))
    grouped = pages.groupBy("page").agg(F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.count(F.lit(1)).alias("n"), lines.alias("lines"))
    text = F.concat(F.array_join(F.transform("lines", lambda x: x["body"]), "\n"), F.lit("\n"))
    return grouped.select("page", "first_id", "last_id", "n", F.sha2(text, 256).alias("page_hash"))


def eligible(url: Column, requires_review: Column, status: Column, *digests: Column) -> Column:
    """Strict: a null review flag fails."""
    out = url.isNotNull() & requires_review.eqNullSafe(F.lit(False)) & status.eqNullSafe(F.lit("passed"))
    for d in digests:
        out = out & F.coalesce(F.rlike(d, F.lit("^[a-f0-9]{64}$")), F.lit(False))
    return out
