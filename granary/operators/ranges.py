"""Joins on time and on ranges: as-of, within an interval, and points in ranges. All are equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, buckets: int = 4096) -> DataFrame:
    """Every row of left with ``match``, the latest row of right (a struct) of the same key that is not later; null if none.

    Both have key (equal in name) and the time column ``at``. Of right's rows with one key and time, the one with the
    largest ``tie`` counts. A left row without key or time has no match.

    Times are cut into buckets of equal length. Inside a bucket of a key, rows are put in order and carry the last row
    of right forward; beyond it, only each bucket's last row is carried, so a key with many rows is dealt to many
    tasks, and the window over a key has a row a bucket.
    """
    ends = right.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).union(left.agg(F.min(at), F.max(at))).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lo, hi = ends.select(_micros(F.col("lo")), _micros(F.col("hi"))).first()
    width = max(1, ((hi or 0) - (lo or 0)) // buckets + 1)
    bucket = F.floor((_micros(F.col("_at")) - F.lit(lo or 0)) / F.lit(width)).cast("long")
    mine = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    theirs = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(*right.columns).alias("_r")
    )
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("_bucket", bucket)
    # of a bucket its last row of right, and for each bucket that of the latest one before
    last = both.groupBy("_key", "_bucket").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_at", "_tie"))).alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_key", "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    in_bucket = Window.partitionBy("_key", "_bucket").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_inside", F.last("_r", ignorenulls=True).over(in_bucket)).where("_side = 1")
    matched = inside.join(carried.hint("merge"), inside["_key"].eqNullSafe(carried["_key"]) & inside["_bucket"].eqNullSafe(carried["_bucket"]), "left")
    usable = inside["_key"].isNotNull() & F.col("_at").isNotNull()
    return matched.select("_l.*", F.when(usable, F.coalesce("_inside", "_carried")).alias("match"))


def within(left: DataFrame, right: DataFrame, key: str, at: str, before: int, after: int = 0) -> DataFrame:
    """(l, r): pairs of rows of one key, as structs, with r's time from ``before`` seconds earlier than l's to ``after`` seconds later.

    Buckets are as long as the interval, so a row of left looks into two or three of them; a key's rows are dealt by time.
    Neither side is broadcast, as the rows made here are more than their files say.
    """
    length = max(1, (before + after) * 1_000_000)
    time = lambda alias: _micros(F.col(f"{alias}.{at}"))
    mine = left.select(F.struct(*left.columns).alias("l")).where(F.col(f"l.{at}").isNotNull())
    low, high = time("l") - F.lit(before * 1_000_000), time("l") + F.lit(after * 1_000_000)
    mine = mine.select("l", F.col(f"l.{key}").alias("_key"), F.explode(F.sequence(F.floor(low / length), F.floor(high / length))).alias("_bucket"))
    theirs = right.select(F.struct(*right.columns).alias("r")).select("r", F.col(f"r.{key}").alias("_key"), F.floor(time("r") / length).alias("_bucket"))
    return mine.join(theirs.hint("merge"), ["_key", "_bucket"]).where((time("r") >= low) & (time("r") <= high)).select("l", "r")


def containing(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """(p, r): points with the ranges of their key (start and end included) that they are in, as structs, for numbers ``at``, start and end (longs).

    A range is in the buckets, 17 at most, of the largest power of 16 below its length; a
    point looks into its bucket of every power that occurs, 17 at most, so ranges of any length meet their points by equality.
    Both sides are larger than their files say, so neither is broadcast.
    """
    length = F.col(f"r.{end}") - F.col(f"r.{start}") + 1
    theirs = ranges.select(F.struct(*ranges.columns).alias("r")).where(length > 0).withColumn("_level", (F.floor((F.length(F.bin(length - 1)) - 1) / 4) * 4).cast("int"))
    levels = sorted(r["_level"] for r in theirs.select("_level").distinct().collect())
    spread = theirs.select("r", F.col(f"r.{key}").alias("_key"), "_level", F.explode(F.sequence(F.expr(f"shiftright(r.{start}, _level)"), F.expr(f"shiftright(r.{end}, _level)"))).alias("_bucket"))
    mine = points.select(F.struct(*points.columns).alias("p")).select("p", F.col(f"p.{key}").alias("_key"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_level"))
    mine = mine.withColumn("_bucket", F.expr(f"shiftright(p.{at}, _level)"))
    inside = (F.col(f"p.{at}") >= F.col(f"r.{start}")) & (F.col(f"p.{at}") <= F.col(f"r.{end}"))
    return mine.join(spread.hint("merge"), ["_key", "_level", "_bucket"]).where(inside).select("p", "r")
