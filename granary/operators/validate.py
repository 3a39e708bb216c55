"""Integrity: unique ids, contiguous steps, manifests against files, changes, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.rules import all_matches


def repeats(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Second and later rows of a key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("nth > 1")


def step_gaps(rows: DataFrame, key: str, step: str) -> DataFrame:
    """Keys whose distinct steps are not 1 to n."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(step).alias("low"), F.max(step).alias("high"), F.count_distinct(step).alias("kinds"))
    return found.where("low <> 1 OR high <> n OR kinds <> n").select(key, "n", "low", "high")


def manifest_issues(listed: DataFrame, present: DataFrame, key: str, value: str) -> DataFrame:
    """(key, issue): listed but missing, present but unlisted, or different."""
    a, b = listed.select(key, F.col(value).alias("_a"), F.lit(1).alias("_l")), present.select(key, F.col(value).alias("_b"), F.lit(1).alias("_p"))
    issue = F.when(F.col("_p").isNull(), F.lit("missing")).when(F.col("_l").isNull(), F.lit("unlisted")).when(~F.col("_a").eqNullSafe(F.col("_b")), F.lit("different"))
    return a.join(b, key, "full_outer").select(key, issue.alias("issue")).where("issue IS NOT NULL")


def changed(staged: DataFrame, final: DataFrame, key: str, digest: str) -> DataFrame:
    """Staged rows that are not final yet, or with another digest."""
    known = final.select(key, F.col(digest).alias("_final"))
    return staged.join(known, key, "left").where(F.col("_final").isNull() | (F.col("_final") != F.col(digest))).drop("_final")


def conflicts(staged: DataFrame, final: DataFrame, key: str) -> DataFrame:
    """Keys on both sides whose shared columns differ in any value; nulls are equal to nulls."""
    shared = [c for c in staged.columns if c in final.columns and c != key]
    a, b = staged.select(key, F.struct(*shared).alias("_a")), final.select(key, F.struct(*shared).alias("_b"))
    return a.join(b, key).where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key).distinct()


def staleness(version: Column, wanted: str, source_hash: Column, source: Column, final_hash: Column, final: Column) -> Column:
    """Why a staged row can't be used again: its version or either of its texts' digests changed."""
    differs = lambda digest, text: ~F.coalesce(digest, F.lit("")).eqNullSafe(F.sha2(F.coalesce(text, F.lit("")), 256))
    return all_matches([(~version.eqNullSafe(F.lit(wanted)), "version changed"), (differs(source_hash, source), "source changed"), (differs(final_hash, final), "text changed")])


def all_errors(*lists: Column) -> Column:
    """Errors of several lists, each once, in the order of their first; null lists count as empty."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with side (left or right); none if they hold the same rows."""
    columns = a.columns
    left, right = a.exceptAll(b.select(*columns)), b.select(*columns).exceptAll(a)
    return left.withColumn("side", F.lit("left")).union(right.withColumn("side", F.lit("right")))


def run_analytics(records: DataFrame, status: str, words: DataFrame, top: int = 25) -> DataFrame:
    """(kind, name, n): how many records have each status, and the most frequent words (word, n) of all."""
    counts = records.groupBy(F.col(status).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("kind"), "name", "n")
    return counts.union(words.orderBy(F.col("n").desc(), "word").limit(top).select(F.lit("word").alias("kind"), F.col("word").alias("name"), "n"))
