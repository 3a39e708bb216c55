"""Substring search by posting lists of trigrams: only rows that have all of the needle's trigrams are read and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.stores import kept


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-cased text; they overlap, so each is matched without being consumed."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def index(rows: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """(gram, key): posting lists of a text column as a table in the shared folder, in ranges of the grams, so that a search
    for some grams leaves out files and row groups by their statistics. Frequent lists are split among ranges by key."""
    listed = rows.select(F.explode(_grams(F.col(text))).alias("gram"), F.col(key).alias("key"))
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(listed.repartitionByRange(parts, "gram", "key").sortWithinPartitions("gram", "key"), "trigrams")


def candidates(found: DataFrame, needle: str) -> DataFrame:
    """(key) of the rows that have all trigrams of a needle of three characters or more."""
    lowered = needle.lower()
    grams = sorted({lowered[i : i + 3] for i in range(len(lowered) - 2)})
    hits = found.where(F.col("gram").isin(grams)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(grams)).select("key")


def holding(rows: DataFrame, found: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """rows whose text holds the needle in any case, by the index where the needle is long enough for it. Keys are unique."""
    verified = F.contains(F.lower(F.col(text)), F.lit(needle.lower()))
    if len(needle.lower()) < 3:
        return rows.where(verified)
    return rows.join(candidates(found, needle).withColumnRenamed("key", key), key, "left_semi").where(verified)
