"""Sketches that are kept by day and merged over any grouping: distinct keys (HLL and theta) and quantiles (KLL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(rows: DataFrame, at: str, dims: list[str], key: str, value: str) -> DataFrame:
    """A row a day and combination of dims, with n, total and the sketches users_hll, users_theta and values_kll.

    Sketches are some KB a row whatever they have seen, are built as partial aggregates, and are what is stored: days that
    come later are new rows, and no day is read again.
    """
    return rows.groupBy(F.to_date(at).alias("day"), *dims).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(38,6)")).alias("total"), F.hll_sketch_agg(key).alias("users_hll"),
        F.theta_sketch_agg(key).alias("users_theta"), F.kll_sketch_agg_double(value).alias("values_kll"),
    )


def merged(days: DataFrame, dims: list[str]) -> DataFrame:
    """n, total, users (HLL), users_theta and median over the rollup of dims: all of them, without the last, and so on to one total row."""
    grouped = days.rollup(*dims).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("users_hll")).alias("users"),
        F.theta_sketch_estimate(F.theta_union_agg("users_theta")).alias("users_theta"), F.kll_merge_agg_double("values_kll").alias("values"),
    )
    return grouped.withColumn("median", F.kll_sketch_get_quantile_double("values", F.lit(0.5))).drop("values")
