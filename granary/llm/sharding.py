"""Proportional stratified interleaving.

Rows are shuffled by a seeded digest within each source and take the fractional rank
``(rank - 1/2) / rows of the source``. Sorted by fractional rank and cut into equal lengths, every shard
holds each source in the proportion of the whole.

Exact global ranks need no global sort in one task: the digest's first digits split each source into 4,096
buckets and the fractional rank splits the whole into 4,096; sums of the bucket counts (the second ones
follow from the sources' sizes alone) give each bucket's first rank, and windows stay inside buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm._common import seeded, sum_over_all

KEYS = ["no_source", "src"]
BUCKETS = 4096


def interleave(docs: DataFrame, shards: int = 8, seed: str = "shard-1") -> DataFrame:
    """Deal docs (doc_id, source, text) into shards; counts differ by one at most (law ``rows``).

    Returns doc_id, source, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (from 0 in each shard)
    and grown_shard (null: only the law ``key`` has it). A null text counts as an empty one and a null
    source as a source of its own. Rows with equal doc_id are told apart by checksum and size; equal rows
    are interchangeable. A table without rows gives none. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = [
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("src"),
        seeded(seed, "doc_id").alias("draw"),
    ]
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *keyed)
    rows = rows.withColumn("bucket", F.substring("draw", 1, 3))
    counts = docs.select(*keyed).groupBy(*KEYS, F.substring("draw", 1, 3).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*KEYS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *KEYS, "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy(*KEYS)).alias("of"),
    )
    in_bucket = Window.partitionBy(*KEYS, "bucket").orderBy("draw", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(in_bucket)).join(starts, [*KEYS, "bucket"])
    ranked = ranked.withColumn("rank", F.col("start") + F.col("nth"))
    ranked = ranked.withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("of"))).withColumn("slice", F.expr(f"(2 * rank - 1) * {BUCKETS} div (2 * of)"))

    first = f"(of * slice + {BUCKETS // 2 + BUCKETS - 1}) div {BUCKETS}"
    slices = counts.groupBy(*KEYS).agg(F.sum("n").alias("of")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    slices = slices.withColumn("n", F.expr(f"{first.replace('slice', '(slice + 1)')} - {first}")).groupBy("slice").agg(F.sum("n").alias("n"))
    slices = slices.select(
        F.col("slice").cast("long"),
        F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        sum_over_all("n").alias("all_rows"),
    )
    in_slice = Window.partitionBy("slice").orderBy("fraction", "draw", *KEYS, "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("nth", F.row_number().over(in_slice)).join(slices, "slice")
    placed = placed.withColumn("place", F.col("before") + F.col("nth") - 1).withColumn("shard", F.expr(f"place * {shards} div all_rows").cast("int"))
    return placed.select(
        "doc_id", "source", "size", "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"place - (shard * all_rows + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
