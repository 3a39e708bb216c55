"""Ids for names that come in batches: a name gets its id once, and later batches see it.

The store has a folder a batch with the keys that were new in it. A batch is written under its own number, so one that is
tried again after a crash sees the batches before it and writes the same ids in the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text
from granary.functions.text import lookup_key, short_hash
from granary.sources.stores import exists

SCHEMA = "key string, name string, base string, id string, batch long"


def minted(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(key, name, base, id, batch) of the store, or of the batches before one."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def mint(names: DataFrame, name: str, path: str, batch: int) -> DataFrame:
    """Add the names of a batch to the store at path, and return (key, id) of all of its names.

    Names with one lookup key are one; the smallest is kept. An id is the slug of the name; where a batch before or a
    smaller key of this one has it, a hash of the key comes after it. Names without a letter or digit have no id.
    """
    spark = names.sparkSession
    known = minted(spark, path, batch)
    mine = names.select(F.col(name).alias("name"), lookup_key(F.col(name)).alias("key")).where("key <> ''").groupBy("key").agg(F.min("name").alias("name"))
    new = mine.join(known.select("key"), "key", "left_anti").withColumn("base", text.slug(F.col("name")))
    used = known.select("base").distinct().withColumn("_used", F.lit(True))
    place = F.row_number().over(Window.partitionBy("base").orderBy("key"))
    new = new.join(used, "base", "left").withColumn("_taken", F.col("_used").isNotNull() | (place > 1))
    id_ = F.when(F.col("_taken"), F.concat("base", F.lit("-"), short_hash(F.col("key"), 16))).otherwise(F.col("base"))
    rows = new.select("key", "name", "base", id_.alias("id"), F.lit(batch).cast("long").alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    return mine.select("key").join(minted(spark, path, batch + 1).select("key", "id"), "key")


def mint_available(stream: DataFrame, name: str, path: str, checkpoint: str) -> None:
    """mint() for every batch of a stream that is there; the next call goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(lambda rows, batch: None if mint(rows, name, path, batch) is None else None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
