"""A ledger of addresses as a stream: each new canonical address once, whatever run it comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.functions.urls import canonical
from granary.sources.stores import exists


def new_addresses(spark: SparkSession, folder: str, schema: str, url: str = "url") -> DataFrame:
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.withColumn("canonical_url", canonical(F.col(url))).dropDuplicates(["canonical_url"])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there to parquet and stop; the next call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_latest(stream: DataFrame, key: str, order: str, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the latest row of each key at path, in buckets of keys; a batch writes new versions of the buckets it has
    rows for and nothing else, and a repeated batch writes the same versions. Read them with latest()."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if exists(spark, path):
            touched = rows.select("bucket").distinct()
            rows = rows.unionByName(latest(spark, path, epoch).join(F.broadcast(touched), "bucket", "left_semi"))
        kept = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*", "bucket").withColumn("version", F.lit(epoch))
        kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The rows of each bucket's last version (of those before an epoch), with bucket."""
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    last = rows.select("bucket", "version").distinct().groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(last), ["bucket", "version"], "left_semi").drop("version")
