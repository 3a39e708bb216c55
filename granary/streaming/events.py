"""Event time: sessions, pairs within an interval and late rows, as streams with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from granary.sources.stores import scratch


def stream_of(spark: SparkSession, path: str, at: str, files: int | None = None) -> DataFrame:
    """A stream of the parquet files of a path, some files a batch; the time column ``at`` as a timestamp of the session's zone."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    path = path.rstrip("/")
    # a pattern that only the path matches: a stream takes a file by a pattern alone
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]").withColumn(at, F.col(at).cast("timestamp"))


def available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream gives for the rows that are there, as a table in the shared folder; the query's state is kept beside it."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def sessions(events: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """(key, start, end, n): runs of a key's rows with less than a gap between them; end is the last row's time and the
    gap. A session is given once the watermark, ``delay`` behind the latest row, has passed its end; rows that come later
    than the watermark count for none."""
    windows = events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def pairs_within(left: DataFrame, right: DataFrame, key: str, at: str, before: str, delay: str) -> DataFrame:
    """(l, r): rows of two streams of one key, r at most ``before`` earlier than l. State is kept only as long as the
    watermarks allow another match."""
    named = lambda df, side: df.withWatermark(at, delay).select(F.col(key).alias(f"{side}_key"), F.col(at).alias(f"{side}_at"), F.struct(*df.columns).alias(side))
    close = F.expr(f"l_key = r_key AND r_at <= l_at AND r_at >= l_at - INTERVAL {before}")
    return named(left, "l").join(named(right, "r"), close).select("l", "r")


class Lateness(StatefulProcessor):
    """Per key, the latest time so far; a row says how many seconds it is behind it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "at timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seen = pd.Timestamp(self.latest.get()[0]) if self.latest.exists() else None
        for pdf in rows:
            pdf = pdf.sort_values("place", kind="stable")
            before = pdf["happened"].cummax().shift(1)
            if seen is not None:
                before = before.where(before > seen, seen)
            behind = (before - pdf["happened"]).dt.total_seconds().clip(lower=0).fillna(0.0)
            newest = pdf["happened"].max()
            seen = newest if seen is None or newest > seen else seen
            yield pd.DataFrame({"id": pdf["place"], "behind": behind})
        if seen is not None:
            self.latest.update((seen.to_pydatetime(),))

    def close(self) -> None:
        pass


def lateness(events: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """(id, behind): for each row, in the order in which rows arrive, the seconds that it is behind the latest of its key
    before it. The state is one time a key, in transformWithState's store."""
    rows = events.select(key, F.col(at).alias("happened"), F.col(order).cast("long").alias("place"))
    return rows.groupBy(key).transformWithStateInPandas(Lateness(), "id long, behind double", "append", "none")
