"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets its own; a
    cluster's driver and executors have no folder in common then, and it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}/{name}"


_COLLECTED = {"at": 0.0}


def collected(spark: SparkSession, every: float = 6.0) -> None:
    """Let the driver collect garbage and give freed memory back, unless it just did.

    Spark's cleaner removes the shuffles and broadcasts of finished jobs only when the driver has collected what refers
    to them; and a driver of many small jobs compiles much, whose memory stays with the allocator of its threads until
    it is trimmed (by a diagnostic command, on JVMs that have it).
    """
    if time.monotonic() - _COLLECTED["at"] < every:
        return
    spark._jvm.System.gc()
    java = spark._jvm.java.lang
    commands = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = java.management.ManagementFactory.getPlatformMBeanServer()
    # the server's class is hidden by its module, so it is called through its interface
    methods = {m.getName(): m for m in java.Class.forName("javax.management.MBeanServer").getMethods()}

    def call(name: str, *given: object) -> object:
        args = spark.sparkContext._gateway.new_array(java.Object, len(given))
        for i, x in enumerate(given):
            args[i] = x
        return methods[name].invoke(server, args)

    if call("isRegistered", commands) and any(o.getName() == "systemTrimNativeHeap" for o in call("getMBeanInfo", commands).getOperations()):
        call("invoke", commands, "systemTrimNativeHeap", None, None)
    _COLLECTED["at"] = time.monotonic()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    collected(spark)
    return spark.read.schema(df.schema).parquet(path)


def erased(df: DataFrame) -> None:
    """Remove a table that written() gave, as soon as nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Keep an Arrow batch of texts to some MB, or to one text that is longer. The session keeps the setting, as a
    DataFrame that is returned runs after the call."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def most_frequent(df: DataFrame, count: str, key: str, limit: int) -> DataFrame:
    """About the ``limit`` rows of df with the largest counts (1 or more): all from a threshold on, which a histogram in
    steps of a sixteenth of a doubling gives, and of the step below as many by a hash of their key as leave no more than
    that in all, but for chance. So rows are filtered where they are, not sorted in one task."""
    step, fine = F.floor(F.log2(count) * 16), 1 << 20
    rows, least, part = 0, 1 << 20, 0
    for s, n in sorted(df.groupBy(step.alias("s")).count().collect(), reverse=True):
        if rows + n > limit:
            part = int((limit - rows) / n * fine)
            break
        rows, least = rows + n, s
    return df.where((step >= least) | ((step == s) & (F.pmod(F.xxhash64(key), F.lit(fine)) < part))) if part else df.where(step >= least)


def bitmap(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """2**bits bits, packed from the lowest: those set whose number is the first bits of some key (a long). Each run of
    2**15 slots is a row of one group, so that only the bits themselves, of that fixed size, reach the driver."""
    slot = F.shiftrightunsigned(key, 64 - bits) + 1
    slots = keys.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("place")).distinct()
    out = np.zeros(max(1, 2**bits // 8), np.uint8)
    for row in slots.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("set")).toLocalIterator():
        found, at = np.frombuffer(row["set"], np.uint8), (row["bucket"] - 1) * 2**12
        out[at : at + len(found)] = found[: len(out) - at]
    return out


def in_bitmap(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key (unsigned) is set."""
    slot = keys >> np.uint64(64 - (8 * len(table) - 1).bit_length())
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where df has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: str, *cols: str) -> Column:
    """A hex digest of seed and columns: the same order in every run and engine."""
    parts = [F.lit(seed)] + [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def sum_over_all(column: str) -> Column:
    """A sum over a small table (one row a source or bucket), as a window without keys."""
    return F.sum(column).over(_everything())


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))
