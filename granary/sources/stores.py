"""Files that are replaced as a whole, on any store that Hadoop's interface reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names for checkpoints; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="granary-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, whoever reads it, and with its plan cut."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _text_at(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; an error if there is one."""
    store, target = _raw(*_at(spark, path))
    out = store.create(target, False)
    try:
        out.write(text.encode())
    finally:
        out.close()


def _raw(store, target):
    """A local store without checksum files beside its files, which could not be replaced together with them."""
    return (store.getRawFileSystem(), target) if store.getScheme() == "file" else (store, target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it onto it: a reader sees the old or the new one at any time."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    _text_at(spark, beside, text)
    (store, target), (_, source) = _at(spark, path), _at(spark, beside)
    if store.getScheme() == "file":
        store, _ = _raw(store, target)
        _, checksum = _at(spark, "/".join([path.rsplit("/", 1)[0], f".{path.rsplit('/', 1)[1]}.crc"]))
        store.delete(checksum, False)
        done = store.rename(source, target)
    elif store.exists(target):
        options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, how)
        done = True
    else:
        done = store.rename(source, target)
    if not done:
        raise OSError(f"{path} can't be written")


def publish(spark: SparkSession, staging: str, output: str) -> str:
    """Make a folder the current version of output, and return its path.

    The folder is moved to a name of its own under output/versions; then a pointer of the next number, which must not be
    there yet, is created with that name in it. Whatever step fails, and whoever publishes at the same time, readers find the last
    pointer that is whole (current()), and with it all of the old version or all of the new one.
    """
    root = output.rstrip("/")
    version = f"versions/{uuid.uuid4().hex}"
    store, target = _at(spark, f"{root}/{version}")
    _, source = _at(spark, staging)
    store.mkdirs(target.getParent())
    if not store.rename(source, target):
        raise OSError(f"{staging} can't be moved to {root}/{version}")
    _text_at(spark, f"{root}/pointers/{max(_pointers(spark, root), default=0) + 1:020}", version + "\n")
    return f"{root}/{version}"


def _pointers(spark: SparkSession, root: str) -> dict[int, str]:
    """Pointers by number; one that was not written to its end is among them, with its path."""
    store, folder = _at(spark, f"{root}/pointers")
    if not store.exists(folder):
        return {}
    return {int(f.getPath().getName()): f.getPath().toString() for f in store.listStatus(folder) if f.getPath().getName().isdigit()}


def current(spark: SparkSession, output: str) -> str | None:
    """The path of output's current version: that of the last whole pointer; null if nothing is published."""
    root = output.rstrip("/")
    for _, path in sorted(_pointers(spark, root).items(), reverse=True):
        store, target = _at(spark, path)
        stream = store.open(target)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if text.endswith("\n"):
            return f"{root}/{text.strip()}"
    return None


def prune(spark: SparkSession, output: str, keep: int = 2) -> None:
    """Remove the pointers before the last ``keep`` whole ones, then the versions that no pointer names and are older than theirs."""
    root = output.rstrip("/")
    held = sorted(_pointers(spark, root).items())
    for _, path in held[:-keep]:
        store, target = _at(spark, path)
        named = bytes(store.open(target).readAllBytes()).decode().strip()
        store.delete(target, False)
        if named:
            store.delete(_at(spark, f"{root}/{named}")[1], True)


def replace_folder(spark: SparkSession, staging: str, output: str) -> None:
    """Put a folder in another's place; the old one comes back where that fails, and goes where it does not."""
    store, target = _at(spark, output)
    _, new = _at(spark, staging)
    _, backup = _at(spark, f"{output.rstrip('/')}.backup-{uuid.uuid4().hex}")
    had = store.exists(target)
    if had and not store.rename(target, backup):
        raise OSError(f"{output} can't be moved away")
    moved = False
    try:
        moved = store.rename(new, target)
    finally:
        if not moved and had:
            store.rename(backup, target)
    if not moved:
        raise OSError(f"{staging} can't be put in place of {output}")
    if had:
        store.delete(backup, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return store.exists(target)
