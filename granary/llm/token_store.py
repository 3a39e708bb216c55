"""Token ids in patched frame-of-reference files.

Ids are stored in blocks of 128. A block subtracts its minimum, packs the differences at the width that holds a
given share of them (90 %), and keeps what does not fit in an exception list of places and high bits. A frame
holds up to about a million ids of whole documents: the documents' ids and starts, and for each block its
minimum, width, start in the packed words and start in the exceptions, so any range of ids is read by decoding
its own blocks.

A part is one range of doc_id in order; its files hold a bounded number of frames, each followed by a line feed.
Files are written by Spark's own committing writer to the shared folder, so a lost executor leaves no half of a file
behind. Headers alone tell how many ids a part has.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm._common import new_path, small_batches
from granary.llm.bpe import codec

BLOCK = 128
FRAME_IDS = 1 << 20
#: Frames of a file, at most: some 100 MB.
FRAMES = 48
MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sQIQQIQQ")  # magic, bytes, documents, first id's place in its part, ids, blocks, words, exceptions


def pack(values: np.ndarray, share: float = 0.9) -> dict[str, np.ndarray]:
    """Blocks of unsigned 32-bit values; the last block is filled with its first value."""
    n = len(values)
    blocks = -(-n // BLOCK)
    table = np.full(blocks * BLOCK, values[(blocks - 1) * BLOCK] if n else 0, dtype=np.uint64)
    table[:n] = values
    table = table.reshape(blocks, BLOCK)
    low = table.min(axis=1) if blocks else np.zeros(0, np.uint64)
    gaps = table - low[:, None]
    rank = min(BLOCK - 1, int(share * BLOCK))
    widths = np.frompyfunc(int.bit_length, 1, 1)(np.partition(gaps, rank, axis=1)[:, rank].astype(object)).astype(np.uint8) if blocks else np.zeros(0, np.uint8)
    highs = gaps >> widths[:, None].astype(np.uint64)
    where_block, where = np.nonzero(highs)
    n_words = widths.astype(np.int64) * (BLOCK // 64)
    word_start = np.concatenate([[0], np.cumsum(n_words)])
    words = np.zeros(word_start[-1], dtype=np.uint64)
    for w in np.unique(widths):
        if w:
            rows = np.flatnonzero(widths == w)
            kept = gaps[rows] & np.uint64((1 << int(w)) - 1)
            out = np.zeros((len(rows), int(n_words[rows[0]])), dtype=np.uint64)
            for i in range(BLOCK):
                at, shift = divmod(i * int(w), 64)
                out[:, at] |= kept[:, i] << np.uint64(shift)
                if shift + int(w) > 64:
                    out[:, at + 1] |= kept[:, i] >> np.uint64(64 - shift)
            words[word_start[rows][:, None] + np.arange(out.shape[1])] = out
    exc_start = np.concatenate([[0], np.cumsum(np.bincount(where_block, minlength=blocks))]) if blocks else np.zeros(1)
    return {
        "low": low.astype("<u4"), "width": widths, "word_start": word_start.astype("<u8"), "exc_start": exc_start.astype("<u4"),
        "words": words.astype("<u8"), "exc_place": where.astype(np.uint8), "exc_high": highs[where_block, where].astype("<u4"),
    }


def unpack(p: dict[str, np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks first to last - 1."""
    last = len(p["low"]) if last is None else last
    widths, starts = p["width"][first:last].astype(np.int64), p["word_start"].astype(np.int64)
    gaps = np.zeros((last - first, BLOCK), dtype=np.uint64)
    for w in np.unique(widths):
        if w:
            rows = np.flatnonzero(widths == w)
            words = p["words"][starts[first + rows][:, None] + np.arange(int(w) * (BLOCK // 64))].astype(np.uint64)
            out, mask = np.empty((len(rows), BLOCK), dtype=np.uint64), np.uint64((1 << int(w)) - 1)
            for i in range(BLOCK):
                at, shift = divmod(i * int(w), 64)
                v = words[:, at] >> np.uint64(shift)
                if shift + int(w) > 64:
                    v = v | words[:, at + 1] << np.uint64(64 - shift)
                out[:, i] = v & mask
            gaps[rows] = out
    e = p["exc_start"].astype(np.int64)
    lo, hi = (int(e[first]), int(e[last])) if len(e) > last else (0, 0)
    block = np.repeat(np.arange(last - first), np.diff(e[first : last + 1]))
    gaps[block, p["exc_place"][lo:hi]] |= p["exc_high"][lo:hi].astype(np.uint64) << widths[block].astype(np.uint64)
    return (gaps + p["low"][first:last].astype(np.uint64)[:, None]).ravel().astype(np.uint32)


def frame(doc_ids: list, ids: list[bytes], place: int) -> bytes:
    """Documents (ids as 32-bit little-endian bytes) as a frame; place: ids before it in its part."""
    values = np.frombuffer(b"".join(ids), "<u4")
    starts = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("<u8")
    p = pack(values)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    names = np.array([0 if x is None else x for x in doc_ids], dtype="<i8")
    body = b"".join(x.tobytes() for x in (names, known, starts, *p.values()))
    return _HEAD.pack(MAGIC, _HEAD.size + len(body), len(doc_ids), place, len(values), len(p["low"]), len(p["words"]), len(p["exc_place"])) + body


def head_of(data: bytes, at: int) -> tuple[int, int]:
    """(where the next frame starts, ids of its part before that one)."""
    _, size, _, place, n, *_ = _HEAD.unpack_from(data, at)
    return at + size + 1, place + n


def read_frame(data: bytes, at: int = 0) -> tuple[dict, int]:
    """(the frame that starts at ``at``, where the next one starts)."""
    magic, size, docs, place, n, blocks, words, exceptions = _HEAD.unpack_from(data, at)
    if magic != MAGIC or at + size > len(data):
        raise ValueError("not a whole frame")
    layout = [
        ("doc_id", "<i8", docs), ("known", "u1", docs), ("starts", "<u8", docs + 1), ("low", "<u4", blocks), ("width", "u1", blocks),
        ("word_start", "<u8", blocks + 1), ("exc_start", "<u4", blocks + 1), ("words", "<u8", words), ("exc_place", "u1", exceptions), ("exc_high", "<u4", exceptions),
    ]
    got, pos = {"place": place, "n": n}, at + _HEAD.size
    for name, kind, count in layout:
        got[name] = np.frombuffer(data, kind, count, pos)
        pos += got[name].nbytes
    return got, at + size + 1


def read_range(f: dict, lo: int, hi: int) -> np.ndarray:
    """Ids lo to hi - 1 of a frame, from the blocks that hold them."""
    if hi <= lo:
        return np.zeros(0, np.uint32)
    first, last = lo // BLOCK, -(-hi // BLOCK)
    return unpack(f, first, last)[lo - first * BLOCK : hi - first * BLOCK]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None, frames_a_file: int = FRAMES) -> None:
    """Write docs' (doc_id, text) ids, each with end_id after it, in ascending doc_id order under path.

    Null doc_ids come first; rows with equal doc_ids are ordered by a hash of their texts, so that many of them don't
    fall in one part. A null text counts as an empty one and has the end id alone. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("mix"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(parts, "doc_id", "mix", "row").sortWithinPartitions("doc_id", "mix", "row").select("doc_id", "text")
    end = int(end_id).to_bytes(4, "little")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, place = codec(tokenizer), 0
        names, ids, held = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([frame(names, ids, place)], pa.binary())], ["frame"])

        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                names.append(name)
                ids.append(coder.encode(text) + end)
                held += len(ids[-1]) // 4
                if held >= FRAME_IDS:
                    yield row()
                    place += held
                    names, ids, held = [], [], 0
        if names:
            yield row()

    made = ordered.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("maxRecordsPerFile", frames_a_file).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files under path."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["content"], strict=True):
                yield part, data.as_buffer()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in contents(batches):
            at, end = 0, 0
            while at < len(data):
                at, end = head_of(data, at)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([end], pa.int64())], ["part", "n"])

    def docs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in contents(batches):
            at = 0
            while at < len(data):
                f, at = read_frame(data, at)
                ids = unpack(f)[: f["n"]].astype("<u4")
                cuts = f["starts"].astype(np.int64)
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                names = pa.array(f["doc_id"], pa.int64(), mask=f["known"] == 0)
                columns = [pa.array(np.full(len(names), part)), names, pa.array(cuts[:-1] + f["place"], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    number = F.regexp_extract("path", "part-([0-9]+)", 1).cast("long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(number.alias("part"), "content")
    docs = found.mapInArrow(docs_of, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    totals = found.mapInArrow(ends, "part long, n long").groupBy("part").agg(F.max("n").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def tokens_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs' ids to files in the shared folder and read them back; a table without rows gives none."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
