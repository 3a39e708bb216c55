"""Ranked search (BM25) over an inverted index in segments, with block maxima and early stopping.

The index is built where the texts are: each task packs its rows into segments of a bounded number of documents and
postings, without a shuffle, so a task's memory does not grow with its rows. A segment has, for each word, its postings (places of documents and counts) in the narrowest whole numbers
that hold them, and for each block of documents the largest count and the shortest text, from which follows a bound on
what the word can add to any document of the block.

A search goes through the segments one after another in many tasks. For a query, blocks are read in the order of their
bounds, and the rest is skipped once the bound is below the k-th score that the task has found so far.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.stores import kept

#: Documents of a segment and of a block; queries that go through the segments together.
SEGMENT, BLOCK, QUERIES = 1 << 13, 1 << 6, 1 << 10
#: Postings after which a segment ends with the document it is at; rows that a task turns into Python values at once.
POSTINGS, ROWS = 1 << 19, 1 << 8
#: Saturation of counts, weight of lengths, and units of a score: terms are floored to millionths, so sums are exact.
K1, B, UNIT = 1.2, 0.75, 1_000_000
_WIDTHS = {w: np.dtype(f"<u{w}") for w in (1, 2, 4, 8)}
_TOKEN = re.compile(r"[a-z0-9]+")
_INDEX = "segment string, word string, n long, first binary, counts binary, blocks binary, tops binary, shortest binary"


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the narrowest width, which the first byte says."""
    most = int(values.max()) if len(values) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + values.astype(_WIDTHS[width]).tobytes()


def _values(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of some columns as Python values, ROWS at a time, however many a batch has."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield from zip(*(some[c].to_pylist() for c in columns), strict=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The index of a text column as a table in the shared folder: a row a word of a segment, and one without a word with
    the segment's keys and lengths. Keys are whole numbers; a null text has no words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        started = lambda: ([], [], {}, (array("i"), array("i"), array("i")))
        keys, lengths, words, held = started()

        def segment() -> Iterator[pa.RecordBatch]:
            name, sizes = f"{part}-{turn}", np.array(lengths, np.int64)
            word, place, count = (np.array(v, np.int64) for v in held)
            order = np.argsort(word, kind="stable")
            word, place, count = word[order], place[order], count[order]
            # the blocks of all words at once, then each word's part of them
            start = np.flatnonzero(np.diff(word * SEGMENT + place // BLOCK, prepend=-1))
            tops, shortest = (np.maximum.reduceat(count, start), np.minimum.reduceat(sizes[place], start)) if len(start) else (count, count)
            block, of = place[start] // BLOCK, word[start]
            steps = lambda values, group: np.where(np.diff(group, prepend=-1) != 0, values, np.diff(values, prepend=0))
            place, block = steps(place, word), steps(block, of)
            at, block_at = (np.searchsorted(group, np.arange(len(words) + 1)) for group in (word, of))
            rows = [(name, None, len(keys), np.array(keys, "<i8").tobytes(), _packed(sizes), None, None, None)]
            for i, spelled in enumerate(words):
                if len(rows) == ROWS * 16:
                    yield table(rows)
                    rows = []
                mine, blocks = slice(at[i], at[i + 1]), slice(block_at[i], block_at[i + 1])
                rows.append((name, spelled, int(at[i + 1] - at[i]), *(_packed(v[mine]) for v in (place, count)), *(_packed(v[blocks]) for v in (block, tops, shortest))))
            yield table(rows)

        for k, t in _values(batches, "k", "t"):
            found = Counter(_TOKEN.findall(t))
            held[0].extend(words.setdefault(w, len(words)) for w in found)
            held[1].extend([len(keys)] * len(found))
            held[2].extend(found.values())
            keys.append(k)
            lengths.append(sum(found.values()))
            if len(keys) == SEGMENT or len(held[0]) >= POSTINGS:
                yield from segment()
                turn, (keys, lengths, words, held) = turn + 1, started()
        if keys:
            yield from segment()

    names = [c.split()[0] for c in _INDEX.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), *[pa.binary()] * 5]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    texts = docs.select(F.col(key).cast("long").alias("k"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t")).where("k IS NOT NULL")
    return kept(texts.mapInArrow(build, _INDEX), "index")


def _part(counts: np.ndarray, lengths: np.ndarray, average: float) -> np.ndarray:
    return counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / average))


def _weighed(segment: dict, word: str, weight: float, average: float) -> tuple[np.ndarray, ...]:
    """(places, their blocks, what the word adds there; blocks, the most that it adds in them) of a word of a segment, worked out once."""
    done = segment.setdefault("weighed", {})
    if word not in done:
        places, counts, blocks, tops, shortest = segment["words"][word]
        units = lambda n, lengths: np.floor(weight * _part(n, lengths, average) * UNIT).astype(np.int64)
        done[word] = places, places // BLOCK, units(counts, segment["lengths"][places]), blocks, units(tops, shortest) + 1
    return done[word]


def _bests(segment: dict, wanted: list, average: float, most: int, best: list) -> tuple[list, int, int]:
    """(the most best (score, key) so far, blocks read, blocks skipped) of a query, wanted: (word, weight), with one more segment."""
    held = [_weighed(segment, word, weight, average) for word, weight in wanted if word in segment["words"]]
    keys = segment["keys"]
    bound = np.zeros(-(-len(keys) // BLOCK), np.int64)
    for *_, blocks, tops in held:
        bound[blocks] += tops
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    read, step = 0, 16
    while read < len(order):
        least = best[-1][0] if len(best) == most else 1
        some = order[read : read + step]
        some = some[bound[some] >= least]
        if not len(some):
            break
        chosen = np.zeros(len(bound), bool)
        chosen[some] = True
        scores = np.zeros(len(keys), np.int64)
        for places, block, adds, *_ in held:
            if len(some) < len(order):
                here = chosen[block]
                places, adds = places[here], adds[here]
            scores[places] += adds
        at = np.flatnonzero(scores >= least)
        if len(at) > most:  # all that tie with the last that can stay
            at = at[scores[at] >= np.partition(scores[at], len(at) - most)[len(at) - most]]
        best = sorted([*best, *zip(scores[at].tolist(), keys[at].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:most]
        read, step, full = read + len(some), step * 4, len(some) == step
        if not full:
            break
    return best, read, len(order) - read


def search(found: DataFrame, queries: DataFrame, key: str, text: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(results: query, rank, key, score; work: blocks read and skipped) of every query (key, text) in an index.

    score is in millionths, of equal ones the smaller key comes first. A word counts once in a query. The queries go
    through the index in blocks of QUERIES, each with its words' weights.
    """
    spark = found.sparkSession
    sizes = found.where("word IS NULL")
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    asked = queries.select(F.col(key).cast("long").alias("query"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), 0))).alias("word"))
    counts = found.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    weight = F.log(F.lit(1) + (F.lit(total) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighted = kept(asked.join(counts, "word").select("query", "word", weight.alias("weight")), "weights")

    def length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(_unpacked(x.as_py()).sum()) for x in batch["counts"]], pa.int64())], ["n"])

    words = sizes.select("counts").mapInArrow(length, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    average = words / total if words else 1.0
    ids = weighted.select("query").distinct()
    blocks = -(-ids.count() // QUERIES)
    parts = []
    for block in range(blocks):
        mine = weighted.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        wanted: dict[int, list] = {}
        for q, w, x in zip(*(mine.toArrow()[c].to_pylist() for c in ("query", "word", "weight")), strict=True):
            wanted.setdefault(q, []).append((w, x))
        parts.append(_scored(found, mine, spark.sparkContext.broadcast(wanted), average, most))
    if not parts:
        parts.append(spark.createDataFrame([], "query long, key long, score long, read long, skipped long"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    rows = kept(rows, "found")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    results = rows.where("query IS NOT NULL").select("query", place.cast("int").alias("rank"), "key", "score").where(F.col("rank") <= most)
    return results, rows.where("query IS NULL").agg(F.sum("read").alias("read"), F.sum("skipped").alias("skipped"))


def _scored(found: DataFrame, asked: DataFrame, wanted, average: float, most: int) -> DataFrame:
    """A task's best of every query, and a row with its blocks read and skipped."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {q: [] for q in wanted.value}
        read = skipped = 0
        segment: dict = {}

        def finish() -> None:
            nonlocal read, skipped
            if not segment:
                return
            for q, words in wanted.value.items():
                best[q], r, s = _bests(segment, words, average, most, best[q])
                read, skipped = read + r, skipped + s

        for name, word, *data in _values(batches, "segment", "word", "first", "counts", "blocks", "tops", "shortest"):
            if name != segment.get("name"):
                finish()
                segment = {"name": name, "words": {}}
            if word is None:
                segment["keys"], segment["lengths"] = np.frombuffer(data[0], "<i8"), _unpacked(data[1])
            else:
                packed = [_unpacked(x) for x in data]
                segment["words"][word] = (np.cumsum(packed[0]), packed[1], np.cumsum(packed[2]), packed[3], packed[4])
        finish()
        flat = [(q, k, s, None, None) for q, rows in best.items() for s, k in rows] + [(None, None, None, read, skipped)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], ["query", "key", "score", "read", "skipped"])

    needed = found.join(F.broadcast(asked.select("word").distinct()), "word", "left_semi").unionByName(found.where("word IS NULL"))
    dealt = needed.repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(score, "query long, key long, score long, read long, skipped long")
