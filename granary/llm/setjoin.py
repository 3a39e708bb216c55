"""Exact set similarity join of documents' word shingles by set relations.

Prefix index: shingles are ordered from rare to frequent, so two sets that are similar enough share a shingle
among each one's first few. Index lists hold (set, size, position); an entry is skipped, and lists are skipped by
blocks of positions, where size and position can't leave enough overlap.

Set relations: sets that are equal are one set. In every list, sets are first compared with the list's leader
alone. What a leader's answers settle is derived, not computed again: sets linked to the same leader are linked
through it, and by the triangle inequality of the Jaccard distance two sets can't be linked if their distances
to the leader differ by more than a link allows. Only pairs that no leader settles are compared themselves, those
that bitmaps of the sets' shingles can't rule out.

So a group of n near copies costs n comparisons a list, and lists are joins on a key that Spark can split, never
a group in one task. Components follow from links by contraction to smallest neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm._common import erased, most_frequent, small_batches, written
from granary.llm._words import mixed, shingles_of, text_slices, words_of

#: 100 * intersection >= PERCENT * union.
PERCENT, SIZE = 75, 5
#: Frequent shingles that are broadcast to order prefixes by, at most; a list this long is dealt out in parts.
FREQUENT, LONG_LIST = 1 << 19, 512
#: Partners of a set that are compared in one group.
PARTNERS = 256
#: Positions in a block of an index list.
BLOCK = 16
#: Sets whose components are broadcast, at most; more of them are joined by a shuffle of the lists.
LABELS = 1 << 20


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text."""
    for lo, hi, data, cuts in text_slices(column):
        hashes, at = words_of(data, cuts)
        for i in range(hi - lo):
            yield lo + i, shingles_of(hashes[at[i] : at[i + 1]], SIZE)


def _fingerprint(s: np.ndarray) -> np.ndarray:
    """128 bits of a set as two signed integers."""
    a = mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))
    b = mixed(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return np.array([a, b], dtype=np.uint64).view(np.int64)


def _name(s: np.ndarray, doubtful: frozenset[int]) -> int:
    """A set's name: the first 64 bits of its fingerprint, or a mix of all 128 where the first are another set's too."""
    a = int((mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))
    if a not in doubtful:
        return a
    return int(mixed(_fingerprint(s).view(np.uint64) * np.array([1, 0x9E3779B97F4A7C15], np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def _doubtful(profile: DataFrame) -> frozenset[int]:
    """Names that different sets have: about n * n / 2**65 of n sets, three of 10 billion."""
    names = profile.where("kind = 0 AND n > 0").groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high")
    return frozenset(r["a"] for r in names.select("a").collect())


def _sketch(s: np.ndarray) -> bytes:
    """A set's size, then a bit for each of at least twice as many slots: whether a shingle falls in it."""
    slots = 1 << max(6, (2 * len(s) - 1).bit_length())
    used = np.zeros(slots, dtype=bool)
    used[s & np.uint64(slots - 1)] = True
    return np.int64(len(s)).tobytes() + np.packbits(used).tobytes()


def _may_be_linked(a: bytes, b: bytes) -> bool:
    """False only if two sets can't be linked: a slot that one alone uses holds a shingle that the other lacks."""
    n, m = (int.from_bytes(v[:8], "little") for v in (a, b))
    a, b = (np.frombuffer(v, np.uint8, offset=8) for v in (a, b))
    while len(a) != len(b):  # a power of two of slots each, by low bits: halves of the longer one fall together
        if len(a) > len(b):
            a = a[: len(a) // 2] | a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] | b[len(b) // 2 :]
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return 100 * most >= PERCENT * (n + m - most)


def _profile(docs: DataFrame, doubtful: frozenset[int] = frozenset()) -> DataFrame:
    """kind 0: a row's doc_id, size, name (a), the other half of its fingerprint (b) and sketch. kind 1: a shingle (a) that sets of a task share, with their number (n)."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "a", "b", "sketch"]
        seen: set[int] = set()
        held, size = [], 0

        def shared() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts > 1
            h = values[many].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.nulls(len(h), id_type), pa.array(counts[many]), pa.array(h), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.binary())], names)

        for batch in batches:
            n, marks = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.int64)
            sketches = []
            for i, s in _sets(batch["text"]):
                n[i], marks[i] = len(s), _fingerprint(s)
                if doubtful:
                    marks[i, 0] = _name(s, doubtful)
                sketches.append(_sketch(s) if len(s) else None)
                if len(s) and int(marks[i, 0]) not in seen:
                    seen.add(int(marks[i, 0]))
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch["doc_id"], pa.array(n), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(sketches, pa.binary())], names)
            if size > 1 << 23:
                yield shared()
                held, size = [], 0
                if len(seen) > 1 << 20:
                    seen.clear()
        if held:
            yield shared()

    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    return docs.select("doc_id", "text").mapInArrow(profile, f"kind int, doc_id {kind.simpleString()}, n long, a long, b long, sketch binary")


def _postings(docs: DataFrame, frequent: Broadcast, doubtful: frozenset[int]) -> DataFrame:
    """(h, part, entry: pos, fp and n): the prefix of every distinct set; part deals a frequent shingle's list out."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks, parts = frequent.value
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for _, s in _sets(batch["text"]):
                if not len(s):
                    continue
                fp = _name(s, doubtful)
                if fp in seen:
                    continue
                seen.add(fp)
                if len(seen) > 1 << 20:
                    seen.clear()
                n = len(s)
                length = n - -(-PERCENT * n // 100) + 1
                at = np.minimum(np.searchsorted(hashes, s), max(0, len(hashes) - 1))
                common = hashes[at] == s if len(hashes) else np.zeros(n, bool)
                rare = s[~common][:length]
                prefix, part = rare, np.zeros(len(rare), np.int32)
                if len(rare) < length:
                    more = at[common][np.argsort(ranks[at[common]])][: length - len(rare)]
                    prefix = np.concatenate([rare, hashes[more]])
                    dealt = 1 + (np.uint64(fp & (2**63 - 1)) % parts[more].astype(np.uint64)).astype(np.int32)
                    part = np.concatenate([part, np.where(parts[more] > 1, dealt, 0).astype(np.int32)])
                k = len(prefix)
                out.append((prefix.view(np.int64), part, np.full(k, fp), np.full(k, n, np.int32), np.arange(k, dtype=np.int32)))
            if out:
                h, part, fps, sizes, places = (pa.array(np.concatenate(c)) for c in zip(*out, strict=True))
                entry = pa.StructArray.from_arrays([places, fps, sizes], ["pos", "fp", "n"])
                yield pa.RecordBatch.from_arrays([h, part, entry], ["h", "part", "entry"])

    return docs.select("text").mapInArrow(post, "h long, part int, entry struct<pos: int, fp: long, n: int>")


def possible(n: str, pos: str, m: str, at: str) -> Column:
    """Whether sets of sizes n and m may be linked that share the shingle at places pos and at of their orders, and
    none before: every pair of linked sets has one such list."""
    need = f"({PERCENT} * (cast({n} AS bigint) + {m}) + {99 + PERCENT}) div {100 + PERCENT}"
    return F.expr(f"100L * least({n}, {m}) >= {PERCENT}L * greatest({n}, {m}) AND least({n} - {pos}, {m} - {at}) >= {need}")


def _chosen_sets(docs: DataFrame, filled: Broadcast, bits: int, doubtful: frozenset[int]) -> DataFrame:
    """(fp, s): the shingles, as bytes, of the sets whose names (fp) fall in the bitmap."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(filled.value).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            fps, sets = [], []
            for _, s in _sets(batch["text"]):
                if len(s):
                    fp = _name(s, doubtful)
                    if wanted[(fp & (2**64 - 1)) >> (64 - bits)] and fp not in seen:
                        seen.add(fp)
                        fps.append(fp)
                        sets.append(s.tobytes())
                        if len(seen) > 1 << 20:
                            seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.binary())], ["fp", "s"])

    return docs.select("text").mapInArrow(send, "fp long, s binary")


def _chosen_sketches(profile: DataFrame, filled: Broadcast, bits: int) -> DataFrame:
    """(fp, s): the sketches of the sets whose names (fp) fall in the bitmap."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(filled.value).astype(bool)
        for batch in batches:
            keep = wanted[batch["fp"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)]
            yield batch.filter(pa.array(keep))

    sketches = profile.where("kind = 0 AND n > 0").select(F.col("a").alias("fp"), F.col("sketch").alias("s"))
    return sketches.mapInArrow(send, "fp long, s binary")


def _filled(chosen: DataFrame, bits: int) -> Broadcast:
    """A bitmap of the slots of the names of chosen (fp), of fixed size; where it fills up, more sets are sent than needed."""
    slots = chosen.select(F.shiftrightunsigned("fp", 64 - bits).alias("slot")).distinct()
    table = np.zeros(1 << bits, dtype=bool)
    for batch in _slot_batches(slots, bits):
        table |= batch
    return chosen.sparkSession.sparkContext.broadcast(np.packbits(table))


def _slot_batches(slots: DataFrame, bits: int) -> Iterator[np.ndarray]:
    """The slots in use as bitmaps, one a task, of fixed size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=bool)
        some = False
        for batch in batches:
            table[batch["slot"].to_numpy()] = True
            some |= batch.num_rows > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["bits"])

    for row in slots.coalesce(4).mapInArrow(pack, "bits binary").toLocalIterator():
        yield np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)


def _side_by_side(pairs: DataFrame, chosen: Callable[[Broadcast, int], DataFrame], compared: Callable[[DataFrame], DataFrame], name: str, bits: int = 23) -> DataFrame:
    """What ``compared`` makes of pairs (x, y) with what ``chosen`` gives for either set (sx, sy), as a table.

    Sets are shuffled once by name. A set y with many partners is copied for every few hundred of them, so that no
    task has them all.
    """
    pairs = written(pairs.select("x", "y"), f"pairs-{name}")
    filled = _filled(pairs.select(F.explode(F.array("x", "y")).alias("fp")), bits)
    sets = chosen(filled, bits).groupBy("fp").agg(F.first("s").alias("s"))
    copies = written(pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("copies")), f"copies-{name}")
    dealt = pairs.join(copies, "y").select("x", "y", F.pmod(F.xxhash64("x"), F.col("copies")).cast("int").alias("copy"))
    left = dealt.join(sets.select(F.col("fp").alias("x"), F.col("s").alias("sx")), "x")
    right = sets.select(F.col("fp").alias("y"), F.col("s").alias("sy")).join(copies, "y")
    right = right.select("y", "sy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    out = written(compared(left.join(right, ["y", "copy"]).select("x", "y", "sx", "sy")), f"compared-{name}")
    filled.destroy()
    erased(pairs)
    erased(copies)
    return out


def _overlaps(docs: DataFrame, pairs: DataFrame, doubtful: frozenset[int], name: str) -> DataFrame:
    """pairs (x, y) with n_x, n_y and both, the exact sizes of sets and intersection."""

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, c = [], [], []
            for a, b in zip(batch["sx"], batch["sy"], strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                n.append(len(a))
                m.append(len(b))
                c.append(len(np.intersect1d(a, b, assume_unique=True)))
            columns = [batch["x"], batch["y"], *(pa.array(v, pa.int64()) for v in (n, m, c))]
            yield pa.RecordBatch.from_arrays(columns, ["x", "y", "n_x", "n_y", "both"])

    compared = lambda both: both.mapInArrow(overlap, "x long, y long, n_x long, n_y long, both long")
    return _side_by_side(pairs, lambda filled, bits: _chosen_sets(docs, filled, bits, doubtful), compared, name)


def _plausible(profile: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (x, y) that sketches don't rule out; all linked ones are among them."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_may_be_linked(a.as_py(), b.as_py()) for a, b in zip(batch["sx"], batch["sy"], strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    compared = lambda both: both.mapInArrow(sift, "x long, y long")
    return _side_by_side(pairs, lambda filled, bits: _chosen_sketches(profile, filled, bits), compared, f"sketched-{name}")


def linked(n: str = "n_x", m: str = "n_y", both: str = "both") -> Column:
    return F.expr(f"100 * {both} >= {PERCENT} * ({n} + {m} - {both})")


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """(fp, label): for every set in links (x, y), the smallest set reachable from it.

    Each round, every set with a smaller neighbour points to its smallest one, pointers are followed to their ends
    by doubling, and links are drawn anew between the ends, until none is left. Of the sets that still have links
    at least half go in any two rounds, whatever their order: an end of the second round was the smallest
    neighbour of some set that went in the first.
    """
    edge = (F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    edges = written(links.where("x <> y").select(*edge).distinct(), f"{name}-edges")
    turns: list[DataFrame] = []
    while not edges.isEmpty():
        turn = f"{name}-{len(turns)}"
        ends, moved, step = written(edges.groupBy(F.col("x").alias("fp")).agg(F.min("y").alias("label")), turn), True, 0
        while moved:
            ahead = ends.select(F.col("fp").alias("label"), F.col("label").alias("end"))
            followed = ends.join(ahead, "label", "left").select("fp", F.coalesce("end", "label").alias("label"), F.col("end").isNotNull().alias("moved"))
            followed, step = written(followed, f"{turn}-{step}"), step + 1
            moved = not followed.where("moved").isEmpty()
            erased(ends)
            ends = followed.drop("moved")
        turns.append(ends)
        drawn = edges.join(ends.select(F.col("fp").alias("x"), F.col("label").alias("end_x")), "x")
        drawn = drawn.join(ends.select(F.col("fp").alias("y"), F.col("label").alias("end_y")), "y", "left")
        drawn = drawn.select(F.col("end_x").alias("x"), F.coalesce("end_y", "y").alias("y")).where("x <> y")
        spent, edges = edges, written(drawn.select(*edge).distinct(), f"{turn}-edges")
        erased(spent)
    if not turns:
        return edges.select(F.col("x").alias("fp"), F.col("y").alias("label"))
    # ends of a round may go in later ones
    labels = turns.pop()
    while turns:
        later, first = labels.select(F.col("fp").alias("label"), F.col("label").alias("end")), turns.pop()
        earlier = first.join(later, "label", "left").select("fp", F.coalesce("end", "label").alias("label"))
        spent, labels = labels, written(earlier.union(labels), f"{name}-{len(turns)}-all")
        erased(spent)
        erased(first)
    return labels.union(labels.select(F.col("label").alias("fp"), "label").distinct())


def _extended(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels of all sets that labels or links (x, y) have: only the links between different components are followed."""
    end = lambda side: labels.select(F.col("fp").alias(side), F.col("label").alias(f"end_{side}"))
    between = links.join(end("x"), "x", "left").join(end("y"), "y", "left").select(F.coalesce("end_x", "x").alias("x"), F.coalesce("end_y", "y").alias("y"))
    more = components(between, f"{name}-more")
    later = more.select(F.col("fp").alias("label"), F.col("label").alias("end"))
    moved = labels.join(later, "label", "left").select("fp", F.coalesce("end", "label").alias("label"))
    return written(moved.union(more.join(labels.select("fp"), "fp", "left_anti")), name)


def join(docs: DataFrame, rounds: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, labels): a row a row of docs with doc_id, n_shingles and fp; links between different sets
    (x, y, n_x, n_y, both) that hold every component of the relation together; the component (label) of every set
    (fp) that has a link."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    profile = written(_profile(texts), "profile")
    doubtful = _doubtful(profile)
    if doubtful:
        profile = written(_profile(texts, doubtful), "profile")
    common = most_frequent(profile.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where("n > 2"), "n", "a", FREQUENT).toArrow()
    hashes, counts = common["a"].to_numpy().view(np.uint64), common["n"].to_numpy()
    # ranks from rare to frequent; a long list is dealt out in parts of about LONG_LIST entries
    ranks = np.empty(len(hashes), np.int64)
    ranks[np.lexsort((hashes, counts))] = np.arange(len(hashes))
    order = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast((hashes[order], ranks[order], np.maximum(1, counts[order] // LONG_LIST).astype(np.int64)))

    in_list = Window.partitionBy("h", "part")
    # a set has one entry in a list; entries are shuffled as they are, as a window would add what it orders by
    indexed = _postings(texts, frequent, doubtful).withColumn("leader", F.min("entry").over(in_list)).withColumn("last", F.max("entry").over(in_list))
    lists = indexed.where("leader <> last OR part > 0").select("h", "part", "entry.fp", "entry.n", "entry.pos", "leader")
    lists = written(lists.distinct(), "lists")
    frequent.destroy()

    def candidates(df: DataFrame) -> DataFrame:
        """Pairs of (fp, n, pos) and leader; whole blocks of positions are skipped where their first can't do."""
        block = F.expr(f"pos div {BLOCK} * {BLOCK}")
        open_block = df.withColumn("block", block).where(possible("n", "block", "leader.n", "leader.pos"))
        kept = open_block.where(possible("n", "pos", "leader.n", "leader.pos") & (F.col("fp") != F.col("leader.fp")))
        return kept.select(F.col("fp").alias("x"), F.col("leader.fp").alias("y")).distinct()

    def unknown(pairs: DataFrame) -> DataFrame:
        """Pairs not compared yet, in either order."""
        seen = found.select("x", "y").union(found.select(F.col("y").alias("x"), F.col("x").alias("y")))
        return pairs.join(seen, ["x", "y"], "left_anti")

    def open_lists_of(turn: str, *found: Column) -> tuple[DataFrame, DataFrame]:
        """Entries with their components, and the lists whose sets are not all in one, with what is to be found of them."""
        known = F.broadcast(labels) if labels.count() <= LABELS else labels
        named = written(lists.join(known, "fp", "left").withColumn("label", F.coalesce("label", "fp")), f"named-{turn}")
        spread = named.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *found)
        return named, written(spread.where("lo <> hi").drop("lo", "hi"), f"spread-{turn}")

    found = _overlaps(texts, candidates(lists), doubtful, "0")
    labels = written(components(found.where(linked()), "labels-0"), "labels-1")
    for turn in range(1, rounds):
        # a list whose sets are all in one component is settled; in others, each part's components meet at new leaders
        named, spread = open_lists_of(str(turn), F.min(F.struct("pos", "fp", "n")).alias("lead"))
        spent, lists = lists, written(named.join(spread, "h").drop("label", "leader").withColumnRenamed("lead", "leader"), f"lists-{turn}")
        for table in (spent, named, spread):
            erased(table)
        fresh = _overlaps(texts, unknown(candidates(lists)), doubtful, str(turn))
        labels = _extended(labels, fresh.where(linked()), f"labels-{turn + 1}")
        found = found.union(fresh)
    named, spread = open_lists_of("last")
    erased(lists)
    known = found.select("x", "y", (F.col("both") / (F.col("n_x") + F.col("n_y") - F.col("both"))).alias("likeness"))
    to_leader = known.union(known.select(F.col("y").alias("x"), F.col("x").alias("y"), "likeness"))
    mixed_lists = named.join(spread, "h").select("h", "fp", "n", "pos", "label", F.col("leader.fp").alias("y"))
    near = mixed_lists.join(to_leader.select(F.col("x").alias("fp"), "y", "likeness"), ["fp", "y"], "left")
    near = written(near.withColumn("likeness", F.when(F.col("fp") == F.col("y"), 1.0).otherwise(F.col("likeness"))), "near")
    erased(named)
    erased(spread)
    other = near.select("h", *[F.col(c).alias(f"{c}_2") for c in ("fp", "n", "pos", "label", "likeness")])
    apart = 1 - PERCENT / 100 + 1e-9
    open_pair = (F.col("fp") < F.col("fp_2")) & (F.col("label") != F.col("label_2")) & possible("n", "pos", "n_2", "pos_2")
    told_apart = F.coalesce(F.abs(F.col("likeness") - F.col("likeness_2")) > apart, F.lit(False))
    pairs = near.join(other, "h").where(open_pair & ~told_apart).select(F.col("fp").alias("x"), F.col("fp_2").alias("y")).distinct()
    plausible = _plausible(profile, unknown(pairs), "last")
    erased(near)
    fresh = _overlaps(texts, plausible, doubtful, "last")
    erased(plausible)
    documents = profile.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("a").alias("fp"))
    return documents, found.union(fresh).where(linked()), _extended(labels, fresh.where(linked()), "labels-out")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for every row of docs (doc_id, text).

    A null or text without words has the empty set, is linked with nothing and is its own component. Texts of fewer
    than five words have their whole sequence as their one shingle. Rows with equal texts are linked, whatever their
    ids; rows with equal doc_id each keep a row; a null doc_id counts only where a component has no other. A table
    without rows gives none; other columns are ignored.
    """
    documents, _, labels = join(docs)
    named = documents.where("n_shingles > 0").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = written(named.select("doc_id", "n_shingles", "label"), "documents")
    lowest = written(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "components")
    alone = documents.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.join(lowest, "label").select("doc_id", "n_shingles", "component_id").union(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs' rows whose doc_id is their component's smallest; of rows with equal doc_id and text, one."""
    found = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(found, docs["doc_id"].eqNullSafe(found["kept_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


#: DuckDB SQL for the op5 query.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS rid,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, md5_number(array_to_string(ws[i + 1:i + least(len(ws), 5)], ' ')) AS g FROM w, unnest(range(0, greatest(len(ws) - 4, 1))) AS u(i) WHERE len(ws) > 0),
z AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN z AS zx ON zx.rid = x JOIN z AS zy ON zy.rid = y WHERE 100 * c >= 75 * (zx.n + zy.n - c)),
r AS (SELECT rid AS x, rid AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, min(v.doc_id) AS component_id
FROM w LEFT JOIN z ON z.rid = w.rid JOIN r ON r.x = w.rid JOIN w AS v ON v.rid = r.y GROUP BY w.rid, w.doc_id, z.n
"""
