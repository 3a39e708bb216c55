"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

A word of n code points, padded by one mark on either side, has n + 1 grams of two code points, each at a place. One edit
destroys at most two grams of the longer word, so words one edit apart share at least n - 1 of them (n: the longer
one's length): at the same place before the edit, and behind it at the same place or, if a code point is missing, at the
one before. Grams are ordered from rare to frequent, then by place; this order is the same on both sides.

So of the grams that two near words share, the first two in that order are among the first four of the longer word and
the first three of one that lacks a code point. These pairs of grams with their places (and the length) name the index
lists. A list merges the postings of both its grams: it has the words that share them, and every two near words meet in
exactly one list whose grams are their first two shared ones. A list that is still long is merged with the postings of a
next gram, and so on, so words are compared only where enough of their grams agree. What is left is held against the
bound on the number of shared grams, then verified.

Lists are dealt out by their names. Where many words share two grams, their lists are named by three or more before they
are shuffled, so that no task gets more than a small part of the postings.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import erased, small_batches, written
from granary.llm._words import mixed

#: Words are in Latin-1, so a byte there is a code point: letters of either case become lower-case ones, others blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Code points a word has at least, occurrences it has at least, and the divisor of hashes that mark a slip.
SHORTEST, FEWEST, SLIP = 5, 3, 97
#: Distinct words of a task whose counts are held before they are sent on.
HELD = 1 << 18
#: Grams that one edit destroys at most, of the longer word and of one that lacks a code point.
LOST = (2, 1)
#: Postings of a list that are compared with each other; longer lists are merged with a next gram first.
LIST = 128
#: Hashes of lists are counted in so many slots; lists of a slot with over SLOT_SHARE of the mean are split.
SLOTS, SLOT_SHARE, SLOT_LEAST = 1 << 16, 4, 1 << 14
#: Code points of words that are compared at a time.
COMPARED = 1 << 22


def counted(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(word, n): words of docs (doc_id, text) with slips, of at least SHORTEST code points, seen at least fewest times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                first = zlib.crc32(f"{doc_id}:".encode())
                found = Counter(w for w in text.as_py().encode("latin-1", "replace").translate(_LETTERS).split() if len(w) >= SHORTEST)
                for word, n in found.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), first)
                    if h % SLIP == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < SHORTEST:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield _counts(held)
                    held = Counter()
        if held:
            yield _counts(held)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def _counts(held: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their code points as bytes) of the words of each length, some MB at a time."""
    words = [w.encode("latin-1") for w in column.to_pylist()]
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths).tolist():
        rows, step = np.flatnonzero(lengths == n), max(1, COMPARED // (n + 1))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            yield part, np.frombuffer(b"".join(words[i] for i in part.tolist()), np.uint8).reshape(len(part), n)


def _grams(letters: np.ndarray) -> np.ndarray:
    """The grams of words of one length, padded by 0 on either side, a row a word."""
    padded = np.pad(letters, ((0, 0), (1, 1))).astype(np.int32)
    return padded[:, :-1] << 8 | padded[:, 1:]


def gram_counts(words: DataFrame) -> np.ndarray:
    """Occurrences in words (word) of each of the 2**16 grams there can be."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, letters in _by_length(batch["word"]):
                total += np.bincount(_grams(letters).ravel(), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(1 << 16, np.int64)
    found = words.select("word").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out[found["gram"].to_numpy()] = found["n"].to_numpy()
    return out


class _Postings:
    """Postings of words of one length on one side: role 0 as they are, role 1 as words that lack a code point of one
    longer. Each has the name of its list so far, its word's row, how far it is in the order of its grams (next) and where
    there it skipped grams (-1: nowhere)."""

    fields = ("row", "name", "next", "skips")

    def __init__(self, letters: np.ndarray, role: int, ranks: np.ndarray) -> None:
        m, n = letters.shape
        self.role, self.length = role, n + role
        self.grams = _grams(letters)
        self.order = np.argsort(ranks[self.grams] << 24 | np.arange(n + 1), axis=1, kind="stable")
        self.row, self.next = np.arange(m), np.zeros(m, np.int64)
        self.name, self.skips = np.full(m, self.length, np.uint64), np.full((m, 2), -1)

    def having(self, parts: list[tuple[np.ndarray, ...]]) -> _Postings:
        out = object.__new__(_Postings)
        out.role, out.length, out.grams, out.order = self.role, self.length, self.grams, self.order
        for name, values in zip(self.fields, zip(*parts, strict=True), strict=True):
            setattr(out, name, np.concatenate(values))
        return out

    def picked(self, at: np.ndarray) -> _Postings:
        return self.having([tuple(getattr(self, name)[at] for name in self.fields)])

    def shared(self) -> np.ndarray:
        """Grams that the postings' lists are named by."""
        return self.next - (self.skips >= 0).sum(axis=1)

    def merged(self) -> _Postings:
        """All postings with one more gram: the next in the order, or one after it while not too many are skipped. A word
        that lacks a code point has a gram at its place or the one behind, but is in a list once."""
        parts = []
        for skip in range(LOST[self.role] + 1):
            lost = (self.skips >= 0).sum(axis=1)
            at = np.flatnonzero((lost + skip <= LOST[self.role]) & (self.next + skip < self.grams.shape[1]))
            row, skips = self.row[at], self.skips[at].copy()
            for k in range(skip):
                skips[np.arange(len(at)), lost[at] + k] = self.next[at] + k
            place = self.order[row, self.next[at] + skip]
            for shift in (0, 1)[: self.role + 1]:
                named = self.name[at] * np.uint64(0x9E3779B97F4A7C15) + (self.grams[row, place].astype(np.uint64) << np.uint64(32))
                parts.append((row, mixed(named + (place + shift).astype(np.uint64)), self.next[at] + skip + 1, skips))
        out = self.having(parts)
        if self.role:
            order = np.lexsort((out.row, out.name))
            row, name = out.row[order], out.name[order]
            out = out.picked(order[np.concatenate([[True], (row[1:] != row[:-1]) | (name[1:] != name[:-1])])] if len(order) else order)
        return out


def _posted(letters: np.ndarray, role: int, ranks: np.ndarray, hot: np.ndarray) -> Iterator[_Postings]:
    """The postings of words: on two grams, or on more where hot has the slot of their list."""
    if letters.shape[1] + role <= SHORTEST and role:
        return  # no word is so short
    p = _Postings(letters, role, ranks).merged().merged()
    while True:
        more = hot[_slot(p.name)] & (p.shared() < p.length - 1)
        yield p.picked(np.flatnonzero(~more))
        if not more.any():
            return
        p = p.picked(np.flatnonzero(more)).merged()


def _slot(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(48)).astype(np.int64)


_ROWS = "list long, role int, length int, word string, n long, next int, skip1 int, skip2 int"


def _lists(words: DataFrame, ranks: Broadcast, hot: Broadcast) -> DataFrame:
    """The postings of words (word, n)."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, letters in _by_length(batch["word"]):
                for role in (0, 1):
                    for p in _posted(letters, role, ranks.value, hot.value):
                        at, small = pa.array(rows[p.row]), lambda v: pa.array(v.astype(np.int32))
                        fixed = [pa.array(np.full(len(p.row), v, np.int32)) for v in (role, p.length)]
                        places = [small(p.next), small(p.skips[:, 0]), small(p.skips[:, 1])]
                        yield pa.RecordBatch.from_arrays([pa.array(p.name.view(np.int64)), *fixed, batch["word"].take(at), batch["n"].take(at), *places], names)

    names = [c.split()[0] for c in _ROWS.split(", ")]
    return words.select("word", "n").mapInArrow(post, _ROWS)


def _hot_slots(words: DataFrame, ranks: Broadcast, least: int) -> np.ndarray:
    """The slots of lists that have more than a small part of all postings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, none = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, bool)
        for batch in batches:
            for _, letters in _by_length(batch["word"]):
                for role in (0, 1):
                    for p in _posted(letters, role, ranks.value, none):
                        total += np.bincount(_slot(p.name), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "m"])

    found = words.select("word").mapInArrow(count, "slot int, m long").groupBy("slot").agg(F.sum("m").alias("m")).toArrow()
    out, m = np.zeros(SLOTS, bool), found["m"].to_numpy()
    out[found["slot"].to_numpy()] = m > max(least, SLOT_SHARE * m.sum() / SLOTS)
    return out


def _near(sides: list[_Postings], letters: np.ndarray, first: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of letters) of words one edit apart that meet in the lists of postings of one length: rows of role 0 come
    first, then, from ``first`` on, those of role 1, padded by 0."""
    n = letters.shape[1]
    row = np.concatenate([p.row + first * p.role for p in sides])
    name, role = np.concatenate([p.name for p in sides]), np.concatenate([np.full(len(p.row), p.role) for p in sides])
    order = np.lexsort((role, name))
    at = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
    end = np.repeat(np.append(at[1:], len(order)), np.diff(np.append(at, len(order))))
    size = end - np.repeat(at, np.diff(np.append(at, len(order))))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    shared = np.concatenate([p.shared() for p in sides])
    long = (size[place] > longest) & (shared < n - 1)
    if long.any():
        cut = len(sides[0].row)
        yield from _near([p.picked(np.flatnonzero(x)).merged() for p, x in zip(sides, (long[:cut], long[cut:]), strict=True)], letters, first, longest)
    # in a list, a word as it is meets all that come behind it
    mine = order[(role[order] == 0) & ~long[order]]
    partners = end[place[mine]] - place[mine] - 1
    mine, partners = mine[partners > 0], partners[partners > 0]
    ends, most, lo = np.cumsum(partners), max(1, COMPARED // n), 0
    while lo < len(mine):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        x = np.repeat(mine[lo:hi], partners[lo:hi])
        ahead = np.arange(len(x)) - np.repeat(np.concatenate([[0], np.cumsum(partners[lo:hi])[:-1]]), partners[lo:hi])
        yield from _verified(sides[0], letters, x, order[place[x] + 1 + ahead], row, role)
        lo = hi


def _verified(p: _Postings, letters: np.ndarray, x: np.ndarray, y: np.ndarray, row: np.ndarray, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of pairs of postings (x of role 0): rows of those with enough shared grams, one edit apart, whose first shared grams name their list."""
    n = letters.shape[1]
    for kind in (0, 1):
        a, b = x[role[y] == kind], y[role[y] == kind]
        if not len(a):
            continue
        one, other = letters[row[a]], letters[row[b]]
        if kind == 0:
            same = np.pad(one == other, ((0, 0), (1, 1)), constant_values=True)
            keep = np.flatnonzero((same[:, 1:] & same[:, :-1]).sum(axis=1) >= n - 1)
            at = np.argmin(same[keep, 1:-1], axis=1)
            true = (~same[keep]).sum(axis=1) == 1
        else:  # shared grams stand at the same place before the missing code point, and one place on behind it
            head = np.logical_and.accumulate(one[:, :-1] == other[:, :-1], axis=1).sum(axis=1)
            tail = np.logical_and.accumulate((one[:, 1:] == other[:, :-1])[:, ::-1], axis=1).sum(axis=1)
            keep = np.flatnonzero(head + tail >= n - 1)
            at = head[keep]
            true = (one[keep, at + 1 - (at == n - 1)] == other[keep, np.minimum(at, n - 2)]) | (at == n - 1)
        a, b = a[keep], b[keep]
        for k in range(int(p.next[a].max(initial=0))):  # lost grams are skipped, and only they
            place = p.order[p.row[a], np.minimum(k, n)]
            lost = (place == at) | (place == at + 1)
            true &= (k >= p.next[a]) | (lost == (p.skips[a] == k).any(axis=1))
        yield row[a[true]], row[b[true]]


def near_pairs(words: DataFrame, longest: int = LIST, slot_least: int = SLOT_LEAST) -> DataFrame:
    """(word, near, m): both directions of every pair of words (word, n) that differ by exactly one inserted, deleted or
    replaced code point, with the other's n."""
    spark = words.sparkSession
    ranks = spark.sparkContext.broadcast(gram_counts(words))
    hot = spark.sparkContext.broadcast(_hot_slots(words, ranks, slot_least))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in _then(batches):
            if batch is not None:
                rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
                if rest.num_rows < 1 << 16:
                    continue
            if rest is None or not rest.num_rows:
                continue
            names = rest["list"].to_numpy()
            cut = len(names) if batch is None else int(np.flatnonzero(names != names[-1])[-1:].sum() + (names != names[-1]).any())
            whole, rest = rest.slice(0, cut).combine_chunks(), rest.slice(cut)
            if cut:
                yield from _pairs_of(whole, ranks.value, longest)

    found = _lists(words, ranks, hot).repartition("list").sortWithinPartitions("list")
    return found.mapInArrow(pair, "word string, near string, m long")


def _then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def _pairs_of(table: pa.Table, ranks: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """The pairs that meet in whole lists."""
    lengths = table["length"].to_numpy()
    roles = table["role"].to_numpy()
    words, n = table["word"], table["n"]
    for length in np.unique(lengths).tolist():
        sides, letters, rows = [], [], []
        for role in (0, 1):
            at = np.flatnonzero((lengths == length) & (roles == role))
            size = length - role
            some = np.frombuffer(b"".join(w.encode("latin-1") for w in words.take(at).to_pylist()), np.uint8).reshape(len(at), size)
            p = _Postings(some, role, ranks)
            take = lambda name, at=at: table[name].to_numpy()[at]
            p.name, p.next = take("list").view(np.uint64), take("next").astype(np.int64)
            p.skips = np.stack([take("skip1"), take("skip2")], axis=1).astype(np.int64)
            sides.append(p)
            letters.append(np.pad(some, ((0, 0), (0, role))))
            rows.append(at)
        if not len(rows[0]) or len(rows[0]) + len(rows[1]) < 2:
            continue
        found = list(_near(sides, np.concatenate(letters), len(rows[0]), longest))
        if found:
            place = np.concatenate(rows)
            a, b = (pa.array(place[np.concatenate(v)]) for v in zip(*found, strict=True))
            both = [pa.concat_arrays([x, y]) for x, y in ((a, b), (b, a))]
            columns = [words.take(both[0]), words.take(both[1]), n.take(both[1])]
            yield from pa.table(columns, names=["word", "near", "m"]).combine_chunks().to_batches()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the end of each word's chain. Chains end, as a form has twice its word's n;
    each turn doubles how far a word sees, so a chain of k words takes log2(k) turns."""
    ends, turn, moved = written(forms.select("word", F.col("form").alias("root")), "roots-0"), 0, True
    while moved:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("end"))
        further = ends.join(ahead, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved"))
        turn += 1
        spent, further = ends, written(further, f"roots-{turn}")
        erased(spent)
        moved, ends = not further.where("moved").isEmpty(), further.drop("moved")
    return ends


def variants(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text); other columns are ignored.

    A null text has no words, a null doc_id hashes as ``null``. Every row counts, repeated ones too. A word's form is its
    near word of largest n, of several the first in code-point order, if that n is at least twice the word's. A table
    without rows gives none. Long texts are read whole, one at a time.
    """
    small_batches(docs.sparkSession, 1 << 14)
    words = written(counted(docs, fewest), "words")
    best = F.min(F.struct((-F.col("m")).alias("m"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    named = words.join(near, "word", "left")
    is_form = -F.col("best.m") >= 2 * F.col("n")
    forms = named.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"),
    )
    forms = written(forms, "forms")
    found = forms.join(roots(forms.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
