"""Phrase collocations by contiguous pattern growth, PrefixSpan's projection without gaps.

1. Words are counted, then pairs of frequent words, as partial counts a task. A pair that is frequent is a prefix.
2. A prefix is projected: every occurrence gives a pointer, which is the occurrence's own next words as far as they
   can still be frequent (every pair in a frequent phrase is frequent). Equal pointers of a task are one row with a number.
3. One task has all pointers of a prefix, sorted. It grows the prefix to the right, depth first: the pointers that go
   on with one word are the projection of the longer prefix, and where they are too few, that branch ends.
4. A prefix with more than a 4,096th of all pairs is dealt out by its pointers: each branch's longest phrase stays whole in
   one task, and the counts of shorter ones are added up.

Words are 64-bit hashes of a word and its language, so phrases of languages never mix; the strings of the words that
matter are read at the end, and two words of one hash would be seen there.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm._common import bitmap, in_bitmap, small_batches, written
from granary.llm._words import hashes_of, mixed, spans_of, text_slices

_BYTES = np.arange(256)
#: Bytes that end a piece of text, and those that words don't have.
_BREAK = np.isin(_BYTES, list(b".,;:!?\n\x0b\x0c\r"))
_GAP = _BREAK | np.isin(_BYTES, list(b" \t"))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Words a phrase has at most.
LONGEST = 4
WORDS = tuple(f"w{i + 1}" for i in range(LONGEST))
#: Words of a task that are counted before their counts are sent on.
HELD = 1 << 21
#: A prefix with more than this part of all pairs is dealt out.
HOT = 1 << 12
#: Phrases that one task ranks at a time.
RANKED = 1 << 17


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(words, whether the next word follows in the same piece, language of each text, text of each word, bytes, starts, ends)."""
    marks: dict[str, int] = {}
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for lang in set(langs) - set(marks):
            marks[lang] = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
        for lo, hi, data, cuts in text_slices(batch["text"]):
            starts, ends = spans_of(cuts, ~_GAP[data])
            if not len(starts):
                continue
            row = np.searchsorted(cuts, starts, side="right") - 1
            mark = np.array([marks[x] for x in langs[lo:hi]], np.uint64)
            words = mixed(hashes_of(data, starts, ends) + mark[row])
            words[words == 0] = 1  # 0 stands for no word
            breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
            follows = np.zeros(len(words), bool)
            follows[:-1] = (row[1:] == row[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
            yield words, follows, langs[lo:hi], row, data, starts, ends


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Counter]]:
    """(words, follows, words of each language) of some million words at a time."""
    words, follows, totals, size = [], [], Counter(), 0
    for w, f, langs, row, *_ in _sliced(batches):
        words.append(w)
        follows.append(f)
        for lang, n in zip(langs, np.bincount(row, minlength=len(langs)).tolist(), strict=True):
            totals[lang] += n
        size += len(w)
        if size >= HELD:
            yield np.concatenate(words), np.concatenate(follows), totals
            words, follows, totals, size = [], [], Counter(), 0
    if words:
        yield np.concatenate(words), np.concatenate(follows), totals


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) * np.uint64(0x9E3779B97F4A7C15) + second)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n): each word's number, without its lang; and each lang's number of words, without a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, totals in _held(batches):
            kinds, n = np.unique(words, return_counts=True)
            lang = pa.concat_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(kinds), pa.string())])
            word = pa.concat_arrays([pa.nulls(len(totals), pa.int64()), _signed(kinds)])
            yield pa.RecordBatch.from_arrays([lang, word, pa.concat_arrays([pa.array(list(totals.values()), pa.int64()), pa.array(n)])], ["lang", "word", "n"])

    return texts.mapInArrow(count, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _bits(rows: int) -> int:
    """Bits of a bitmap for so many keys: some 16 a key, at most 2**30 (128 MB); a fuller one only lets more through."""
    return min(30, max(15, (16 * rows).bit_length()))


def _pair_counts(texts: DataFrame, frequent: Broadcast) -> DataFrame:
    """(pair, n): pairs of words that follow each other, both frequent, by a hash of the pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, follows, _ in _held(batches):
            ok = in_bitmap(frequent.value, words)
            at = np.flatnonzero(follows[:-1] & ok[:-1] & ok[1:])
            kinds, n = np.unique(_pair(words[at], words[at + 1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(kinds), pa.array(n)], ["pair", "n"])

    return texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _projected(texts: DataFrame, frequent: Broadcast, pairs: Broadcast, hot: Broadcast) -> DataFrame:
    """(dealt, w1 to w4, n): pointers of the prefixes (w1, w2), with their next words or 0, and whether the prefix is dealt out."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, follows, _ in _held(batches):
            ok = in_bitmap(frequent.value, words)
            at = np.flatnonzero(follows[:-1] & ok[:-1] & ok[1:])
            key = _pair(words[at], words[at + 1])
            at = at[in_bitmap(pairs.value, key)]
            prefix = np.zeros(len(words) + LONGEST, bool)
            prefix[at] = True
            padded = np.concatenate([words, np.zeros(LONGEST, np.uint64)])
            columns, on = [words[at], words[at + 1]], np.ones(len(at), bool)
            for k in range(2, LONGEST):
                on = on & prefix[at + k - 1]
                columns.append(np.where(on, padded[at + k], np.uint64(0)))
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(order)))
            columns = [c[first] for c in columns]
            dealt = np.isin(_pair(columns[0], columns[1]), hot.value)
            yield pa.RecordBatch.from_arrays([pa.array(dealt), *map(_signed, columns), pa.array(n)], ["dealt", *WORDS, "n"])

    return texts.mapInArrow(project, "dealt boolean, " + ", ".join(f"{c} long" for c in (*WORDS, "n")))


def _grown(pointers: DataFrame, hot: Broadcast, fewest: int) -> DataFrame:
    """(gram, f): the prefixes and what they grow to, at least fewest times, or any number for a dealt prefix's shorter ones."""

    def grow(words: list[np.ndarray], sums: np.ndarray, lo: int, hi: int, depth: int, dealt: bool, out: list) -> None:
        """Go on with each next word of the projection lo to hi, whose phrase has depth words."""
        following = words[depth]
        at = lo + np.concatenate([[0], 1 + np.flatnonzero(following[lo + 1 : hi] != following[lo : hi - 1])])
        ends = np.append(at[1:], hi)
        n = sums[ends] - sums[at]
        for i in np.flatnonzero((following[at] != 0) & ((n >= fewest) | (dealt and depth + 1 < LONGEST))).tolist():
            out.append((at[i], depth + 1, n[i]))
            if depth + 1 < LONGEST:
                grow(words, sums, at[i], ends[i], depth + 1, dealt, out)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in _then(batches):
            if batch is not None:
                columns = [batch[c].to_numpy() for c in names]
                rest = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            *words, n = rest
            at = np.concatenate([[0], 1 + np.flatnonzero((words[0][1:] != words[0][:-1]) | (words[1][1:] != words[1][:-1]))])
            ends = np.append(at[1:], len(n))
            if batch is not None:  # the last prefix may go on
                rest = [c[at[-1] :].copy() for c in rest]
                at, ends = at[:-1], ends[:-1]
            sums = np.concatenate([[0], np.cumsum(n)])
            total = sums[ends] - sums[at]
            dealt = np.isin(_pair(words[0][at].view(np.uint64), words[1][at].view(np.uint64)), hot.value)
            out: list[tuple[int, int, int]] = []
            for i in np.flatnonzero((total >= fewest) | dealt).tolist():
                out.append((at[i], 2, total[i]))
                grow(words, sums, at[i], ends[i], 2, bool(dealt[i]), out)
            if out:
                rows, lengths, f = (np.array(c, np.int64) for c in zip(*out, strict=True))
                flat = np.stack([w[rows] for w in words], axis=1)[np.arange(LONGEST) < lengths[:, None]]
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([grams, pa.array(f)], ["gram", "f"])

    names = [*WORDS, "n"]
    task = F.when(F.col("dealt"), F.xxhash64(*WORDS)).otherwise(F.xxhash64(*WORDS[:2]))
    partial = pointers.repartition(task).drop("dealt").sortWithinPartitions(*WORDS).mapInArrow(grown, "gram array<bigint>, f long")
    return partial.groupBy("gram").agg(F.sum("f").alias("f")).where(F.col("f") >= fewest)


def _then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def phrases(docs: DataFrame, fewest: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grams, words, totals) of docs (text, lang): every phrase of two to four words seen at least fewest times
    (gram: hashes of its words, f), every word (word, n), and the words of every lang (lang, n)."""
    spark = docs.sparkSession
    small_batches(spark, 1 << 16)
    context = spark.sparkContext
    texts = _texts(docs)
    counts = written(_word_counts(texts), "words")
    words, totals = counts.where("word IS NOT NULL").select("word", "n"), counts.where("word IS NULL").select("lang", "n")
    often = words.where(F.col("n") >= fewest)
    frequent = context.broadcast(bitmap(often, "word", _bits(often.count())))
    pairs = _pair_counts(texts, frequent)
    pairs = written(pairs.where(F.col("n") >= fewest), "pairs")
    n_pairs, all_pairs = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = pairs.where(F.col("n") > max(HELD, all_pairs) // HOT).select("pair").toArrow()["pair"].to_numpy().view(np.uint64)
    hot, prefixes = context.broadcast(hot), context.broadcast(bitmap(pairs, "pair", _bits(n_pairs)))
    grams = written(_grown(_projected(texts, frequent, prefixes, hot), hot, fewest), "grams")
    for spent in (frequent, hot, prefixes):
        spent.unpersist()
    return grams, words, totals


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))


def _strings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, spelled, lang) of words (word)."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bitmap(words, "word", _bits(words.count())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for keys, _, langs, row, data, starts, ends in _sliced(batches):
            kinds, first = np.unique(keys, return_index=True)
            keep = in_bitmap(wanted.value, kinds) & ~np.isin(kinds, seen)
            kinds, first = kinds[keep], first[keep]
            if not len(kinds):
                continue
            seen = kinds if len(seen) > HELD else np.union1d(seen, kinds)
            lengths = ends[first] - starts[first]
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            spelled = _LOWER[data[np.repeat(starts[first] - cuts[:-1], lengths) + np.arange(cuts[-1])]]
            spelled = pa.Array.from_buffers(pa.string(), len(kinds), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(spelled.tobytes())])
            yield pa.RecordBatch.from_arrays([_signed(kinds), spelled, pa.array(langs, pa.string()).take(pa.array(row[first]))], ["word", "spelled", "lang"])

    found = _texts(docs).mapInArrow(read, "word long, spelled string, lang string")
    value = F.struct("lang", "spelled")
    both = found.groupBy("word").agg(F.min(value).alias("value"), F.max(value).alias("other"))
    one = F.when(F.col("value") == F.col("other"), F.col("value")).otherwise(F.raise_error(F.lit("two words have one hash")))
    return both.select("word", one.alias("value")).select("word", "value.*")


def _scored(asking: DataFrame, grams: DataFrame, words: DataFrame, fewest: int) -> DataFrame:
    """The grams that ask with l, r and score of their lowest-scoring cut. Counts of the parts come by one join, whose hot words are
    split by Spark: of a frequent word no more phrases ask than are frequent."""
    cuts = F.expr("flatten(transform(sequence(1, size(gram) - 1), k -> array(struct(k, 0 AS side, slice(gram, 1, k) AS part), struct(k, 1 AS side, slice(gram, k + 1, size(gram) - k) AS part))))")
    asked = asking.select("gram", "f", F.explode(cuts).alias("c")).select("gram", "f", "c.*")
    known = grams.select(F.col("gram").alias("part"), F.col("f").alias("m")).union(words.where(F.col("n") >= fewest).select(F.array("word"), "n"))
    found = asked.join(known, "part").groupBy("gram", "f").agg(F.collect_list(F.struct("k", "side", "m")).alias("parts"))
    side = lambda s: f"aggregate(filter(parts, p -> p.k = k AND p.side = {s}), 0L, (a, p) -> p.m)"
    of_cuts = found.withColumn("cuts", F.expr(f"transform(sequence(1, size(gram) - 1), k -> struct(k, {side(0)} AS l, {side(1)} AS r))"))
    score = "CAST((CAST(2000000 AS DECIMAL(7, 0)) * CAST(f AS DECIMAL(20, 0))) div (CAST(c.l AS DECIMAL(20, 0)) + CAST(c.r AS DECIMAL(20, 0))) AS bigint)"
    best = F.array_min(F.expr(f"transform(cuts, c -> struct({score} AS score, c.k AS k, c.l AS l, c.r AS r))"))
    return of_cuts.select("gram", "f", best.alias("best")).select("gram", "f", "best.l", "best.r", "best.score")


def _outside(grams: DataFrame, percent: int) -> DataFrame:
    """grams without those inside a longer one that has at least percent of their number."""
    inner = "flatten(transform(sequence(2, size(gram) - 1), m -> transform(sequence(1, size(gram) - m + 1), i -> slice(gram, i, m))))"
    longer = grams.where("size(gram) > 2").select(F.explode(F.expr(inner)).alias("gram"), F.lit(None).cast("long").alias("f"), F.col("f").alias("longer"))
    both = grams.select("gram", "f", F.lit(None).cast("long").alias("longer")).union(longer).groupBy("gram").agg(F.max("f").alias("f"), F.max("longer").alias("longer"))
    kept = F.col("longer").isNull() | (F.lit(100).cast("decimal(4,0)") * F.col("longer") < F.lit(percent).cast("decimal(4,0)") * F.col("f"))
    return both.where(kept).select("gram", "f")


def _first(found: DataFrame, most: int) -> DataFrame:
    """Each lang's first rows with their rank. Parts of a lang are ranked first, in as many turns as leave parts of bounded size."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.count() // RANKED
    while parts > 1:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most).drop("rank")
        parts = parts * most // RANKED
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, fewest: int = 30, most: int = 2000, percent: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first collocations by score, then number, then phrase.

    docs has text and lang; other columns are ignored. A null text is empty, a null lang ``und``; texts without words
    give nothing, and so does a table without rows. Every row counts, also repeated ones. Ties go to the larger number, then
    to the phrase that comes first in the order of its bytes. Long texts are read whole, one at a time.
    """
    grams, words, totals = phrases(docs, fewest)
    kept = written(_scored(_outside(grams, percent), grams, words, fewest), "kept")
    named = _strings(docs, kept.select(F.explode("gram").alias("word")).distinct())
    spread = kept.select("*", F.posexplode("gram").alias("i", "word")).join(named, "word")
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "spelled"))), lambda x: x["spelled"]), " ")
    found = spread.groupBy("gram", "f", "l", "r", "score").agg(F.min("lang").alias("lang"), spelled.alias("phrase"))
    found = written(found.select("lang", "phrase", F.col("f").alias("a"), "l", "r", "score"), "spelled")
    return _first(found, most).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for the op11 query.
ORACLE = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, ws[i:i + k - 1] AS g, count(*) AS c FROM w, unnest(range(1, 5)) AS u(k), unnest(range(1, len(ws) - k + 2)) AS v(i) GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT x.lang, x.g, x.c AS a, k, l.c AS l, r.c AS r, ((2000000::HUGEINT * x.c) // (l.c + r.c))::BIGINT AS score
  FROM f AS x, unnest(range(1, len(x.g))) AS u(k) JOIN f AS l ON l.lang = x.lang AND l.g = x.g[1:k] JOIN f AS r ON r.lang = x.lang AND r.g = x.g[k + 1:len(x.g)]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, g[i:i + m - 1] AS g, max(c) AS longer FROM f, unnest(range(2, len(g))) AS u(m), unnest(range(1, len(g) - m + 2)) AS v(i) GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.g = best.g
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
