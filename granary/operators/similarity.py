"""Copied phrases, word frequencies and overlap between texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import bound, folded_lists, folded_tokens, jaccard, ngrams, percent, tokens


def _hash(words: Column) -> Column:
    """A hash of words by their hashes."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _hashes(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, at, h): a hash of every window of n folded tokens of a text."""
    starts = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    hashes = bound(_hash(folded_tokens(F.col(text))), lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i + 1, n))))
    return df.select(key, F.posexplode(hashes).alias("at", "h"))


def _spelt(df: DataFrame, key: str, text: str, n: int, hits: DataFrame) -> DataFrame:
    """(key, at, h, phrase) of hits (key, at, h); texts are read again for the rows that have some."""
    listed = hits.groupBy(key).agg(F.collect_set(F.struct("at", "h")).alias("hits"))
    both = F.struct(folded_tokens(F.col(text)).alias("words"), F.col("hits"))
    spell = lambda p: F.transform(p["hits"], lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), F.slice(p["words"], x["at"] + 1, n).alias("words")))
    found = df.select(key, text).join(listed, key).select(key, F.explode(bound(both, spell)).alias("x"))
    # rows with the same key have other words in a place
    return found.where(F.xxhash64(_hash(F.col("x.words"))) == F.col("x.h")).select(key, "x.at", "x.h", F.array_join("x.words", " ").alias("phrase"))


def copied_phrases(sources: DataFrame, finals: DataFrame, key: str, final_key: str, n: int = 8) -> DataFrame:
    """For each pair that shares n-grams (folded tokens): how many distinct ones, and the first in the final's order.

    Windows meet by hash, as longs; only those that do are spelt out and compared.
    """
    a, b = _hashes(sources, key, "text", n), _hashes(finals, final_key, "text", n)
    held = a.join(b.select("h").distinct(), "h", "left_semi")
    shared = b.join(held.select("h").distinct(), "h", "left_semi")
    left = _spelt(sources, key, "text", n, held).select(key, "h", "phrase").distinct()
    right = _spelt(finals, final_key, "text", n, shared).withColumnRenamed("at", "pos")
    met = left.join(right, ["h", "phrase"])
    return met.groupBy(key, final_key).agg(F.count_distinct("phrase").alias("n_shared"), F.min_by("phrase", "pos").alias("first_phrase"))


def word_counts(df: DataFrame, text: str, least: int = 1, stopwords: list[str] = ()) -> DataFrame:
    words = df.select(F.explode(tokens(F.col(text))).alias("word")).where((F.length("word") >= least) & ~F.col("word").isin(list(stopwords) or [""]))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, by: str, name: str, k: int = 25) -> DataFrame:
    """The k largest, ties by name."""
    return df.orderBy(F.col(by).desc(), name).limit(k)


def removed_words(pairs: DataFrame, source: str, final: str, least: int = 4, stopwords: list[str] = ()) -> DataFrame:
    """Counts of source words that the same row's final text does not have."""
    held = lambda words: F.filter(tokens(F.col(source)), lambda w: (F.length(w) >= least) & ~w.isin(list(stopwords) or [""]) & ~F.array_contains(words, w))
    gone = bound(tokens(F.col(final)), held)
    return pairs.select(F.explode(gone).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def change_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.floor((after / before - 1) * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


def trigram_percent(a: Column, b: Column) -> Column:
    return percent(jaccard(ngrams(folded_tokens(a), 3), ngrams(folded_tokens(b), 3)))


def max_step_percent(left: Column, right: Column) -> Column:
    """The largest trigram overlap between any step of two arrays of texts; 0 if either has none."""
    a, b = (F.transform(F.coalesce(folded_lists(c), F.array().cast("array<string>")), lambda x: ngrams(tokens(x), 3)) for c in (left, right))
    best = lambda p: F.array_max(F.transform(p["a"], lambda x: F.array_max(F.transform(p["b"], lambda y: percent(jaccard(x, y))))))
    return F.coalesce(bound(F.struct(a.alias("a"), b.alias("b")), best), F.lit(0.0))


def terms_in(texts: DataFrame, key: str, text: str, terms: DataFrame, most: int = 1 << 22) -> DataFrame:
    """(key, term): terms (column term) that a text holds as whole words.

    All terms are looked for in one pass over a text by an Aho-Corasick automaton over folded words, however long and
    many they are. An automaton has terms of ``most`` characters at most; more terms are dealt to several of them, each
    with a pass of its own.
    """
    folded = terms.select("term", F.array_join(folded_tokens(F.col("term")), " ").alias("folded")).where("folded <> ''").distinct()
    wanted = folded.groupBy("folded").agg(F.collect_set("term").alias("terms"))
    blocks = -(-(wanted.agg(F.sum(F.length("folded") + 2).alias("n")).first()["n"] or 0) // most)
    padded = texts.select(key, F.concat(F.lit(" "), F.array_join(folded_tokens(F.col(text)), " "), F.lit(" ")).alias("_padded"))
    kind = texts.schema[key].dataType
    found = texts.sparkSession.createDataFrame([], f"`{key}` {kind.simpleString()}, term string")
    for block in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("folded"), F.lit(blocks)) == block).toArrow().to_pylist()
        named = texts.sparkSession.sparkContext.broadcast({r["folded"]: sorted(r["terms"]) for r in mine})
        found = found.union(padded.mapInArrow(_finder(key, named), f"`{key}` {kind.simpleString()}, term string"))
    return found.distinct()


def _finder(key: str, named: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for folded, names in named.value.items():
            automaton.add_word(f" {folded} ", names)
        automaton.make_automaton()
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch["_padded"]):
                for name in {name for _, names in automaton.iter(text.as_py()) for name in names} if len(automaton) else ():
                    at.append(i)
                    out.append(name)
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(at, pa.int64())), pa.array(out, pa.string())], [key, "term"])

    return find
