"""A probabilistic suffix tree over words.

Symbols are all tokens of the training corpus, the end of a text, and its start as a context. Contexts of growing
length are counted over the whole training corpus, one pass a length. A context stays if it is frequent enough, its
suffix stays, and a G test says that what follows it diverges from what follows its suffix. A state's next-symbol
distribution is smoothed: what symbols have that it does not list, and a symbol's worth for each kind that it lists
(Witten-Bell), goes by the suffix's distribution, and at the root by the base distribution, in which all unknown
tokens are one more kind. Scoring uses the longest suffix state of each place.

A pass's pairs of context and next symbol are counted in each task, packed by bucket as arrays and merged bucket by
bucket; a bucket has the pairs of its own contexts, and those of a context that is met very often are dealt to all
buckets by their symbols. Contexts and counts are tables that grow with the corpus; the least counts are fixed.

As a symbol that a state does not list has the suffix's probability times a weight of the state, a place's log
probability is that of the base plus a weight for each state on its way and a gain for each listed symbol. So a text
is scored by sums over a table of (key, value), joined with the keys of its places. What is broadcast only saves
shuffling: the hot tokens and hot values, a quarter of all and at most ``hot_size`` and ``hot_values``, and Bloom
filters of fixed size that tell which keys can't be in a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm._common import erased, most_frequent, small_batches, written
from granary.llm._words import mixed, text_slices, words_of

END = np.uint64(0x5851F42D4C957F2D)
#: Start of a text.
START = np.uint64(0x2545F4914F6CDD1D)
#: A context's weight has the context's key with these bits turned.
WEIGHT = 0x6A09E667F3BCC909
HOT, HOT_VALUES, DEPTH = 1 << 19, 1 << 20, 3
#: A context is seen this often, a listed symbol after it that often, however large the corpus.
FEWEST, LEAST = 16, 8
#: Bits of a Bloom filter's slots.
SLOTS = 26
#: Places that a task counts at once; a bucket's share of all tokens; how often a context is met whose pairs are dealt out.
CHUNK, BUCKET, OFTEN = 1 << 20, 1 << 21, 1 << 20


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with an end after each text, cuts) slice by slice."""
    for lo, hi, data, cuts in text_slices(column):
        hashes, at = words_of(data, cuts)
        lengths = np.diff(at) + 1
        ends = np.cumsum(lengths)
        out = np.full(ends[-1], END, dtype=np.uint64)
        keep = np.ones(len(out), dtype=bool)
        keep[ends - 1] = False
        out[keep] = hashes
        yield lo, hi, out, np.concatenate([[0], ends])


class Index:
    """Places of 64-bit hashes in a sorted array, found by their highest bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(1, len(hashes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the key is there)."""
        slot = (keys >> self.shift).astype(np.int64)
        at, end, hit = self.starts[slot], self.starts[slot + 1], np.zeros(len(keys), dtype=bool)
        todo = np.flatnonzero(at < end)
        while len(todo):
            held, wanted = self.hashes[at[todo]], keys[todo]
            hit[todo[held == wanted]] = True
            todo = todo[(held < wanted) & (at[todo] + 1 < end[todo])]
            at[todo] += 1
        return at, hit


class Hot(Index):
    """The most frequent tokens with the logarithms of their base probabilities."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, kinds: int):
        order = np.argsort(hashes)
        super().__init__(hashes[order])
        self.total, self.kinds = total, kinds
        self.log_base = np.log10((counts[order] + 0.5) / (total + 0.5 * (kinds + 1)))


def _grams(tokens: np.ndarray, cuts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each context length up to depth: (keys of contexts, of contexts with their next symbols, of the latter without
    their first symbols) of the places that have one. A context reaches back to the start of a text at most, one symbol."""
    place = np.arange(len(tokens)) - np.repeat(cuts[:-1], np.diff(cuts))
    shorter = tokens
    for d in range(1, depth + 1):
        context = np.empty_like(shorter)
        context[1:] = shorter[:-1]
        if d == 1:
            context[place == 0] = START
        key = _key(context, shorter, d)
        there = place >= d - 1
        yield context[there], key[there], shorter[there]
        shorter = key


def _key(context: np.ndarray, sub: np.ndarray, depth: int) -> np.ndarray:
    return mixed(context * np.uint64(0x9E3779B97F4A7C15) + mixed(sub + np.uint64(depth)))


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys >> np.uint64(64 - SLOTS), keys >> np.uint64(8) & np.uint64((1 << SLOTS) - 1)


def _filter(keys: DataFrame) -> Broadcast:
    """A Bloom filter of keys (key), of fixed size; where it fills up, more is shuffled than needed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = np.zeros(1 << SLOTS, dtype=bool), False
        for batch in batches:
            for slots in _slots(batch["key"].to_numpy().view(np.uint64)):
                table[slots] = True
            some |= batch.num_rows > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())], ["bits"])

    table = np.zeros(1 << SLOTS >> 3, dtype=np.uint8)
    for row in keys.select("key").coalesce(4).mapInArrow(pack, "bits binary").toLocalIterator():
        table |= np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def _may_be_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that the filter's table can't have had."""
    out = np.ones(len(keys), dtype=bool)
    for slots in _slots(keys):
        out &= (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _emitted(parts: list[np.ndarray]) -> pa.RecordBatch:
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "c"])


def token_counts(texts: DataFrame) -> DataFrame:
    """(key, c): counts of all tokens of a text column without nulls, as hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, tokens, _ in _tokens(batch["text"]):
                held.append(tokens)
                size += len(tokens)
                if size >= 1 << 23:
                    yield _emitted(held)
                    held, size = [], 0
        if held:
            yield _emitted(held)

    return texts.select("text").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _summed(context: np.ndarray, sub: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of their contexts, with their counts added up."""
    order = np.lexsort((sub, context))
    context, sub = context[order], sub[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (context[1:] != context[:-1]) | (sub[1:] != sub[:-1])
    at = np.flatnonzero(new)
    return context[at], sub[at], np.add.reduceat(c[order], at) if len(at) else c[:0]


def _packed(context: np.ndarray, sub: np.ndarray, c: np.ndarray) -> bytes:
    """Pairs in the order of their contexts: numbers of contexts and pairs, contexts, their numbers of pairs, symbols, counts."""
    at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    runs = np.diff(np.append(at, len(context)))
    parts = (np.array([len(at), len(sub)], "<u4"), context[at].astype("<u8"), runs.astype("<u4"), sub.astype("<u8"), c.astype("<u4"))
    return b"".join(x.tobytes() for x in parts)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, n = np.frombuffer(blob, "<u4", 2).astype(int)
    context, runs = np.frombuffer(blob, "<u8", m, 8), np.frombuffer(blob, "<u4", m, 8 + 8 * m)
    return np.repeat(context, runs), np.frombuffer(blob, "<u8", n, 8 + 12 * m), np.frombuffer(blob, "<u4", n, 8 + 12 * m + 8 * n).astype(np.int64)


def _grown(texts: DataFrame, contexts: Broadcast, subs: Broadcast, often: Broadcast, depth: int, least: int, buckets: int) -> DataFrame:
    """(key, context, sub, c): pairs of a context of length depth and its next symbol that are seen least times or more;
    sub is the key without its first symbol. Contexts and subs are filters of those that a pair may have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt, held, size = often.value, [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            context, sub = (np.concatenate(x) for x in zip(*held, strict=True))
            context, sub, c = _summed(context, sub, np.ones(len(sub), np.int64))
            place = context
            if len(dealt):
                at = np.minimum(np.searchsorted(dealt, context), len(dealt) - 1)
                place = np.where(dealt[at] == context, sub, context)
            bucket = mixed(place) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            for lo in range(0, buckets, 16):
                some = [k for k in range(lo, min(lo + 16, buckets)) if cuts[k + 1] > cuts[k]]
                blobs = [_packed(*(x[order[cuts[k] : cuts[k + 1]]] for x in (context, sub, c))) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for _, _, tokens, cuts in _tokens(batch["text"]):
                for d, (context, _, sub) in enumerate(_grams(tokens, cuts, depth), 1):
                    if d == depth:
                        at = np.flatnonzero(_may_be_in(contexts.value, context))
                        at = at[_may_be_in(subs.value, sub[at])]
                        held.append((context[at], sub[at]))
                        size += len(at)
                if size >= CHUNK:
                    yield from counted()
                    held, size = [], 0
        if size:
            yield from counted()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpacked(blob.as_py()) for batch in batches for blob in batch["blob"]]
        if got:
            context, sub, c = _summed(*(np.concatenate(x) for x in zip(*got, strict=True)))
            many = c >= least
            key = _key(context[many], sub[many], depth)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, context[many], sub[many], c[many])], ["key", "context", "sub", "c"])

    rows = texts.select("text").mapInArrow(count, "bucket int, blob binary")
    return rows.repartitionById(buckets, "bucket").mapInArrow(merge, "key long, context long, sub long, c long")


def _arrays(df: DataFrame) -> list[np.ndarray]:
    table = df.toArrow()
    return [table[c].to_numpy() for c in table.column_names]


def _retained(grown: DataFrame, seen: DataFrame, parents: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(states: context, n and weight; entries: key, p, c and gain) of the contexts that stay, from the suffixes' p by
    sub; seen has how often each context (key) is met (c).

    The divergence test: 2 * sum c log(p / p of the suffix) against its mean plus three deviations under no divergence.
    A pair that is seen often enough has its shorter one listed, so where the suffix doesn't stay there is no p.
    """
    listed = grown.join(parents.select(F.col("key").alias("sub"), F.col("p").alias("parent")), "sub")
    listed = written(listed.select("key", "context", "c", "parent"), f"listed-{name}")
    sums = listed.groupBy("context").agg(
        F.sum("c").alias("held"), F.sum("parent").alias("mass"), F.count(F.lit(1)).alias("kinds"), F.sum(2 * F.col("c") * F.log(F.col("c") / F.col("parent"))).alias("gain")
    )
    rest = F.col("n") - F.col("held")
    of_rest = F.when(rest > 0, 2 * rest * F.log(F.greatest(rest, F.lit(1e-9)) / (F.col("n") * F.greatest(1 - F.col("mass"), F.lit(1e-9))))).otherwise(0.0)
    gain = F.col("gain") - 2 * F.col("held") * F.log("n") + of_rest
    totals = seen.select(F.col("key").alias("context"), F.col("c").alias("n"))
    tested = sums.join(totals, "context").where(gain > F.col("kinds") + 3 * F.sqrt(2 * F.col("kinds") + 1))
    states = tested.select("context", "n", (F.col("n") + F.col("kinds")).alias("size"), ((rest + F.col("kinds")) / (F.col("n") + F.col("kinds"))).alias("weight"))
    states = written(states, f"states-{name}")
    p = F.col("c") / F.col("size") + F.col("weight") * F.col("parent")
    entries = listed.join(states.drop("n"), "context").withColumn("p", p)
    entries = written(entries.select("key", "p", "c", F.log10(F.col("p") / (F.col("weight") * F.col("parent"))).alias("gain")), f"entries-{name}")
    erased(listed)
    return states, entries


def train(texts: DataFrame, hot_size: int = HOT, depth: int = DEPTH, fewest: int = FEWEST, least: int = LEAST) -> tuple[Hot, DataFrame, DataFrame]:
    """(hot tokens, values, table of all token counts) from a text column without nulls.

    values has key, value and c: for a context that stays its weight, for a symbol listed after it the gain above it,
    both as log10, and how often it is met in the training texts.
    """
    spark = texts.sparkSession
    context: SparkContext = spark.sparkContext
    counts = written(token_counts(texts), "counts")
    total, kinds, most = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.max(F.when(F.col("key") == int(END.astype(np.int64)), F.col("c")))).first()
    top_keys, top_counts = _arrays(most_frequent(counts, "c", "key", min(hot_size, -(-kinds // 4))).select("key", "c"))
    hot = Hot(top_keys.view(np.uint64), top_counts.astype(np.int64), int(total), int(kinds))
    parents = counts.where(F.col("c") >= least).select("key", ((F.col("c") + 0.5) / F.lit(total + 0.5 * (kinds + 1))).alias("p"), "c")
    # each text has one start, as it has one end
    start = spark.range(1).select(F.lit(int(START.astype(np.int64))).alias("key"), F.lit(most or 0).cast("long").alias("c"))
    seen = counts.union(start).where(F.col("c") >= fewest)
    buckets, values, spent = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET)), [], []
    limit = max(OFTEN, total >> 16)
    for d in range(1, depth + 1):
        contexts, subs = _filter(seen), _filter(parents)
        often = context.broadcast(np.sort(_arrays(seen.where(F.col("c") >= limit).select("key"))[0].view(np.uint64)))
        grown = written(_grown(texts, contexts, subs, often, d, min(fewest, least), buckets), f"grown-{d}")
        states, parents = _retained(grown, seen, parents, str(d))
        for shared in (contexts, subs, often):
            shared.destroy()
        spent += [states, parents]
        turned = F.col("context").bitwiseXOR(F.lit(WEIGHT)).alias("key")
        values += [states.select(turned, F.log10("weight").alias("value"), F.col("n").alias("c")), parents.select("key", F.col("gain").alias("value"), "c")]
        if d > 1:
            erased(before)
        # contexts one symbol longer: seen often enough; _retained() looks for their suffixes
        before, seen = grown, grown.where(F.col("c") >= fewest).select("key", "c")
    table = values[0]
    for more in values[1:]:
        table = table.union(more)
    table = written(table, "values")
    for part in [before, *spent]:
        erased(part)
    return hot, table, counts


_SCORED = "rid long, n_tokens long, hot_known long, hot_base double, hot_value double, wanted array<struct<h: long, k: int>>"


def _lists(doc: np.ndarray, keys: np.ndarray, signs: np.ndarray, n: int) -> pa.ListArray:
    """For each of n texts its distinct keys (h) and how often it has each, times the key's sign (k)."""
    order = np.lexsort((keys, doc))
    d, h, s = doc[order], keys[order].view(np.int64), signs[order]
    first = np.ones(len(d), dtype=bool)
    first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    repeats = np.diff(np.append(at, len(d)))
    rows = pa.StructArray.from_arrays([pa.array(h[at], pa.int64()), pa.array(repeats * s[at], pa.int32())], ["h", "k"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(d[at], np.arange(n + 1)), pa.int32()), rows)


def score(docs: DataFrame, depth: int = DEPTH, hot_values: int = HOT_VALUES, **options) -> DataFrame:
    """Scores of docs' (doc_id, text) by a model learnt from those that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities). A null
    or empty text is its end alone. Rows with equal ids or texts are each counted and scored; without training rows
    all tokens are unknown; a table without rows gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    hot, values, counts = train(rows.where(~F.col("held_out")).select("text"), depth=depth, **options)
    hot_keys, hot_gains = _arrays(most_frequent(values, "c", "key", min(hot_values, -(-values.count() // 4))).select("key", "value"))
    order = np.argsort(hot_keys.view(np.uint64))
    shared = spark.sparkContext.broadcast((hot, Index(hot_keys.view(np.uint64)[order]), hot_gains[order]))
    filled = _filter(values)
    unit = hot.total + 0.5 * (hot.kinds + 1)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tokens_of, values_of, gains), table = shared.value, filled.value
        for batch in batches:
            for lo, hi, tokens, cuts in _tokens(batch["text"]):
                n, doc = hi - lo, np.repeat(np.arange(hi - lo), np.diff(cuts))
                at, is_hot = tokens_of.find(tokens)
                base = np.zeros(len(tokens))
                base[is_hot] = tokens_of.log_base[at[is_hot]]
                place = np.arange(len(tokens)) - np.repeat(cuts[:-1], np.diff(cuts))
                value, of, cold = np.zeros(n), [doc[~is_hot]], [tokens[~is_hot]]
                # a state's suffixes are states, and only a state lists symbols
                alive = np.ones(len(tokens), dtype=bool)
                for d, (context, key, _) in enumerate(_grams(tokens, cuts, depth), 1):
                    there = place >= d - 1
                    alive &= there
                    context, key, where = context[alive[there]], key[alive[there]], np.flatnonzero(alive)
                    state = _may_be_in(table, context ^ np.uint64(WEIGHT))
                    alive[where[~state]] = False
                    context, key, where = context[state], key[state], where[state]
                    listed = _may_be_in(table, key)
                    for wanted, spot in ((context ^ np.uint64(WEIGHT), doc[where]), (key[listed], doc[where[listed]])):
                        found, hit = values_of.find(wanted)
                        value += np.bincount(spot[hit], weights=gains[found[hit]], minlength=n)
                        of.append(spot[~hit])
                        cold.append(wanted[~hit])
                add = lambda x, c=cuts: np.add.reduceat(x, c[:-1])
                signs = np.concatenate([np.ones(len(cold[0]), np.int64), np.full(sum(map(len, cold[1:])), -1)])
                lists = _lists(np.concatenate(of), np.concatenate(cold), signs, n)
                columns = [batch["doc_id"].slice(lo, n), batch["held_out"].slice(lo, n), batch["rid"].slice(lo, n), pa.array(np.diff(cuts)), pa.array(add(is_hot.astype(np.int64))), pa.array(add(base)), pa.array(value), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "rid", "n_tokens", "hot_known", "hot_base", "hot_value", "wanted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", "held_out", F.monotonically_increasing_id().alias("rid"), "text").mapInArrow(scores, f"doc_id {id_type}, held_out boolean, {_SCORED}")
    scored = written(scored, "scored")
    # k > 0 asks for a token's count, k < 0 for a value: one table has both
    table = counts.select("key", "c", F.lit(None).cast("double").alias("value")).union(values.select("key", F.lit(None).cast("long"), "value"))
    wanted = scored.select("rid", F.explode("wanted").alias("w")).select("rid", F.col("w.h").alias("key"), F.col("w.k").alias("k"))
    cold = wanted.join(table, "key", "left").groupBy("rid").agg(
        F.sum(F.when((F.col("k") > 0) & F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("known"),
        F.sum(F.when(F.col("k") > 0, F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(unit))).otherwise(0.0)).alias("base"),
        F.sum(F.when(F.col("k") < 0, -F.col("k") * F.coalesce("value", F.lit(0.0))).otherwise(0.0)).alias("value"),
    )
    base_score = F.col("hot_base") + F.coalesce("base", F.lit(0.0))
    return scored.drop("wanted").join(cold, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(hot.total)).cast("long").alias("train_tokens"),
        base_score.alias("base_score"),
        (base_score + F.col("hot_value") + F.coalesce("value", F.lit(0.0))).alias("score"),
    )
