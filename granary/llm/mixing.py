"""Mixing sources to target weights by Sainte-Lague apportionment.

Equal-token blocks go to sources by highest quotients ``target / (2 * seat - 1)``. The rule is house
monotone, so the first ``k`` seats of any prefix are an apportionment of ``k``: cutting the sequence of
seats at equal lengths gives integer quotas for each output shard. Each source's documents, in a seeded
order, form one line of tokens that is cut into blocks; a source's seats take whole passes over that line
and then a run of blocks that starts at a seeded block.

Nothing here depends on the number of blocks: quotas come from the shares and a few quotients around
them, a document's part of a run is two interval overlaps, and the line is laid out by bucket sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm._common import seeded, sum_over_all, word_count, written

KEYS = ["no_source", "src"]


def _keyed(df: DataFrame, seed: str) -> DataFrame:
    return df.select(
        "*",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("src"),
        seeded(seed, "doc_id").alias("draw"),
    ).withColumn("bucket", F.substring("draw", 1, 3))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets by water filling. sizes: no_source, src, source_size; one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn. A target stops at ``cap`` times its
    source's size; what is above goes to the others by weight. An empty source has target 0.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(*KEYS)
    level = Window.partitionBy(F.lit(0)).orderBy("full_at", *KEYS)
    ranked = sizes.select("*", (F.row_number().over(order) - 1).alias("turn"))
    weighed = ranked.select(
        *KEYS,
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")).alias("weight"),
        (F.lit(float(cap)) * F.col("source_size")).alias("most"),
        (F.lit(float(share)) * sum_over_all("source_size")).alias("wanted"),
    ).withColumn("full_at", F.col("most") / F.col("weight"))
    filled = weighed.select(
        "*",
        F.coalesce(F.sum("most").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("spent"),
        F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)).alias("left_weight"),
    ).withColumn("lam", (F.col("wanted") - F.col("spent")) / F.col("left_weight"))
    everywhere = Window.partitionBy(F.lit(0))
    return filled.withColumn("lam", F.min(F.when(F.col("lam") <= F.col("full_at"), F.struct("full_at", "lam"))).over(everywhere)["lam"]).select(
        *KEYS, "source_size", "weight", F.coalesce(F.least("most", F.col("lam") * F.col("weight")), "most").alias("target")
    )


def seats(parties: DataFrame, shards: int) -> DataFrame:
    """Sainte-Lague seats of each party in each of the first ``k * blocks / shards`` seats, k to shards.

    parties: no_source, src, target (votes), most_seats, blocks (house size, the same in each row).
    Returns no_source, src, shard, held (seats so far) and quota (this shard's own).
    """
    everywhere = Window.partitionBy(F.lit(0))
    houses = (
        parties.withColumn("part", F.col("target") / F.greatest(sum_over_all("target"), F.lit(1e-300)))
        .withColumn("slack", F.ceil(F.col("part") * F.count(F.lit(1)).over(everywhere)) + 2)
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumn("house", F.expr(f"blocks * (shard + 1) div {shards}"))
        .withColumn("sure", F.least(F.greatest(F.lit(0), F.floor(F.col("part") * F.col("house")) - F.col("slack")), "most_seats"))
        .withColumn("upto", F.least(F.col("sure") + 2 * F.col("slack") + 2, "most_seats"))
    )
    per_house = Window.partitionBy("shard")
    open_seats = F.col("house") - F.sum("sure").over(per_house)
    base = houses.select("*", open_seats.alias("open_seats"))
    seat = base.where(F.col("upto") > F.col("sure")).select("*", F.explode(F.sequence(F.col("sure") + 1, F.col("upto"))).alias("seat"))
    quotient = F.col("target") / (2 * F.col("seat") - 1)
    won = seat.select("*", F.row_number().over(per_house.orderBy(quotient.desc(), "seat", *KEYS)).alias("place")).where(F.col("place") <= F.col("open_seats"))
    more = won.groupBy(*KEYS, "shard").agg(F.count(F.lit(1)).alias("more"))
    held = base.join(more, [*KEYS, "shard"], "left").select(*KEYS, "shard", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("held"))
    line = Window.partitionBy(*KEYS).orderBy("shard")
    return held.withColumn("quota", F.col("held") - F.coalesce(F.lag("held").over(line), F.lit(0)))


def mix_plan(sized: DataFrame, weights, share, cap, shards: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(sources, buckets): a row a source with its line's length and each shard's run on it; a row a source and bucket
    with its start on the line.

    A source's blocks follow each other in a ring from a seeded block on; a shard's quota takes the next blocks
    after the shard before. Runs are counted in words from the line's start, the ring unrolled.
    """
    buckets = sized.groupBy(*KEYS, "bucket").agg(F.sum("size").alias("tokens"))
    line = Window.partitionBy(*KEYS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*KEYS, "bucket", F.coalesce(F.sum("tokens").over(line), F.lit(0)).alias("bucket_start"))
    targets = source_targets(sized.groupBy(*KEYS).agg(F.sum("size").alias("source_size")), weights, share, cap)
    everywhere = Window.partitionBy(F.lit(0))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everywhere)
    sized_blocks = (
        targets.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(smallest / 1000))), F.lit(1)).cast("long"))
        .withColumn("n_blocks", F.expr("(source_size + block - 1) div block"))
        .withColumn("most_seats", (F.floor(F.lit(float(cap)) * F.col("n_blocks"))).cast("long"))
        .withColumn("blocks", F.floor(sum_over_all("target") / F.col("block")))
    )
    start = F.expr("cast(conv(substring(md5(concat_ws(':', '{}', src)), 1, 8), 16, 10) as bigint)".format(seed.replace("'", "")))
    quotas = seats(sized_blocks, shards).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("shard", "held", "quota"))).alias("quotas"))
    first = start % F.greatest("n_blocks", F.lit(1))
    run = lambda q: F.struct(q["shard"].alias("shard"), ((F.col("first") + q["held"] - q["quota"]) * F.col("block")).alias("a"), ((F.col("first") + q["held"]) * F.col("block")).alias("b"))
    sources = sized_blocks.join(quotas, KEYS).withColumn("first", first)
    return sources.select(*KEYS, "source_size", "target", (F.col("n_blocks") * F.col("block")).alias("ring"), F.transform(F.filter("quotas", lambda q: q["quota"] > 0), run).alias("runs")), buckets


def _taken(docs: DataFrame, carried: list[Column], weights, share, cap, shards: int, seed: str) -> DataFrame:
    """A row a row of docs with the carried columns, size, source_size, target, and takings: the shard and words (a to
    b - 1) of each taking."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources, buckets = mix_plan(_keyed(sized, seed), weights, share, cap, shards, seed)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), *carried) if carried else sized.withColumn("mark", F.lit(0))
    at = Window.partitionBy(*KEYS, "bucket").orderBy("draw", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    laid = _keyed(rows, seed).withColumn("upto", F.sum("size").over(at)).join(buckets.join(sources, KEYS), [*KEYS, "bucket"])
    laid = laid.withColumn("lo", F.col("bucket_start") + F.col("upto") - F.col("size"))
    # a run ends within cap + 1 rounds of the ring
    takings = (
        "filter(flatten(transform(runs, r -> transform(sequence(0, {rounds}), t -> named_struct('shard', r.shard, "
        "'a', greatest(0L, r.a - lo - t * ring), 'b', least(size, r.b - lo - t * ring))))), x -> x.b > x.a)"
    ).format(rounds=math.ceil(cap))
    return laid.withColumn("takings", F.expr(takings))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int = 8, seed: str = "mix-1") -> DataFrame:
    """Words that a mixture takes of each document; docs has doc_id, source and text.

    Returns doc_id, source, size, source_size, target, taken and takings, an array of shard and half-open range of
    words (a, b), one for each time that a shard takes words of the document.

    Null or empty texts have size 0 and are never taken. A null source is a source of its own, last in
    order. Rows with equal doc_id each keep a row; equal rows are interchangeable. A table without rows
    gives none. Other columns are ignored.
    """
    taken = F.aggregate("takings", F.lit(0).cast("long"), lambda n, t: n + t["b"] - t["a"])
    return _taken(docs, [], weights, share, cap, shards, seed).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "takings")


def mixed_texts(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int = 8, seed: str = "mix-1") -> DataFrame:
    """The mixture itself: docs' rows, once for each taking, cut to the words taken of them; n_chars follows.

    A row without words is never taken. Rows with equal doc_id are each taken by their own words.
    """
    laid = _taken(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")], weights, share, cap, shards, seed)
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    taking = laid.select("row", "size", F.explode("takings").alias("t"))
    cut = F.array_join(F.slice(words, (F.col("t.a") + 1).cast("int"), (F.col("t.b") - F.col("t.a")).cast("int")), "")
    text = F.when(F.col("t.b") - F.col("t.a") == F.col("size"), F.col("row.text")).otherwise(cut)
    made = taking.select("row", text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return made.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


#: DuckDB SQL for the op1 query: the same plan, with the whole line laid out by one window. With more seats than
#: shares round to, the highest quotients decide as in the operator.
ORACLE = """
WITH d AS (SELECT doc_id, source IS NULL AS ns, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
s AS (SELECT ns, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ns, src),
w AS (SELECT *, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY ns, src) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most,
  1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM s),
f AS (SELECT *, most / weight AS full_at, (wanted - coalesce(sum(most) OVER (ORDER BY most / weight, ns, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, ns, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM w),
t AS (SELECT ns, src, source_size, weight, coalesce(least(most, (SELECT arg_min(lam, full_at) FROM f WHERE lam <= full_at) * weight), most)::DOUBLE AS target FROM f),
b AS (SELECT *, coalesce(greatest(1, least(1024, floor(min(CASE WHEN target > 0 THEN target END) OVER () / 1000))), 1)::BIGINT AS block, sum(target) OVER () AS all_targets,
  count(*) OVER () AS n FROM t),
k AS (SELECT *, (source_size + block - 1) // block AS n_blocks, floor(all_targets / block)::BIGINT AS blocks, target / greatest(all_targets, 1e-300) AS part FROM b),
h AS (SELECT *, 2 * n_blocks AS most_seats, ceil(part * n)::BIGINT + 2 AS slack, blocks * (shard + 1) // 8 AS house FROM k, unnest(range(8)) AS v(shard)),
u AS (SELECT *, least(greatest(0, floor(part * house)::BIGINT - slack), most_seats) AS sure FROM h),
q AS (SELECT ns, src, shard, target / (2 * seat - 1) AS quotient, seat, house - all_sure AS open_seats
  FROM (SELECT *, sum(sure) OVER (PARTITION BY shard) AS all_sure FROM u), unnest(range(sure + 1, least(sure + 2 * slack + 2, most_seats) + 1)) AS v(seat)),
won AS (SELECT ns, src, shard, count(*) AS more FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY quotient DESC, seat, ns, src) AS place FROM q)
  WHERE place <= open_seats GROUP BY ns, src, shard),
g AS (SELECT u.*, sure + coalesce(more, 0) AS held, ('0x' || substr(md5('mix-1:' || u.src), 1, 8))::BIGINT % greatest(n_blocks, 1) AS r0
  FROM u LEFT JOIN won ON won.ns = u.ns AND won.src = u.src AND won.shard = u.shard),
p AS (SELECT *, held - coalesce(lag(held) OVER (PARTITION BY ns, src ORDER BY shard), 0) AS quota FROM g),
l AS (SELECT d.*, row_number() OVER () AS rid, sum(size) OVER (PARTITION BY ns, src ORDER BY substr(draw, 1, 3), draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS lo FROM d)
SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target, coalesce(sum(n), 0)::BIGINT AS taken,
  coalesce(string_agg(DISTINCT shard::VARCHAR, ',' ORDER BY shard::VARCHAR) FILTER (WHERE n > 0), '') AS shards
FROM (SELECT l.*, source_size, target, shard, greatest(0, least(size, (r0 + held) * block - lo - t * n_blocks * block) - greatest(0, (r0 + held - quota) * block - lo - t * n_blocks * block)) AS n
  FROM l JOIN p ON p.ns = l.ns AND p.src = l.src, unnest(range(3)) AS v(t)) GROUP BY rid, doc_id, size
"""
