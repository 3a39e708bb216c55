"""Quotas, rights and concentration limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import urls
from granary.functions.numbers import strict_date
from granary.functions.text import bound
from granary.operators.publish import paged
from granary.sources.stores import kept

#: What publication rights may rest on. Fixed values.
BASES = ("first-party", "public-domain", "cc0", "compatible-license", "written-permission")


def within_quota(rows: DataFrame, host: str, order: str, clean: Column, cap: int) -> DataFrame:
    """rows with accepted: clean and among the first ``cap`` clean rows of their host (0: no limit). Rejected rows use no quota."""
    place = F.sum(clean.cast("int")).over(Window.partitionBy(host).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("accepted", clean & (F.lit(cap == 0) | (place <= cap)))


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(order, key_nth): a row's place among those with the same key."""
    return rows.select(order, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias(f"{key}_nth"))


def rights_issues(host: Column, entry: Column, as_of: Column, most_days: Column) -> Column:
    """Reasons against publishing from a host by its rights record (struct of status, basis, evidence, reviewed_at and
    expires_at; null: there is none), as of a moment (timestamp)."""

    def made(p: Column) -> Column:
        e, day = p["e"], lambda c: strict_date(c).cast("timestamp")
        says = lambda *parts: F.concat(p["host"], *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
        age = F.floor((F.unix_micros(p["as_of"]) - F.unix_micros(day(e["reviewed_at"]))) / 86_400_000_000).cast("long")
        known = F.array_compact(
            F.array(
                F.when(~e["status"].eqNullSafe(F.lit("approved")), says(" is marked draft-only")),
                F.when(e["basis"].eqNullSafe(F.lit("unverified")), says(" has no verified publication-rights basis")),
                F.when(F.trim(F.coalesce(e["evidence"], F.lit(""))) == "", says(" has no publication-rights evidence reference")),
                F.when(age.isNull(), says(" has no valid rights review date")).when(age > p["most_days"], says(" rights review is ", age, " days old")),
                F.when((F.coalesce(e["expires_at"], F.lit("")) != "") & strict_date(e["expires_at"]).isNull(), says(" has an invalid rights expiry date")),
                F.when(day(e["expires_at"]) < p["as_of"], says(" publication rights expired on ", e["expires_at"])),
            )
        )
        return (
            F.when(p["host"] == "", F.array(F.lit("candidate source URL has no valid hostname")))
            .when(e.isNull(), F.array(F.concat(F.lit("no publication-rights record exists for "), p["host"])))
            .otherwise(known)
        )

    return bound(F.struct(F.coalesce(host, F.lit("")).alias("host"), entry.alias("e"), as_of.alias("as_of"), most_days.alias("most_days")), made)


def placed(rows: DataFrame, order: str, name: str = "seq") -> DataFrame:
    """rows with their place (from 1) in a unique order: a range partitioning and sums of its parts' counts, no window over everything."""
    return paged(rows, order, 1).withColumnRenamed("position", name).drop("page")


def share_gate(rows: DataFrame, host: str, order: str, share_percent: float, least: int, known: DataFrame | None = None, clean: str | None = None, caps: str | None = None) -> DataFrame:
    """rows with before (accepted rows of the host so far, known ones among them), total (all accepted so far) and
    accepted: whether a row of a unique order is admitted.

    A row is refused if it is not clean (a boolean column), if its host would have more than its cap (a column; null:
    no cap), or if its host would have more than a share of the collection, once that has ``least`` rows. known
    (host, n) are rows that the collection has already. Refused rows count for nothing.

    Only hosts that could reach the share are decided one after another: with a share of p percent of at least as many
    rows as are known there are few of them. All other hosts' rows are counted by windows and sums, and the serial fold
    gets a row for each row of those few, with the number of the others' rows accepted before it.
    """
    spark = rows.sparkSession
    known = known if known is not None else spark.createDataFrame([], f"{host} string, n long")
    start = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    total = known.agg(start.alias("t")).first()["t"]
    held = known.groupBy(host).agg(F.sum("n").cast("long").alias("_known"))
    marked = rows.withColumn("_clean", F.coalesce(F.col(clean), F.lit(False)) if clean else F.lit(True)).join(held, host, "left").withColumn("_known", F.coalesce("_known", F.lit(0)))
    marked = marked.withColumn("_cap", F.col(caps).cast("long") if caps else F.lit(None).cast("long"))
    in_order = Window.partitionBy(host).orderBy(order)
    counted = marked.withColumn("_earlier", F.coalesce(F.sum(F.col("_clean").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    most = F.col("_known") + F.sum(F.col("_clean").cast("long")).over(Window.partitionBy(host))
    # at most this many of a host, of at least this many rows in all
    counted = counted.withColumn("_heavy", (most * 100 > F.lit(float(share_percent)) * F.greatest(F.lit(total + 1), F.lit(least))))
    light_ok = F.col("_clean") & ~F.col("_heavy") & (F.col("_cap").isNull() | (F.col("_known") + F.col("_earlier") < F.col("_cap")))
    seq = placed(counted.withColumn("_light", light_ok), order, "_seq")
    # a running sum over all rows by sums of blocks of places
    block = F.expr("_seq div 4096")
    blocks = seq.groupBy(block.alias("_block")).agg(F.sum(F.col("_light").cast("long")).alias("n"))
    before = blocks.select("_block", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(F.col("_light").cast("long")).over(Window.partitionBy("_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    running = seq.withColumn("_block", block).withColumn("_inside", inside).join(before, "_block").withColumn("_lights", F.col("_base") + F.col("_inside") + F.lit(total))
    running = kept(running, "running")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        accepted = 0
        for batch in batches:
            out = []
            for name, ok, had, cap, lights in zip(*(batch[c].to_pylist() for c in ("h", "clean", "known", "cap", "lights")), strict=True):
                n, size = had + counts.get(name, 0), lights + accepted
                ok = ok and (cap is None or n + 1 <= cap) and (size + 1 < least or (n + 1) / (size + 1) * 100 <= share_percent)
                out.append((n, size, ok))
                counts[name] = counts.get(name, 0) + ok
                accepted += ok
            before, size, ok = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch["s"], pa.array(before, pa.int64()), pa.array(size, pa.int64()), pa.array(ok, pa.bool_())], ["s", "before", "total", "accepted"])

    slim = running.where("_heavy").select(
        F.col("_seq").alias("s"), F.col(host).alias("h"), F.col("_clean").alias("clean"), F.col("_known").alias("known"), F.col("_cap").alias("cap"), F.col("_lights").alias("lights"),
    )
    # one after another, a batch of rows at a time; the state is a number a host
    in_turn = slim.repartition(1).sortWithinPartitions("s").mapInArrow(fold, "s long, before long, total long, accepted boolean")
    decided = kept(in_turn.withColumnRenamed("s", "_seq"), "decided")
    # how many of the few were accepted before each of the other rows: places are looked up in the order of decisions
    gained = decided.where("accepted").select(F.col("_seq").alias("_at"))
    lights = running.where("NOT _heavy").select("_seq")
    merged = lights.withColumn("_add", F.lit(0).cast("long")).union(gained.select(F.col("_at"), F.lit(1).cast("long"))).withColumn("_block", F.expr("_seq div 4096"))
    sums = merged.groupBy("_block").agg(F.sum("_add").alias("n"))
    sums = sums.select("_block", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.sum("_add").over(Window.partitionBy("_block").orderBy("_seq"))
    others = merged.withColumn("_within", within).where("_add = 0").join(sums, "_block").select("_seq", (F.col("_base") + F.col("_within")).alias("_gained"))
    rest = running.where("NOT _heavy").join(others, "_seq")
    cap_left = F.when(F.col("_cap").isNull(), F.col("_earlier")).otherwise(F.least(F.col("_earlier"), F.greatest(F.lit(0), F.col("_cap") - F.col("_known"))))
    columns = rows.columns
    light_rows = rest.select(*columns, (F.col("_known") + cap_left).alias("before"), (F.col("_lights") + F.col("_gained")).alias("total"), F.col("_light").alias("accepted"))
    return running.where("_heavy").join(decided, "_seq").select(*columns, "before", "total", "accepted").unionByName(light_rows)


def rights_verdict(candidates: DataFrame, policy: DataFrame, known: DataFrame, as_of: Column, most_days: int, share_percent: float, least: int, clean: str | None = None) -> DataFrame:
    """candidates (url, and seq, a unique order) with host, rights_issues and accepted.

    policy has a row a host: host, status, basis, evidence, reviewed_at, expires_at, max_per_run and max_catalog (0: no
    cap). known (host, n) are records of the catalog. A candidate's caps and share are those of the catalog with all
    candidates that were accepted before it; clean (a boolean column) tells which could be accepted at all.
    """
    entry = F.struct("status", "basis", "evidence", "reviewed_at", "expires_at", "max_per_run", "max_catalog")
    records = policy.select("host", entry.alias("_entry"))
    rows = candidates.withColumn("host", urls.host(F.col("url"))).join(records, "host", "left")
    static = rows.withColumn("_static", rights_issues(F.col("host"), F.col("_entry"), as_of, F.lit(most_days)))
    held = known.groupBy("host").agg(F.sum("n").cast("long").alias("_held"))
    static = static.join(held, "host", "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
    cap = lambda c: F.when(F.col(f"_entry.{c}") > 0, F.col(f"_entry.{c}"))
    # the gate counts known rows too
    static = static.withColumn("_caps", F.least(cap("max_per_run") + F.col("_held"), cap("max_catalog")))
    static = static.withColumn("_ok", (F.size("_static") == 0) & (F.coalesce(F.col(clean), F.lit(False)) if clean else F.lit(True)))
    gated = share_gate(static, "host", "seq", share_percent, least, known, "_ok", "_caps")
    says = lambda *parts: F.concat(F.col("host"), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    share = (F.col("before") + 1) / (F.col("total") + 1) * 100
    limits = F.array(
        F.when(F.col("before") - F.col("_held") + 1 > cap("max_per_run"), says(" exceeds its ", F.col("_entry.max_per_run"), "-recipe per-run cap")),
        F.when(F.col("before") + 1 > cap("max_catalog"), says(" exceeds its ", F.col("_entry.max_catalog"), "-recipe catalog cap")),
        F.when(
            (F.col("total") + 1 >= least) & (share > share_percent),
            says(" would represent ", F.format_number(share, 1), f"% of the catalog, above the {share_percent:g}% collection cap"),
        ),
    )
    capped = F.when(F.col("_entry").isNull(), F.col("_static")).otherwise(F.concat("_static", F.array_compact(limits)))
    return gated.withColumn("rights_issues", capped).drop("_static", "_entry", "_caps", "_held", "_ok", "before", "total")


def upserted_rights(policy: DataFrame, changes: DataFrame) -> DataFrame:
    """policy with changes by host: approve sets all fields and keeps caps and notes that are not named, draft-only
    resets all but the notes. Approving needs a known basis and evidence, or it is an error."""
    fields = ["status", "basis", "evidence", "reviewed_at", "expires_at", "max_per_run", "max_catalog", "notes"]
    old = policy.select("host", F.struct(*fields).alias("o"))
    both = old.join(changes.select("host", F.struct("approve", *fields[1:]).alias("n")), "host", "full_outer")
    bad = F.col("n.approve") & (~F.coalesce(F.col("n.basis").isin(*BASES), F.lit(False)) | (F.trim(F.coalesce("n.evidence", F.lit(""))) == ""))
    approved = F.when(bad, F.raise_error(F.lit("approving needs a known basis and evidence")).cast("string")).otherwise(F.lit("approved"))
    text, cap = lambda c: F.coalesce(F.col(f"n.{c}"), F.lit("")), lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"), F.lit(0))
    notes = F.coalesce("n.notes", "o.notes", F.lit(""))
    yes = F.struct(approved.alias("status"), text("basis").alias("basis"), text("evidence").alias("evidence"), text("reviewed_at").alias("reviewed_at"), text("expires_at").alias("expires_at"),
                   cap("max_per_run").alias("max_per_run"), cap("max_catalog").alias("max_catalog"), notes.alias("notes"))
    empty, zero = F.lit(""), F.lit(0)
    no = F.struct(F.lit("draft-only").alias("status"), F.lit("unverified").alias("basis"), empty.alias("evidence"), empty.alias("reviewed_at"), empty.alias("expires_at"), zero.alias("max_per_run"), zero.alias("max_catalog"), notes.alias("notes"))
    return both.select("host", F.when(F.col("n").isNull(), F.col("o")).when(F.col("n.approve"), yes).otherwise(no).alias("r")).select("host", "r.*")
