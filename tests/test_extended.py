import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from granary.operators import feed, gates, legacy, publish, ranges, ranking, resolve, rollups
from granary.plans import catalog, imports, records
from granary.sources import stores
from granary.streaming import events as streams

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("parts", [8, 200])
def test_positions_are_exact_with_all_columns(spark, tmp_path, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.range(400_000, numPartitions=16).select(F.md5(F.col("id").cast("string")).alias("k"), F.col("id"), F.repeat(F.lit("x"), 20).alias("wide"))
        publish.paged(rows, "k", 250).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = out.agg(F.count_distinct("position"), F.min("position"), F.max("position"), F.count_distinct("page")).first()
    assert tuple(got) == (400_000, 1, 400_000, 1600)
    assert out.groupBy("page").count().where("count <> 250").isEmpty()
    first = [r["k"] for r in out.where("position <= 300").orderBy("position").collect()]
    assert first == sorted(first) and first[0] == rows.agg(F.min("k")).first()[0]


def test_positions_of_no_rows_and_one(spark):
    rows = spark.createDataFrame([("a",)], "k string")
    assert [tuple(r) for r in publish.paged(rows, "k", 3).select("k", "position", "page").collect()] == [("a", 1, 1)]
    assert publish.paged(rows.where("k = 'b'"), "k", 3).isEmpty()


def test_share_gate_equals_a_fold(spark):
    dice = random.Random(5)
    rows = [(f"{i:05}", dice.choice("aaaabbbcdefgh"), dice.random() < 0.9) for i in range(3000)]
    frame = spark.createDataFrame(rows, "seq string, host string, ok boolean")
    got = {r["seq"]: (r["before"], r["total"], r["accepted"]) for r in gates.share_gate(frame, "host", "seq", 30.0, 40, clean="ok").collect()}
    counts, size = Counter(), 0
    for seq, host, ok in rows:
        accepted = ok and (size + 1 < 40 or (counts[host] + 1) / (size + 1) * 100 <= 30)
        assert got[seq] == (counts[host], size, accepted), seq
        counts[host] += accepted
        size += accepted


@pytest.mark.parametrize("name", sorted(catalog.INPUTS))
def test_chosen_inputs_give_their_results(spark, data, duck, name):
    query, sql = catalog.INPUTS[name]
    got, wanted = query(spark, data).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)


def moments(spark, rows, schema):
    return spark.createDataFrame([(k, key, None if s is None else START + dt.timedelta(seconds=s)) for k, key, s in rows], schema)


def test_as_of_with_a_hot_key_ties_and_nulls(spark):
    dice = random.Random(3)
    left = [(i, "hot" if dice.random() < 0.7 else dice.choice(["x", "y", None]), dice.choice([None, *range(500)])) for i in range(2000)]
    right = [(i, "hot" if dice.random() < 0.7 else dice.choice(["x", "z", None]), dice.choice([None, *range(500)])) for i in range(900)]
    schema = "id long, u string, ts timestamp"
    for buckets in (1, 7, 4096):
        found = ranges.as_of(moments(spark, left, schema), moments(spark, right, schema), "u", "ts", "id", buckets).select("id", "match.id").toDF("id", "other").collect()
        got = {r["id"]: r["other"] for r in found}
        assert len(found) == len(left)
        for i, u, s in left:
            able = [] if u is None or s is None else [(t, j) for j, v, t in right if v == u and t is not None and t <= s]
            assert got[i] == (max(able)[1] if able else None)
    assert ranges.as_of(moments(spark, left, schema), moments(spark, right, schema).limit(0), "u", "ts", "id").where("match IS NOT NULL").isEmpty()


def test_as_of_makes_no_nested_loop(spark, data):
    plan = catalog.queries()["asof_click"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranges_of_any_length(spark):
    dice = random.Random(8)
    points = [(i, dice.choice("ab"), dice.randrange(-4000, 4000)) for i in range(300)]
    spans = [(i, dice.choice("ab"), s := dice.randrange(-4000, 4000), s + dice.choice([-3, 0, 1, 15, 16, 900, 7000])) for i in range(200)]
    got = ranges.containing(spark.createDataFrame(points, "id long, k string, at long"), spark.createDataFrame(spans, "id long, k string, s long, e long"), "k", "at", "s", "e")
    assert sorted(tuple(r) for r in got.select("p.id", "r.id").collect()) == sorted((p, r) for p, k, at in points for r, m, s, e in spans if k == m and s <= at <= e)


def test_spread_points_are_not_broadcast(spark, data):
    for name in ("range_points", "interval_pairs", "asof_click"):
        plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rows_later_than_the_watermark_count_for_no_session(spark, tmp_path):
    for rows in ([(0, "a", 0), (1, "a", 30), (2, "a", 4000)], [(4, "a", 9000)], [(3, "a", 50)], [(5, "a", 20000)]):
        moments(spark, rows, "id long, u string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = streams.available(streams.sessions(streams.stream_of(spark, str(tmp_path / "in"), "ts", 1), "u", "ts", "60 seconds", "10 seconds"), "s").collect()
    # the row at 50 seconds came when the session that it would have joined had been given already
    assert sorted((r["start"], r["n"]) for r in found) == [(START, 2), (START + dt.timedelta(seconds=4000), 1), (START + dt.timedelta(seconds=9000), 1)]


def test_lateness_keeps_its_state_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in ([(0, "a", 0), (1, "a", 10), (2, "b", 5)], [(3, "a", 7), (4, "a", 12), (5, "b", 1)]):
            moments(spark, rows, "id long, u string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = streams.available(streams.lateness(streams.stream_of(spark, str(tmp_path / "in"), "ts", 1), "u", "ts", "id"), "late")
        assert sorted(map(tuple, out.collect())) == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 3.0), (4, 0.0), (5, 4.0)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def exhaustive(docs, asked, most):
    held = {k: Counter(re.findall(r"[a-z0-9]+", (t or "").lower())) for k, t in docs}
    average = sum(sum(c.values()) for c in held.values()) / len(held)
    seen = Counter(w for c in held.values() for w in c)
    scores = []
    for k, c in held.items():
        score = 0
        for w in set(re.findall(r"[a-z0-9]+", asked.lower())):
            if c[w]:
                weight = math.log(1 + (len(held) - seen[w] + 0.5) / (seen[w] + 0.5))
                score += math.floor(weight * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average))) * 1_000_000)
        if score:
            scores.append((-score, k))
    return [(k, -s) for s, k in sorted(scores)[:most]]


def test_ranked_search_equals_an_exhaustive_one_and_skips_blocks(spark):
    dice = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(words[min(299, int(dice.expovariate(0.03)))] for _ in range(dice.choice([0, 3, 20, 60])))) for i in range(20_000)]
    docs += [(20_000, None), (20_001, "Rare rare w1 rare"), (20_002, "rare w2")]
    found = ranking.index(spark.createDataFrame(docs, "id long, text string").repartition(3), "id", "text")
    asked = [(1, "rare w1"), (2, "w250 w251 w0 w0"), (3, "nothing here"), (4, None), (5, "w3")]
    results, work = ranking.search(found, spark.createDataFrame(asked, "q long, text string"), "q", "text")
    got = {}
    for r in results.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["key"], r["score"]))
    assert got == {q: e for q, t in asked if (e := exhaustive(docs, t or "", 10))}
    read, skipped = work.first()
    assert read > 0 and skipped > 200


def test_sketches_merge_within_their_errors(spark):
    rows = spark.range(200_000).select((F.col("id") % 40_000).alias("user"), F.col("id").cast("double").alias("v"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 30).cast("int")).alias("ts"), F.lit("x").alias("kind"))
    days = rollups.daily(rows, "ts", ["kind"], "user", "v")
    assert days.count() == 30
    total = rollups.merged(days, ["kind"]).where("kind IS NULL").first()
    assert total["n"] == 200_000 and float(total["total"]) == sum(range(200_000))
    assert abs(total["users"] - 40_000) < 2400 and abs(total["users_theta"] - 40_000) < 2400 and abs(total["median"] - 100_000) < 6000


def _folder(path, text):
    path.mkdir()
    (path / "a").write_text(text)
    return str(path)


def test_a_crash_between_any_steps_leaves_the_old_or_the_new(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    assert stores.current(spark, out) is None
    stores.publish(spark, _folder(tmp_path / "one", "1"), out)
    read = lambda: spark.read.text(stores.current(spark, out) + "/a").first()[0]
    assert read() == "1"
    # before the move, after it, and with a pointer that was created and not written
    with monkeypatch.context() as m:
        m.setattr(stores, "_text_at", lambda *_: (_ for _ in ()).throw(OSError("down")))
        with pytest.raises(OSError):
            stores.publish(spark, _folder(tmp_path / "two", "2"), out)
    assert read() == "1"
    stores._text_at(spark, f"{out}/pointers/{2:020}", "")
    assert read() == "1"
    stores._text_at(spark, f"{out}/pointers/{3:020}", "versions/half")
    assert read() == "1"
    stores.publish(spark, _folder(tmp_path / "three", "3"), out)
    assert read() == "3"
    # two who publish at the same time: the second finds the number taken
    with pytest.raises(Exception, match="(?i)exist"):
        stores._text_at(spark, f"{out}/pointers/{4:020}", "versions/other\n")
    assert read() == "3"
    stores.publish(spark, _folder(tmp_path / "four", "4"), out)
    stores.prune(spark, out, 1)
    assert read() == "4" and len(stores._pointers(spark, out)) == 1


def test_a_small_file_is_there_all_the_time(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m.json")
    stores.write_text(spark, path, "old")
    with monkeypatch.context() as m:
        made = stores._text_at

        def fails(*given):
            made(*given)
            raise OSError("down")

        m.setattr(stores, "_text_at", fails)
        with pytest.raises(OSError):
            stores.write_text(spark, path, "new")
    assert (tmp_path / "m.json").read_text() == "old"
    stores.write_text(spark, path, "new")
    assert spark.read.text(path).first()[0] == "new"


def test_substrings_by_trigrams_equal_a_scan(spark):
    dice = random.Random(6)
    rows = [(i, "".join(dice.choice("abAB ßé.") for _ in range(dice.choice([0, 2, 3, 30])))) for i in range(400)] + [(400, None), (401, "abcabc")]
    from granary.operators import substring

    table = spark.createDataFrame(rows, "id long, text string")
    found = substring.index(table, "id", "text", 20)
    for needle in ("abc", "ab ", "ABA", "ßé", "ßéa", "a", "", "zzz", "b.a."):
        got = sorted(r["id"] for r in substring.holding(table, found, "id", "text", needle).collect())
        assert got == [i for i, t in rows if t is not None and needle.lower() in t.lower()], needle
    plan = substring.candidates(found, "abc")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "EqualTo(gram" in plan


def test_terms_in_several_automata_equal_windows(spark):
    from granary.operators.similarity import terms_in

    dice = random.Random(2)
    texts = [(i, " ".join(dice.choice(["Red", "crème", "b", "c-d", "x"]) for _ in range(dice.choice([0, 1, 9])))) for i in range(200)] + [(None, "red"), (7, None)]
    terms = ["red", "RED", "creme b", "c d c d", "x x x x x x", "b", "", "-", "Crème", "d c"]
    plain = lambda t: re.findall("[a-z0-9]+", (t or "").lower().replace("è", "e"))
    wanted = sorted({(i, t) for i, x in texts for t in terms if (w := plain(t)) and any(plain(x)[k : k + len(w)] == w for k in range(len(plain(x))))}, key=repr)
    frame, named = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    for most in (1 << 22, 8):
        assert sorted((tuple(r) for r in terms_in(frame, "id", "text", named, most).collect()), key=repr) == wanted


def test_ids_are_minted_once_across_batches_and_again_after_a_crash(spark, tmp_path):
    from granary.operators import minting

    path, batch = str(tmp_path / "ids"), lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    first = {r["key"]: r["id"] for r in minting.mint(batch("Red Onion", "red onion!", "Salt", "..."), "name", path, 0).collect()}
    assert first == {"red onion": "red-onion", "salt": "salt"}
    second = lambda: {r["key"]: r["id"] for r in minting.mint(batch("Salt", "Red  Onion", "Oil"), "name", path, 1).collect()}
    assert second() == {"red onion": "red-onion", "salt": "salt", "oil": "oil"} == second()
    assert minting.minted(spark, path).count() == 3


@pytest.mark.parametrize("name", ["duration_iso", "duration_english", "normalize_quantity", "parse_quantity_line", "safety_ladder", "all_match_flags"])
def test_queries_over_parts_meet_all_forms_of_their_inputs(spark, data, name):
    """As many kinds of results as the chosen inputs give, numbers aside."""
    kinds = lambda query: {re.sub(r"[0-9./|-]+", "", str([v for v in row[1:] if v not in (None, "")])).replace("''", "") for row in query(spark, data).collect()}
    shapes = lambda query: {tuple(v in (None, "", 0, "0") for v in row[1:]) for row in query(spark, data).collect()}
    over_parts, chosen = catalog.queries()[name], catalog.INPUTS[name][0]
    assert len(shapes(over_parts)) >= len(shapes(chosen))
    assert len(kinds(over_parts)) >= len(kinds(chosen))


def test_a_feed_is_made_from_records_that_are_written_once(spark, data):
    plan = catalog.queries()["feed_pages"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "supplier.parquet" not in plan and "ArrowEval" not in plan
    made = feed.feed_pages(feed.feed_records(records._feed_recipes(spark, data)), "r1", 10)
    assert made.selectExpr("sum(record_count) AS n").first()["n"] == feed.feed_records(records._feed_recipes(spark, data)).count()


def test_import_reads_a_name_once_and_gathers_no_title(spark, data):
    usages = spark.createDataFrame([("Rice", "cups"), ("rice", None), ("Rice", "cups"), (None, "cup"), ("Rice", "cup")], "name string, unit string")
    known = spark.createDataFrame([], "id string, name string, aliases array<string>, categories array<string>, seasons array<string>, default_unit string, allergens array<string>")
    counted = resolve.counted_usages(usages)
    assert counted.count() == 4
    shown = lambda df: sorted((r["key"], r["n_usages"], r["record"]["name"], r["record"]["default_unit"]) for r in df.collect())
    catalog = resolve.ingredient_catalog(counted, known)
    assert shown(catalog) == shown(resolve.ingredient_catalog(usages, known)) == [("rice", 4, "Rice", "cup"), ("unspecified ingredient", 1, "Unspecified ingredient", "cup")]
    foods = legacy.named_foods(counted.select("name"), catalog)
    assert sorted((r["name"] or "", r["ingredient_id"], r["food"]["name"]) for r in foods.collect()) == [
        ("", "unspecified-ingredient", "unspecified ingredient"), ("Rice", "rice", "rice"), ("rice", "rice", "rice")
    ]
    meals = spark.createDataFrame([(i, n, [("Rice", "1", "cup"), (None, "2", "")]) for i, n in [("a", "Soup"), ("b", "soup!"), ("c", "Pie")]], "id string, name string, ingredients array<struct<name: string, amount: string, unit: string>>")
    assert sorted((r["recipe_id"], r["pos"], r["ingredient_id"]) for r in legacy.meal_lines(meals, foods).collect()) == [(m, p, i) for m in "abc" for p, i in ((0, "rice"), (1, "unspecified-ingredient"))]
    _, _, audit = imports._import(spark, data)
    titles = audit.where("category = 'duplicateTitles'")
    assert "collect_list(struct(at" not in titles._jdf.queryExecution().optimizedPlan().toString() and titles.count() > 0


def test_segments_end_at_a_number_of_postings(spark, monkeypatch):
    monkeypatch.setattr(ranking, "POSTINGS", 1000)
    docs = [(i, " ".join(f"w{(i * 7 + j) % 500}" for j in range(i % 40))) for i in range(400)]
    found = ranking.index(spark.createDataFrame(docs, "id long, text string").repartition(1), "id", "text")
    sizes = found.where("word IS NOT NULL").groupBy("segment").agg(F.sum("n").alias("n")).collect()
    assert len(sizes) > 5 and max(r["n"] for r in sizes) < 1000 + 40
    assert found.where("word IS NULL").agg(F.sum("n").alias("n")).first()["n"] == len(docs)
    results, _ = ranking.search(found, spark.createDataFrame([(1, "w3 w4"), (2, "w499")], "q long, text string"), "q", "text")
    for q, t in ((1, "w3 w4"), (2, "w499")):
        assert [(r["key"], r["score"]) for r in results.where(F.col("query") == q).orderBy("rank").collect()] == exhaustive(docs, t, 10)


def test_rows_of_a_small_file_are_dealt_to_many_tasks(spark, data):
    assert catalog._t(spark, data, "part").rdd.getNumPartitions() == 1
    assert catalog.queries()["recipe_facts"](spark, data).rdd.getNumPartitions() == 8
