import json

import pytest
from pyspark.sql import functions as F

from granary.functions import numbers, rules, text, urls
from granary.operators import candidates, gates, materialize, personal, publish, resolve, search, similarity
from granary.sources import records
from granary.streaming import ledgers


def value(spark, column, **cells):
    types = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cells.items()) or "x string"
    return spark.createDataFrame([tuple(cells.values()) or ("",)], types).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("line", "item", "quantity", "unit", "preparation"),
    [
        ("1 (14 ounce) can sweetened condensed milk", "sweetened condensed milk", "1", "can", "14 ounce"),
        ("350g plums, halved and destoned", "plums", "350", "g", "halved and destoned"),
        ("½ cinnamon stick", "cinnamon stick", "1/2", "", ""),
        ("2 to 3 cups chopped peeled onion", "onion", "2-3", "cups", "chopped peeled"),
        ("", "unknown ingredient", "", "", ""),
    ],
)
def test_lines(spark, line, item, quantity, unit, preparation):
    got = value(spark, numbers.parse_line(F.col("x")), x=line)
    assert (got.item, got.quantity, got.unit, got.preparation) == (item, quantity, unit, preparation)


@pytest.mark.parametrize(("english", "minutes"), [("1 hour 5 minutes", 65), ("2 hours 45 minutes", 165), ("4 hrs 15 min", 255), ("", None), ("about 20", 20)])
def test_english_minutes(spark, english, minutes):
    assert value(spark, numbers.english_minutes(F.col("x")), x=english) == minutes


@pytest.mark.parametrize(("iso", "minutes"), [("PT10M", 10), ("PT1H30M", 90), ("P1DT1M", 1441), ("PT5S", 0), (None, 0)])
def test_iso_minutes(spark, iso, minutes):
    assert value(spark, numbers.iso_minutes(F.col("x")), x=iso) == minutes


def test_quantities(spark):
    assert value(spark, numbers.quantity_value(F.col("x")), x="1 1/2") == 1.5
    assert value(spark, numbers.quantity_value(F.col("x")), x="unit") is None
    assert value(spark, numbers.yield_quantity(F.col("x")), x="4-6+") == 4
    assert value(spark, numbers.inferred_yield(F.col("x")), x="Platter | 2-4 Servings").asDict() == {"quantity": 4, "unit": "servings", "inferred": True, "reason": "source range"}
    assert value(spark, numbers.normal_unit(F.col("x")), x="cups") == "cup"
    assert value(spark, numbers.strict_date(F.col("x")), x="2026-02-30") is None


def test_text(spark):
    assert value(spark, text.plain_text(F.col("x")), x="Fast&nbsp;&amp; easy&#33;") == "Fast & easy!"
    assert value(spark, text.slug(F.col("x")), x="Jalapeño") == "jalapen-o"
    assert value(spark, text.slug(F.col("x"), fold=True), x="Jalapeño") == "jalapeno"
    assert value(spark, text.lookup_key(F.col("x")), x="Egg® (optional)") == "egg"
    assert value(spark, text.ngrams(text.tokens(F.col("x")), 3), x="a b") == []
    assert value(spark, text.contains_term(F.col("x"), "egg"), x="two eggs") is False
    assert value(spark, text.display_name(F.col("x")), x="  red   onion ") == "Red onion"
    nodes = text.json_ld_nodes('<script type="application/ld+json">[{"@type":["Thing","RECIPE"],"name":"x"}]</script>')
    assert [json.loads(n)["name"] for n in nodes] == ["x"]


def test_addresses(spark):
    one = lambda f, x: value(spark, f(F.col("x")), x=x)
    assert one(urls.canonical, "https://a.example/p/?z=1&utm_source=q&b=2#top") == "https://a.example/p/?b=2&z=1"
    assert one(urls.canonical, "https://a.example/p?gclidx=1") == "https://a.example/p?gclidx=1"
    assert one(urls.publishable, "HTTPS://www.A.example/x?q=1#f") == "https://a.example/x?q=1"
    assert one(urls.publishable, "ftp://a.example/") is None
    assert one(urls.host, "WWW.Shop.example/x") == "shop.example"
    assert urls.links_of("<loc lang=x>\nhttps://H.example/a?x=1&amp;y=2 </loc><a href=b>x</a><a href='/a é'>y</a><a href='b'>z</a><a href='http://'>n</a>", "https://h.example/d/") == [
        "https://H.example/a?x=1&y=2", "https://h.example/d/b", "https://h.example/a%20%C3%A9",
    ]
    groups = urls.robots_groups("User-agent: *\nDisallow: /x\n\nUser-agent: *\nAllow: /x/y\nCrawl-delay: 2", "bot")
    assert groups == {"allow": ["/x/y"], "disallow": ["/x"], "delay_ms": 2000}


def test_rules(spark):
    assert value(spark, rules.meal_type(F.col("x")), x="Summer Tomato Salad with bread") == "salad"
    assert value(spark, rules.action(F.col("x")), x="whole wheat dough") == "preheat"
    assert value(spark, rules.allergens(F.col("x")), x="flour and cream") == ["milk", "wheat"]
    assert value(spark, rules.clauses(F.col("x")), x=["Mix well. Chill for 5 minutes; serve"]) == ["Mix well", "Chill for 5 minutes", "serve"]
    for prose, step, mode in ((8, 15, "pass"), (25, 40, "model"), (55, 75, "hold")):
        assert value(spark, rules.disposition(F.lit(prose), F.lit(step), F.array().cast("array<string>"), F.lit(False)))["mode"] == mode


def test_actions_read_a_clause_once(spark):
    terms = [x if x.endswith(")") else x + rules.E for _, p in rules.ACTIONS for x in p.split("|")]
    rules_of = [(label, "(?i)(?:" + "|".join(x if x.endswith(")") else x + rules.E for x in p.split("|")) + ")") for label, p in rules.ACTIONS]
    words = [t.split("(")[0].replace("[éÉ]", "É") for t in terms]
    clauses = [a + b for i, a in enumerate(words) for b in ("", "ed", " x", "é", *(sep + words[(i * 7 + k) % len(words)] for k in range(1, 9) for sep in (" ", "", "-")))]
    rows = spark.createDataFrame([(c,) for c in [*clauses, "", "stop", None]], "c string").repartition(8)
    got = rows.select(rules.action(F.col("c")).alias("a"), rules.first_match(F.col("c"), rules_of, "prepare").alias("b"))
    assert got.where("NOT a <=> b").count() == 0 and got.select("a").distinct().count() == len(rules.ACTIONS) + 1
    plan = got.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("regexp_extract_all(") == 1


def test_facts_parse_their_json_once(spark):
    text_of = lambda n: json.dumps({"name": n, "yield": {"quantity": 1}, "ingredient_lines": ["1 egg", "2 cups flour", " "], "instruction_lines": ["Beat eggs; add flour", "", None]})
    found = spark.createDataFrame([(text_of("Cake"),), (None,)], "x string").select(candidates.facts(F.from_json("x", candidates.EXTRACTED)).alias("f"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    cake, nothing = (r["f"] for r in found.collect())
    assert (cake.status, cake.meal_type, [(o.action, o.ingredients) for o in cake.operations]) == ("usable", "dessert", [("whisk", []), ("add", ["flour"])])
    assert (nothing.status, nothing.base_name, nothing.ingredients, nothing.operations) == ("skip", "", [], [])


def test_similarity_of_equal_steps_is_100(spark):
    assert value(spark, similarity.max_step_percent(F.col("a"), F.col("b")), a=["mix the two parts"], b=["x y z", "Mix the two parts!"]) == 100.0
    assert value(spark, similarity.max_step_percent(F.col("a"), F.col("b")), a=[], b=["x"]) == 0.0


def test_quota_and_share(spark):
    rows = spark.createDataFrame([(i, "h", i != 1) for i in range(5)], "i long, h string, ok boolean").repartition(7)
    got = {r.i: r.accepted for r in gates.within_quota(rows, "h", "i", F.col("ok"), 2).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False}
    mixed = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(12)], "i long, h string").repartition(5)
    kept = [(r.i, r.accepted) for r in gates.share_gate(mixed, "h", "i", 60.0, 8).orderBy("i").collect()]
    assert kept[:8] == [(i, i < 7) for i in range(8)]


def test_share_gate_against_a_plain_fold(spark):
    import random

    rng = random.Random(7)
    for turn in range(4):
        rows = [(i * 3, rng.choice("aaaabbcdefgh"), rng.random() < 0.9, rng.choice([None, 6])) for i in range(150)]
        caps = {h: rng.choice([None, None, 9]) for h in "abcdefgh"}
        rows = [(i, h, ok, caps[h]) for i, h, ok, _ in rows]
        known = {"a": 5, "c": 2} if turn % 2 else {}
        share, least, counts, total, wanted = (25.0, 40.0)[turn // 2], 30, dict(known), sum(known.values()), {}
        for i, h, ok, cap in rows:
            n = counts.get(h, 0)
            good = ok and (cap is None or n + 1 <= cap) and (total + 1 < least or (n + 1) / (total + 1) * 100 <= share)
            wanted[i] = (n, total, good)
            counts[h], total = n + good, total + good
        df = spark.createDataFrame(rows, "i long, h string, ok boolean, cap int").repartition(5)
        held = spark.createDataFrame(list(known.items()), "h string, n long")
        got = gates.share_gate(df, "h", "i", share, least, held, "ok", "cap").collect()
        assert {r.i: (r.before, r.total, r.accepted) for r in got} == wanted


def test_an_ambiguous_alias_is_an_error(spark):
    records_ = spark.createDataFrame([("first", "First", ["shared"]), ("second", "Second", ["Shared!"])], "id string, name string, aliases array<string>")
    index = resolve.alias_index(records_, "id", ["id", "name"], ["aliases"])
    assert [r.key for r in resolve.ambiguous(index).collect()] == ["shared"]
    with pytest.raises(Exception, match="ambiguous alias"):
        resolve.checked(index).collect()
    assert resolve.checked(index.where("key <> 'shared'")).count() == 2


def test_a_failed_build_leaves_the_old_feed(spark, tmp_path):
    from granary.operators import feed
    from granary.plans.records import _feed_recipes

    recipes, out = _feed_recipes(spark, "/root/testdata/sf0.001"), str(tmp_path / "feed")
    first = feed.build_feed(recipes, out, "r1", "2026-01-01T00:00:00.000Z", 4)
    assert first["total_records"] == sum(p["record_count"] for p in first["pages"]) > 4
    with pytest.raises(Exception, match="duplicate"):
        feed.build_feed(recipes.union(recipes), out, "r2", "2026-01-02T00:00:00.000Z", 4)
    assert feed.read_manifest(spark, out) == first
    assert [r.problem for r in feed.feed_problems(spark, out).collect()] == []
    page = next((tmp_path / "feed/pages/file=page-00001.json").glob("part-*"))
    page.write_text(page.read_text() + " ")
    for crc in page.parent.glob(".*.crc"):
        crc.unlink()
    assert [r.problem for r in feed.feed_problems(spark, out).collect()] == ["page-00001.json hash does not match declared sha256"]
    empty = feed.build_feed(recipes.limit(0), out, "r3", "2026-01-03T00:00:00.000Z", 4)
    assert (empty["total_records"], empty["pages"]) == (0, [])
    with pytest.raises(ValueError, match="release"):
        feed.build_feed(recipes, out, " ", "t")


def test_reused_ids_are_refused(spark, tmp_path):
    from granary.operators import legacy

    (tmp_path / "a.json").write_text('[{"id": "x"}, {"id": "x"}]')
    with pytest.raises(Exception, match="unique id"):
        records.json_array(spark, str(tmp_path / "a.json"), "struct<id: string>").collect()
    (tmp_path / "b.json").write_text('{"id": "x"}')
    with pytest.raises(Exception, match="top-level JSON array"):
        records.json_array(spark, str(tmp_path / "b.json"), "struct<id: string>").collect()
    meals = spark.createDataFrame([("a", "x"), ("a", "y")], "id string, name string")
    with pytest.raises(Exception, match="unique id"):
        legacy.checked_meals(meals).collect()
    with pytest.raises(ValueError, match="attestation"):
        from granary.operators import staging

        staging.manual_promotion(meals, meals, attested=False)


def test_minted_ids_ignore_order(spark):
    rows = spark.createDataFrame([("s1", "same"), ("s2", "same"), ("s3", "one")], "k string, b string")
    a, b = (sorted(map(tuple, resolve.minted_ids(r, "k", "b", "k").collect())) for r in (rows, rows.repartition(7)))
    assert a == b
    assert [x[2] for x in a if x[1] == "one"] == ["one"]


def test_pages_are_stable(spark):
    rows = spark.createDataFrame([(f"{i:03}", "x") for i in range(25)], "k string, v string").repartition(7)
    pages = publish.manifest(publish.paged(rows, "k", 10), "k", F.col("v")).orderBy("page").collect()
    assert [(p.first_id, p.last_id, p.n) for p in pages] == [("000", "009", 10), ("010", "019", 10), ("020", "024", 5)]


def test_last_wins_keeps_first_place(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "i long, k string")
    assert {(r.k, r.i, r.first_at) for r in search.last_wins(rows, "k", "i").collect()} == {("a", 2, 0), ("b", 1, 1)}


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": "x"}')
    (tmp_path / "in/b.json").write_text("{broken")
    schema = spark.createDataFrame([], "id string").schema
    good, bad = records.bundle(spark, str(tmp_path / "in"), schema)
    assert [r.id for r in good.collect()] == ["x"]
    assert bad.count() == 1
    (tmp_path / "l.jsonl").write_text('{"url": "u"}\n\nnope\n')
    assert [r.url for r in records.ledger(spark, str(tmp_path / "l.jsonl"), "url string").collect()] == ["u"]
    pages = str(tmp_path / "pages")
    for batch in (["https://a.example/#x", "https://b.example/"], ["https://a.example/?utm_source=1", "https://c.example/"]):
        spark.createDataFrame([(u,) for u in batch], "url string").write.mode("append").parquet(pages)
        ledgers.run_available(ledgers.new_addresses(spark, pages, "url string"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.canonical_url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["https://a.example/", "https://b.example/", "https://c.example/"]


def test_terms_of_any_length_are_found(spark):
    from granary.operators.similarity import terms_in

    texts = spark.createDataFrame([(1, "we ate Old Mill Stone Ground Flour today"), (2, "stone ground")], "doc_id long, text string")
    terms = spark.createDataFrame([("old mill stone ground flour",), ("Stone Ground",), ("today",), ("",)], "term string")
    got = {(r.doc_id, r.term) for r in terms_in(texts, "doc_id", "text", terms).collect()}
    assert got == {(1, "old mill stone ground flour"), (1, "Stone Ground"), (1, "today"), (2, "Stone Ground")}
    assert terms_in(texts, "doc_id", "text", terms.where("term = ''")).count() == 0


@pytest.mark.parametrize(("page", "file"), [("7", "page-00007.json"), ("12345", "page-12345.json"), ("123456", "page-123456.json"), (None, None)])
def test_page_names_keep_all_digits(spark, page, file):
    assert value(spark, text.page_name(F.col("x").cast("long")), x=page) == file


def planned(spark, column):
    return spark.createDataFrame([("x",)], "x string").select(column.alias("v"))._jdf.queryExecution().analyzed().toJSON()


def test_allergens_are_looked_for_once_a_row(spark):
    diets = F.array(*map(F.lit, ("vegan", "nut-free", "vegetarian")))
    asked = lambda column: planned(spark, column).count("almond")
    assert asked(rules.reconciled_diets(diets, rules.allergens(F.col("x")))) == asked(rules.allergens(F.col("x")))
    assert value(spark, rules.reconciled_diets(diets, rules.allergens(F.col("x"))), x="almond milk") == ["vegetarian"]


def test_a_document_is_read_once_however_often_it_is_changed(spark):
    document = personal.read_document(F.col("x"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    for i in range(4):
        document = personal.added(document, F.lit(f"i{i}"), F.lit("r"), F.lit("Monday"), F.lit(1))
    assert len(planned(spark, personal.with_filters(document, season=F.lit("fall")))) < 3 * len(planned(spark, personal.read_document(F.col("x"), F.col("x"), F.col("x"))))
    assert [i["position"] for i in value(spark, document, x="{broken")["meal_plans"][0]["items"]] == [0, 1, 2, 3]


def test_a_record_asks_for_each_allergen_once(spark):
    none = "array<string>"
    food = "array<struct<item: string, quantity: string, unit: string, preparation: string, optional: boolean>>"
    draft = f"struct<name: string, subtitle: string, description: string, meal_type: string, cuisine: string, yield: struct<quantity: double, unit: string>, times: struct<prep_minutes: int, cook_minutes: int, inactive_minutes: int>, ingredients: {food}, instructions: array<struct<text: string, timer_minutes: int>>, tags: {none}, seasons: {none}, dietary: {none}, allergens: {none}, equipment: {none}>"
    drafts = spark.createDataFrame([], f"key string, source struct<name: string, url: string>, draft {draft}, ingredients {food}")
    known, taken = spark.createDataFrame([], f"id string, name string, aliases {none}"), spark.createDataFrame([], "id string")
    plan = materialize.materialized(drafts, known, taken, F.lit("2026-01-01"))._jdf.queryExecution().analyzed().toJSON()
    assert plan.count("almond") == planned(spark, rules.allergens(F.col("x"))).count("almond")
