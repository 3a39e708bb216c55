import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from granary.llm import ann, bpe, mixing, pii, quality, queries, setjoin, sharding, suffix_tree, token_store, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, rank int"
LONG = "alpha beta " * 3000


def private(docs):
    return pii.pseudonymized(docs, "a key")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns with clashing names."""
    texts = [None, "", " \n", "One two three four five six", "one TWO three four five six", "x", LONG, "a" * 5000, "call +1 (456) 555-2186 or 4111111111111111"]
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 3}", None, "clash", None, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[4:6], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, data, duck, name):
    got, wanted = queries.queries()[name](spark, data).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    if "refers_to" in got:  # null in most rows
        got, wanted = got.astype({"refers_to": "Int64"}), wanted.astype({"refers_to": "Int64"})
    assert rows_of(got) == rows_of(wanted[list(got.columns)])


def test_odd_rows_keep_their_rows(odd):
    path = queries.tokenizer_path()
    n = odd.count()
    for f in (mixing.mix, suffix_tree.score, setjoin.near_duplicates, sharding.interleave, lambda d: token_store.tokens_round_trip(d, path), lambda d: bpe.encode_decode(d, path), quality.ledger, private):
        assert f(odd).count() == n
    assert set(quality.keep_good(odd).columns) == set(odd.columns)
    assert mixing.mixed_texts(odd).columns == odd.columns
    assert setjoin.one_of_each(odd).columns == odd.columns


def test_empty_tables_give_no_rows(spark, none):
    path = queries.tokenizer_path()
    for f in (mixing.mix, mixing.mixed_texts, suffix_tree.score, setjoin.near_duplicates, setjoin.one_of_each, sharding.interleave, lambda d: token_store.tokens_round_trip(d, path), lambda d: bpe.encode_decode(d, path), quality.ledger, quality.keep_good, private):
        assert f(none).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mixture_takes_what_the_plan_says(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = mixing.mix(docs).toPandas()
    assert (plan.taken <= 2 * plan["size"]).all()
    by_source = plan.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
    assert ((by_source.taken - by_source.target).abs() <= 0.02 * by_source.target + 2).all()
    got = Counter()
    for row in mixing.mixed_texts(docs).select("doc_id", "text").collect():
        got[row.doc_id] += len(WORD.findall(row.text))
    assert got == Counter({r.doc_id: r.taken for r in plan.itertuples() if r.taken})


def test_shards(spark, data):
    got = sharding.interleave(spark.read.parquet(f"{data}/documents.parquet")).toPandas()
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    each = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (each.max(axis=1) - each.min(axis=1) <= 2).all()


def test_suffix_tree_base_is_exact_and_the_model_is_better(spark, data):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    tokens = {k: [*WORD.findall(t.translate(LOWER)), None] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    counts = Counter(t for k, ts in tokens.items() if not held[k] for t in ts)
    n, v = sum(counts.values()), len(counts)
    for options in ({}, {"hot_size": 300}):
        got = suffix_tree.score(spark.read.parquet(f"{data}/documents.parquet"), **options).toPandas()
        for r in got.itertuples():
            base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[r.doc_id])
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), sum(counts[t] > 0 for t in tokens[r.doc_id]), n)
            assert r.base_score == pytest.approx(base, rel=1e-9)
        test = got[got.held_out]
        assert test.score.sum() > test.base_score.sum()


def plain_tree(texts, depth, fewest=16, least=8):
    """A function from a text's tokens to log10 of its probability by the suffix tree of texts, with plain dictionaries."""
    counts = Counter(t for text in texts for t in text)
    n, v = sum(counts.values()), len(counts)
    p = lambda context, s: (counts[s] + 0.5) / (n + 0.5 * (v + 1))
    states = [{} for _ in range(depth + 1)]

    def contexts(text, i, d):
        return tuple((["<start>"] + text)[i + 1 - d : i + 1]) if i >= d - 1 else None

    def prob(context, s, upto):
        out = p(None, s)
        for d in range(1, min(upto, len(context)) + 1):
            state = states[d].get(context[-d:])
            if state is not None:
                total, listed = state
                out = (listed.get(s, 0) + (total - sum(listed.values()) + len(listed)) * out) / (total + len(listed))
        return out

    for d in range(1, depth + 1):
        seen = {}
        for text in texts:
            for i, s in enumerate(text):
                if (c := contexts(text, i, d)) is not None:
                    seen.setdefault(c, Counter())[s] += 1
        for c, after in seen.items():
            total, listed = sum(after.values()), {s: k for s, k in after.items() if k >= least}
            if total < fewest or not listed or (d > 1 and c[1:] not in states[d - 1]):
                continue
            parent = {s: prob(c, s, d - 1) for s in listed}
            rest = total - sum(listed.values())
            gain = sum(2 * k * math.log(k / (total * parent[s])) for s, k in listed.items())
            gain += 2 * rest * math.log(rest / (total * max(1e-9, 1 - sum(parent.values())))) if rest else 0
            if gain > len(listed) + 3 * math.sqrt(2 * len(listed) + 1):
                states[d][c] = (total, listed)
    for context in [c for state in states for c in list(state)[:40]]:
        # all known tokens and one more, any unknown one
        assert sum(prob(context, s, depth) for s in [*counts, "<unknown>"]) == pytest.approx(1)
    return states, lambda text: sum(math.log10(prob(next(c for k in range(depth, 0, -1) if (c := contexts(text, i, k)) is not None), s, depth)) for i, s in enumerate(text))


@pytest.mark.parametrize(("depth", "hot"), [(2, {}), (4, {"hot_size": 50, "hot_values": 20})])
def test_suffix_tree_against_plain_dictionaries(spark, data, monkeypatch, depth, hot):
    if hot:
        # contexts that are dealt to many buckets by their symbols
        monkeypatch.setattr(suffix_tree, "OFTEN", 40)
        monkeypatch.setattr(suffix_tree, "BUCKET", 300)
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    rng = random.Random(8)
    pairs = [(f"a{i}", f"b{i}") for i in range(9_000 if depth == 2 else 300)]
    made = [(10_000 + k, " ".join(w for p in rng.sample(pairs, len(pairs)) for w in p)) for k in range(24)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(made, docs.select("doc_id", "text").schema)).cache()
    tokens = {r.doc_id: [*WORD.findall((r.text or "").translate(LOWER)), None] for r in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    states, wanted = plain_tree([t for k, t in tokens.items() if not held[k]], depth)
    # more than 16,384 words, each with a state of its own
    assert all((a,) in states[1] for a, _ in pairs)
    for r in suffix_tree.score(docs, depth=depth, **hot).collect():
        assert r.score == pytest.approx(wanted(tokens[r.doc_id]), rel=1e-9), r.doc_id


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((900, 16)).astype(np.float32)
    vectors[300:340] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(950, None), (1000, [0.0] * 16), (1050, [float("nan")] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    wide = vectors.astype(np.float64)
    hits = 0
    for q in range(0, 900, 50):
        cos = (wide * wide[q]).sum(axis=1) / (np.sqrt((wide * wide).sum(axis=1)) * math.sqrt((wide[q] * wide[q]).sum()))
        order = [i for i in np.lexsort((np.arange(900), -cos)) if i != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        hits += len(set(mine.vec_id) & set(order))
        assert np.allclose(mine.score, cos[mine.vec_id], atol=1e-12)
    assert hits >= 0.9 * 90
    assert list(got[got.query_id == 50].sort_values("rank").vec_id) == [300, 301, 302, 303, 304]


def clustered(n, dim, rng):
    return (rng.standard_normal((n // 100, dim))[rng.integers(0, n // 100, n)] + 0.3 * rng.standard_normal((n, dim))).astype(np.float32)


def recall_of(tree, vectors, every, k=5):
    unit = vectors.astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    hits = 0
    for q in range(0, len(vectors), every):
        cos = unit @ unit[q]
        cos[q] = -2
        hits += len({v for _, v in tree.nearest(q, vectors[q], k)} & set(np.argpartition(-cos, k)[:k].tolist()))
    return hits / (k * -(-len(vectors) // every))


@pytest.mark.parametrize(("kind", "opened", "verified"), [("clustered", 0.25, 0.1), ("isotropic", 1.0, 0.75)])
def test_the_chi_square_stop_leaves_leaves_unread_and_recall_holds(kind, opened, verified):
    rng = np.random.default_rng(9)
    vectors = clustered(50_000, 64, rng) if kind == "clustered" else rng.standard_normal((50_000, 64)).astype(np.float32)
    tree = ann.Tree(np.arange(50_000), vectors, 5)
    recall = recall_of(tree, vectors, 500)
    shares = tree.opened / (100 * (len(tree.cuts) - 1)), tree.verified / (100 * 50_000)
    print(f"{kind}: recall {recall}, leaves opened {shares[0]:.3f}, rows verified {shares[1]:.3f}")
    assert recall >= 0.9
    assert shares[0] <= opened
    assert shares[1] <= verified


def test_cells_route_queries_and_recall_holds(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 500)
    vectors = clustered(12_000, 32, np.random.default_rng(3))
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")).toPandas()
    wide = vectors.astype(np.float64)
    unit = wide / np.sqrt((wide * wide).sum(axis=1))[:, None]
    hits = 0
    for q, mine in got.groupby("query_id"):
        cos = unit @ unit[q]
        cos[q] = -2
        hits += len(set(mine.vec_id) & set(np.argpartition(-cos, 5)[:5].tolist()))
    assert len(got) == 5 * 240
    assert hits >= 0.9 * 5 * 240


def test_neighbours_of_odd_rows(spark):
    kind = "rank int, vec_id long, embedding array<double>, score string"
    east, north, rows = [1.0, 0.0], [0.0, 1.0], []
    rows += [(1, 0, east, "x"), (2, 0, east, None), (3, 1, [2.0, 0.1], "x"), (4, 1, [2.0, 0.1], "x"), (5, 2, north, "x"), (6, 2, [1.0, 0.2], "x")]
    rows += [(7, 3, None, "x"), (8, 4, [], "x"), (9, 5, [0.0, 0.0], "x"), (10, 6, [1.0, None], "x"), (11, 7, [1.0, math.inf], "x"), (12, None, east, "x"), (13, 50, [1.0, 1.0, 1.0], "x"), (14, 8, [-1.0, 0.0], "x")]
    got = sorted(ann.nearest(spark.createDataFrame(rows, kind)).collect())
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b))
    # 50 has no candidate of its length; each id is listed once, by its better vector
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 8)]
    assert [r.score for r in got] == pytest.approx([cos(east, [2.0, 0.1]), cos(east, [1.0, 0.2]), -1.0])


def test_warc_segments_come_back(spark, tmp_path):
    pages = [(1, "https://a.example/ ü", "é" * 90_000), (2, None, None), (3, "u", ""), (4, "u", "x"), (9, "u", "é" * 90_000), (4, "u", "y")]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(docs, str(tmp_path / "w"), segment=1000, archives=3)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(1, "revisit", 9), (2, "revisit", 3), (3, "response", None), (4, "response", None), (9, "response", None), (4, "response", None)])
    big = next(r for r in got if r.page_id == 9)
    assert bytes(big.payload) == ("é" * 90_000).encode()
    assert big.payload_digest == base64.b32encode(hashlib.sha1(big.payload).digest()).decode()
    with pytest.raises(ValueError, match="missing"):
        warc.assemble([(1, None, b"a"), (3, 2, b"b")])
    with pytest.raises(ValueError, match="total"):
        warc.assemble([(1, None, b"a"), (2, 3, b"b")])


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(5)
    told_apart = 0
    for _ in range(400):
        pool = rng.integers(0, 2**64, size=int(rng.integers(1, 400)), dtype=np.uint64)
        share = rng.uniform(0.3, 1)
        x, y = (np.unique(pool[rng.random(len(pool)) < share]) for _ in range(2))
        if len(x) and len(y):
            both = len(np.intersect1d(x, y))
            linked = 100 * both >= 75 * (len(x) + len(y) - both)
            kept = setjoin._may_be_linked(setjoin._sketch(x), setjoin._sketch(y))
            assert kept or not linked
            told_apart += not kept
    assert told_apart > 100


def test_near_copies_against_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10_000)}" for _ in range(60)] for _ in range(6)]
    shared = [f"p{i}" for i in range(55)]
    texts = {}
    for i in range(160):
        words = list(base[i % 6]) + (shared if i % 5 == 0 else [])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"e{rng.randrange(50)}"
        texts[i] = " ".join(words).title() if i % 2 else "\n".join(words)
    texts |= {200: "few words", 201: "Few  words", 202: "", 203: None}

    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = setjoin.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), find(i)) for i in texts}


def test_a_long_chain_is_one_component(spark):
    rng = random.Random(4)
    ids = rng.sample(range(1_000, 9_000), 700)
    # each text has 12 shingles and shares 11 with the next (11/13), 10 with the one after (10/14): a chain
    chain = {ids[i]: " ".join(f"w{j}" for j in range(i, i + 16)) for i in range(400)}
    chain |= {ids[i]: " ".join(f"v{j}" for j in range(i, i + 16)) for i in range(400, 700)}
    got = setjoin.near_duplicates(spark.createDataFrame(list(chain.items()), "doc_id long, text string")).collect()
    first, second = min(ids[:400]), min(ids[400:])
    assert {r.doc_id: r.component_id for r in got} == {d: first if k < 400 else second for k, d in enumerate(ids)}


@pytest.mark.parametrize("order", ["rising", "falling", "shuffled"])
def test_components_of_paths_stars_and_rings(spark, order):
    n = 600
    names = list(range(n))
    if order != "rising":
        names = names[::-1] if order == "falling" else random.Random(6).sample(names, n)
    path = [(i, i + 1) for i in range(299)]
    star = [(300, i) for i in range(301, 400)]
    ring = [(i, i + 1) for i in range(400, 599)] + [(599, 400)]
    links = [(names[a], names[b]) for a, b in path + star + ring]
    low = [min(names[a:b]) for a, b in ((0, 300), (300, 400), (400, 600))]
    wanted = {names[i]: low[0] if i < 300 else low[1] if i < 400 else low[2] for i in range(n)}
    got = setjoin.components(spark.createDataFrame(links, "x long, y long").repartition(4)).collect()
    assert len(got) == n
    assert {r.fp: r.label for r in got} == wanted


def test_token_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 3000):
        values = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
        values[n // 2 : n // 2 + 1] = 2**32 - 1
        frame, after = token_store.read_frame(token_store.frame([5, None], [values.tobytes(), b""], 0))
        assert (token_store.unpack(frame)[:n] == values).all()
        assert (token_store.read_range(frame, n // 3, n) == values[n // 3 :]).all()


def test_tree_concatenation_equals_the_library():
    coder, rng = bpe.codec(queries.tokenizer_path()), random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "中", "'s", "1", "23", ".", "!!", "the", "tion", "<|endoftext|>", "\xa0", "🙂", "_", "\x1c", "\x85", "ab" * 40, "\n\n\n"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        wanted = coder.library.encode(text, add_special_tokens=False).ids
        for leaf in (bpe.LEAF, 5, 16, 40):
            assert np.frombuffer(coder.encode(text, leaf), "<u4").tolist() == wanted, text
        assert coder.decode(np.array(wanted)) == coder.library.decode(wanted, skip_special_tokens=False)


def test_ids_of_documents(spark, data):
    path = queries.tokenizer_path()
    docs, coder = spark.read.parquet(f"{data}/documents.parquet"), bpe.codec(path)
    encoded = {r.doc_id: r for r in bpe.encode_decode(docs, path, leaf=3000).collect()}
    stored, place = {r.doc_id: r for r in token_store.tokens_round_trip(docs, path).collect()}, 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(coder.library.encode(r.text, add_special_tokens=False).ids, dtype="<u4")
        one, two = encoded[r.doc_id], stored[r.doc_id]
        assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
        whole = np.append(ids, 0).astype("<u4")
        assert (two.start, two.n_tokens, two.ids_crc32) == (place, len(whole), zlib.crc32(whole.tobytes()))
        place += len(whole)


def test_pseudonyms_keep_formats_and_links(spark):
    text = "mail ab.12@mail1.example.com, call +1 (456) 555-2186, card 4111111111111111 not 4111111111111112, ip 10.20.30.40 not 999.1.1.1, ssn 123-45-6789, on 1999-12-31 and 31.12.1999 not 2024-13-45"
    rows = spark.createDataFrame([(1, text), (2, text.replace("mail ", "m ")), (3, "clean 123 text"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in private(rows).collect()}
    assert got[3].text == "clean 123 text"
    assert got[4].text is None
    assert (got[1].n_private, got[3].n_private, got[4].n_private) == (7, 0, 0)
    assert got[2].text == got[1].text.replace("mail ", "m ", 1)
    for gone in ("ab.12@", "(456)", "4111111111111111", "10.20.30.40", "123-45-6789", "1999-12-31", "31.12.1999"):
        assert gone not in got[1].text
    for stays in ("+1 (", "4111111111111112", "999.1.1.1", "2024-13-45"):
        assert stays in got[1].text
    card = re.search(r"card (\d{16})", got[1].text)[1]
    digits = [int(c) for c in card[::-1]]
    assert sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"on (19|20)\d\d-\d\d-\d\d and \d\d\.\d\d\.(19|20)\d\d", got[1].text)


def test_small_permutations_are_bijections(spark):
    sql = pii.number_feistel("id", 7, 9, "k", "t")
    assert spark.range(63).select(F.expr(sql).alias("v")).distinct().count() == 63
    pairs = spark.range(100).select(F.expr(pii.feistel("lpad(id, 2, '0')", "k", "t")).alias("v"))
    assert pairs.distinct().count() == 100


def test_ablations_add_up(spark, data):
    entries = quality.ledger(spark.read.parquet(f"{data}/documents.parquet"))
    kept = quality.judge(entries).where("kept").count()
    for row in quality.ablations(entries).collect():
        assert row.n_kept_without == kept + row.n_only


def test_pipeline_keeps_columns_and_order(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept, columns = docs, docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.written(stage(spark, kept, data), "stage")
        assert kept.columns == columns
        assert kept.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert not kept.where("text RLIKE '@mail[0-9]+.example.com'").join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").where(
        F.regexp_extract("text", "([a-z]+[.][0-9]+@mail)", 1) == F.regexp_extract("old", "([a-z]+[.][0-9]+@mail)", 1)
    ).count()
    coder = bpe.codec(queries.tokenizer_path())
    wanted = Counter((r.doc_id, len(coder.library.encode(r.text, add_special_tokens=False).ids)) for r in kept.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, data).collect()) == wanted
