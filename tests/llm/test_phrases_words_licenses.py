"""Collocations, spelling variants and license scans against plain Python versions of what they compute."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from granary.llm import collocations, licenses, queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, word string, n long, gram string, taken int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", 2) for i, t, lang in rows], DOCS)


# collocations


def plain_collocations(rows, fewest, most):
    out = []
    for lang in {"und" if r[2] is None else r[2] for r in rows}:
        f, n = Counter(), 0
        for _, text, own in rows:
            if ("und" if own is None else own) == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
                    words = re.findall(r"[^\x20\x09]+", piece)
                    n += len(words)
                    f.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
        held = {g: c for g, c in f.items() if len(g) > 1 and c >= fewest}
        hidden = {g[i : i + m] for g, c in held.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if 100 * c >= 80 * held[g[i : i + m]]}
        found = []
        for g, a in held.items():
            if g not in hidden:
                score, _, left, right = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def got_collocations(docs, fewest, most):
    return sorted(tuple(r) for r in collocations.collocations(docs, fewest, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some_texts(seed, n=300):
    dice = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "été", "x\x00", "日本", "to", "be", "or", "not", "10%"]
    gaps = [" "] * 9 + ["  ", "\t", ". ", ",", "\n", "\r\n", "!?", " \x0b", "\xa0"]
    rows = []
    for i in range(n):
        text = "".join(dice.choice(words) + dice.choice(gaps) for _ in range(dice.choice([0, 1, 3, 30, 90])))
        rows.append((i, text, dice.choice(["en", "en", "en", "de", None, "und", ""])))
    return [*rows, (1, None, "en"), (2, "", None), (2, "to be or not to be", "en"), (None, " \t\n.", "xx")]


@pytest.mark.parametrize(("fewest", "most"), [(2, 5), (10, 2000), (30, 2000)])
def test_collocations_equal_plain_counts(spark, fewest, most):
    rows = some_texts(fewest)
    assert got_collocations(frame(spark, rows), fewest, most) == plain_collocations(rows, fewest, most)


def test_collocations_of_hot_prefixes_and_many_parts(spark, monkeypatch):
    rows = [(i, "of the " * 40 + f"w{i % 7} w{i % 3}, " + "of the w1 w2 " * 5, "en") for i in range(60)]
    # every prefix with a tenth of the pairs is dealt out, and ranks are taken in several turns
    monkeypatch.setattr(collocations, "HOT", 10)
    monkeypatch.setattr(collocations, "HELD", 1)
    monkeypatch.setattr(collocations, "RANKED", 8)
    assert got_collocations(frame(spark, rows).repartition(5), 3, 4) == plain_collocations(rows, 3, 4)


def test_collocations_of_nothing_and_of_a_long_text(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (2, " . ", "en")])).count() == 0
    rows = [(1, "one two three four five six, " * 40_000, "en")]
    assert got_collocations(frame(spark, rows), 30, 2000) == plain_collocations(rows, 30, 2000)


# spelling


def plain_variants(rows, fewest=3):
    counts = Counter()
    for doc_id, text, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= fewest}
    near = defaultdict(set)
    for a in words:
        for b in words:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def got_variants(docs):
    return sorted(tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())


def spelled(seed, letters, n=2500):
    dice = random.Random(seed)
    pool = ["".join(dice.choice(letters) for _ in range(dice.choice([4, 5, 5, 6, 6, 7, 9]))) for _ in range(500)]
    for w in list(pool[:200]):
        i = dice.randrange(len(w))
        pool += [w[:i] + w[i + 1 :], w[:i] + dice.choice(letters) + w[i:], w[:i] + dice.choice(letters) + w[i + 1 :]]
    weights = [1 / (1 + i % 40) for i in range(len(pool))]
    return [(i, " ".join(dice.choices(pool, weights, k=12)) + dice.choice(["", ", ", "’s Δ x́"]), "en") for i in range(n)]


@pytest.mark.parametrize("letters", ["abAB", "abcdeÀéÿ×", "a"])
def test_variants_equal_all_pairs(spark, letters):
    rows = [*spelled(1, letters), (None, None, "en"), (1, "", "en"), (1, "Aaaaaa aaaaaa aaaaaaa", "de"), (7, "b" * 3000 + " " + "b" * 3001, None), (8, "b" * 3000, None), (9, "b" * 3000, None)]
    assert got_variants(frame(spark, rows)) == plain_variants(rows)


def test_near_pairs_of_split_lists(spark):
    dice = random.Random(4)
    words = sorted({"".join(dice.choice("ab") for _ in range(dice.choice([5, 6, 7, 8]))) + dice.choice(["", "xy", "yx"]) for _ in range(700)} - {""})
    table = spark.createDataFrame([(w, i + 3) for i, w in enumerate(words)], "word string, n long").repartition(4)
    one = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))
    wanted = sorted((a, b) for a in words for b in words if one(a, b) or one(b, a))
    # lists of any length, of four postings, and named by as many grams as there are
    for longest, least in ((10**9, 10**9), (4, 10**9), (128, 1), (2, 1)):
        found = spelling.near_pairs(table, longest, least).collect()
        assert sorted((r["word"], r["near"]) for r in found) == wanted
        assert all(words[r["m"] - 3] == r["near"] for r in found)


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, "Apple apple", "en"), (2, None, None)])).count() == 0


def test_chains_end_at_their_root(spark):
    rows = [(i, w, "en") for i, w in enumerate(["abcdef"] * 4 + ["abcdeg"] * 12 + ["abcdhg"] * 36 + ["abckhg"] * 110 + ["ablkhg"] * 350)]
    got = {r["word"]: r["root"] for r in spelling.variants(frame(spark, rows)).collect()}
    assert all(got[w] == "ablkhg" for w in ("abcdef", "abcdeg", "abcdhg", "abckhg", "ablkhg"))


# licenses


def plain_scan(rows, templates=licenses.TEMPLATES, threshold=80):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for doc_id, text, _ in rows:
        words = split(text)
        starts, base, labels, score = [], set(), set(), 0.0
        for phrase, label in licenses.PHRASES:
            p = split(phrase)
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        for label, template in templates:
            own = split(template)
            h = 1
            while h < len(own):
                h *= 2
            for start in range(0, len(words), h):
                both = len(set(own) & set(words[start : start + 2 * h]))
                if 100 * both >= threshold * len(set(own)):
                    labels.add(label)
                    score = max(score, both / len(set(own)))
        out.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score))
    return sorted(out, key=repr)


def got_scan(docs, **more):
    found = licenses.scan(docs, **more).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    return sorted((tuple(r) for r in found), key=repr)


def licensed(seed):
    dice = random.Random(seed)
    rows = []
    for i in range(250):
        words = [dice.choice(["été", "the", "license", "under", "cc", "by", "nc", "Version", "2", "apache", "MIT", "software", "x9"]) for _ in range(dice.choice([0, 2, 40, 300]))]
        for _ in range(dice.choice([0, 1, 2])):
            notice = licenses.TEMPLATES[dice.randrange(len(licenses.TEMPLATES))][1].split()
            at = dice.randrange(len(words) + 1)
            words[at:at] = [w for w in notice if dice.random() < dice.choice([0.75, 0.9, 1])]
        rows.append((i, dice.choice([" ", "\n", "-"]).join(words), "en"))
    return [*rows, (1, None, None), (1, "", "en"), (2, "Released Under The MIT License.", "en"), (3, "CC BY-NC 4.0; cc by nc", "en"), (None, "Apache License, Version 2.0", "en"), (4, "under the mit\x7flicense cc by", "en")]


def test_scan_equals_plain_windows(spark):
    rows = licensed(2)
    assert got_scan(frame(spark, rows)) == plain_scan(rows)
    assert any(r[6] and not r[5] for r in plain_scan(rows))


@pytest.mark.parametrize("threshold", [1, 55, 100])
def test_scan_at_other_thresholds_and_templates(spark, threshold):
    dice = random.Random(threshold)
    rows = [(i, " ".join(dice.choice("abcdefgh") for _ in range(dice.choice([1, 7, 40]))), "en") for i in range(150)]
    templates = [("one", "a"), ("two", "a b"), ("twice", "a a b b c"), ("many", "a b c d e f g h zz"), ("many", "h g f")]
    assert got_scan(frame(spark, rows), templates=templates, threshold=threshold) == plain_scan(rows, templates, threshold)


def test_scan_of_nothing_long_texts_and_bad_calls(spark):
    assert licenses.scan(frame(spark, [])).count() == 0
    rows = [(1, "word " * 300_000 + "licensed under the MIT License", "en")]
    assert got_scan(frame(spark, rows)) == [(1, 300_005, 1, 300_001, 300_001, "mit", "mit", 1.0)]
    for more in ({"templates": []}, {"threshold": 0}, {"templates": [("x", "...")]}):
        with pytest.raises(ValueError):
            licenses.scan(frame(spark, rows), **more)


def test_blocks_say_where(spark):
    rows = [(1, "w " * 100 + licenses.TEMPLATES[5][1], "en")]
    block = licenses.scan(frame(spark, rows)).select(F.explode("blocks").alias("b")).select("b.*").first()
    assert block["label"] == "gpl-3" and block["first_word"] <= 100 < block["first_word"] + block["words"] and block["share"] == 1.0


@pytest.mark.parametrize("name", ["op11_collocations", "op13_license_scan"])
def test_query_equals_its_sql(spark, data, duck, name):
    from conftest import rows_of

    got, wanted = queries.queries()[name](spark, data).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    got = got.astype({c: "Int64" for c in got.columns if c in ("first_word", "last_word")})
    wanted = wanted.astype({c: "Int64" for c in wanted.columns if c in ("first_word", "last_word")})
    assert rows_of(got) == rows_of(wanted)


def test_spelling_query_equals_all_pairs(spark, data):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op12_spelling_variants(spark, data).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == plain_variants(rows)
