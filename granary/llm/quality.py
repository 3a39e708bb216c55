"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document; the ledger keeps one bit a failed rule beside the measurements.
A policy is a version name and a mask of the rules that count, so another policy, or a policy less one rule
(an ablation), is bitwise arithmetic over the ledger and never reads a text again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm._common import WORD, unused

#: Rule names in bit order with the SQL condition of failing, over the measurements.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "n_symbols > 2 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines AND n_lines >= 4"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
)
#: Versioned policies: names of the rules that count.
POLICIES = {"base-1": ("few_words", "repeated_words"), "strict-1": tuple(name for name, _ in RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def mask_of(rules) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in rules)


def _measures(text: str) -> Column:
    """One struct of all measurements. Three-word windows are compared as sorted long keys: a hash above, the
    window's place in the lowest bits; equal neighbours are confirmed on the words themselves, and where another
    window of the same hash stands between, the whole run is looked through."""
    hashed = "shiftright({a}, b) = shiftright({c}, b)"
    words = " AND ".join(f"ws[cast({{a}} & m AS int) + {j}] = ws[cast({{c}} & m AS int) + {j}]" for j in range(3))
    near = lambda a, c: f"{hashed.format(a=f's[{a}]', c=f's[{c}]')}"
    same = lambda a, c: f"({near(a, c)} AND {words.format(a=f's[{a}]', c=f's[{c}]')})"
    beside = f"((k > 0 AND {near('k - 1', 'k')}) OR (k < size(s) - 1 AND {near('k', 'k + 1')}))"
    anywhere = f"exists(s, x -> x <> s[k] AND {hashed.format(a='x', c='s[k]')} AND {words.format(a='x', c='s[k]')})"
    # each one-element transform binds a name, so that nothing is evaluated again for each element
    keys = "transform(sequence(0, size(ws) - 3), i -> shiftleft(xxhash64(ws[i], ws[i + 1], ws[i + 2]), b) | i)"
    hits = (
        "sort_array(filter(transform(sequence(0, size(s) - 1), k -> IF("
        f"(k > 0 AND {same('k - 1', 'k')}) OR (k < size(s) - 1 AND {same('k', 'k + 1')}) OR ({beside} AND {anywhere}), s[k] & m, -1L)), x -> x >= 0))"
    )
    covered = f"aggregate({hits}, named_struct('p', -3L, 'n', 0L), (a, x) -> named_struct('p', x, 'n', a.n + least(3L, x - a.p)), a -> a.n)"
    repeats = (
        "IF(size(ws) < 4, 0L, transform(array(length(bin(size(ws)))), b -> "
        f"transform(array(shiftleft(1L, b) - 1L), m -> transform(array(sort_array({keys})), s -> {covered})[0])[0])[0])"
    )
    with_word = f"filter(split({text}, '\\n', -1), l -> l RLIKE '{WORD}')"
    lines = f"transform(array({with_word}), ls -> named_struct('n_lines', CAST(size(ls) AS bigint), 'n_dup_lines', CAST(size(ls) - size(array_distinct(ls)) AS bigint)))[0]"
    words = (
        f"transform(array(regexp_extract_all({text}, '{WORD}', 0)), ws -> named_struct("
        f"'n_words', CAST(size(ws) AS bigint), 'word_chars', aggregate(ws, 0L, (a, w) -> a + length(w)), 'n_repeat_words', {repeats}))[0]"
    )
    symbols = f"CAST(size(regexp_extract_all({text}, '[#*$%&|<>]', 0)) AS bigint)"
    escape = lambda sql: sql.replace("\\", "\\\\")  # noqa: E731  the SQL parser reads escapes in string literals
    return F.struct(F.expr(escape(words)).alias("w"), F.expr(escape(lines)).alias("l"), F.expr(escape(symbols)).alias("n_symbols"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failures``, a bit a failed rule; docs has doc_id and text.

    A null or empty text has 0 in every measurement and fails few_words. Each row is judged by itself, so ties
    and repeated rows keep their rows; a table without rows gives none; other columns are ignored.
    """
    measured = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", _measures("text").alias("got"))
    flat = measured.select(
        "doc_id", "got.w.n_words", "got.w.word_chars", "got.n_symbols", "got.l.n_dup_lines", "got.w.n_repeat_words", "got.l.n_lines"
    )
    bits = " | ".join(f"IF({condition}, {1 << i}L, 0L)" for i, (_, condition) in enumerate(RULES))
    return flat.withColumn("failures", F.expr(bits))


def judge(entries: DataFrame, policy: str = "strict-1") -> DataFrame:
    """The ledger with base_failed (policy base-1) and kept (base-1 and the named policy both pass)."""
    fails = lambda name: F.col("failures").bitwiseAND(F.lit(mask_of(POLICIES[name])).cast("long")) != 0
    return entries.select("*", fails("base-1").alias("base_failed"), (~fails("base-1") & ~fails(policy)).alias("kept"), F.lit(policy).alias("policy"))


def ablations(entries: DataFrame, policy: str = "strict-1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that it alone rejects, and that stay without it."""
    mask = mask_of(POLICIES[policy])
    failed = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    totals = entries.agg(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.count_if(failed.bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias("n_failed"),
                F.count_if(failed == (1 << i)).alias("n_only"),
                F.count_if(failed.bitwiseAND(F.lit(mask & ~(1 << i)).cast("long")) == 0).alias("n_kept_without"),
            ).alias(name)
            for i, (name, _) in enumerate(RULES)
            if mask >> i & 1
        ]
    )
    return totals.select(F.explode(F.array(*totals.columns)).alias("r")).select("r.*")


def keep_good(docs: DataFrame, policy: str = "strict-1") -> DataFrame:
    """docs' rows that the policy keeps, with docs' columns, whatever their names."""
    text, got, m = unused(docs, "text_", "got_", "m_")
    measured = docs.withColumn(text, F.coalesce("text", F.lit(""))).withColumn(got, _measures(text))
    parts = {"n_words": "w", "word_chars": "w", "n_symbols": "", "n_dup_lines": "l", "n_repeat_words": "w", "n_lines": "l"}
    named = F.struct(*[F.col(".".join(x for x in (got, part, name) if x)).alias(name) for name, part in parts.items()])
    bits = " | ".join(f"IF({condition}, {1 << i}L, 0L)" for i, (_, condition) in enumerate(RULES))
    for name in MEASURES:
        bits = re.sub(rf"\b{name}\b", f"{m}.{name}", bits)
    mask = mask_of(POLICIES["base-1"]) | mask_of(POLICIES[policy])
    return measured.withColumn(m, named).where(F.expr(f"({bits}) & {mask}L") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL for the op9 query.
ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i) WHERE len(ws) >= 3),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, unnest(range(0, 3)) AS v(j) GROUP BY rid),
lines AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN dup ON dup.rid = w.rid LEFT JOIN cov ON cov.rid = w.rid),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines AND n_lines >= 4 THEN 8 ELSE 0 END
  + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) THEN 16 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failures,
  failures & 3 <> 0 AS base_failed, failures = 0 AS kept, 'strict-1' AS policy FROM f
"""
