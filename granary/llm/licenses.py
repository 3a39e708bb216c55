"""License scan: an exact set-similarity join of text blocks with license templates.

A template's set is its distinct words. A text is cut into overlapping blocks of 2h words, one beginning every h words,
where h is the smallest power of two that the template's words fit in; so every passage as long as the template lies
whole in some block. A block matches where it contains at least THRESHOLD percent of the template's set.

The templates' words are ordered by their frequency in all documents, rarest first; other words are in no template and
can't add to an overlap. Let a template have n words of which k are needed:
- length filter: a block with fewer than k of the templates' words can't match;
- prefix filter: a block without one of the template's first n - k + 1 words can't match; these words index the templates;
- positional filter: with the first shared word at place i of the template and j of the block's words, of which there
  are m, no more than 1 + min(n - i - 1, m - j - 1) words can be shared.
What is left is counted exactly. Templates are a parameter of bounded number, so they go to the texts, which are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm._common import small_batches
from granary.llm._words import hashes_of, spans_of, text_slices

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BYTES = np.arange(256)
_SOLID = (_BYTES >= 128) | np.isin(_BYTES, list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
#: Percent of a template's distinct words that a block has at least.
THRESHOLD = 80
#: Templates that one call takes; a longer list is scanned in several calls.
MOST = 4096

# Phrases with their labels, and public license notices with theirs.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)


def _hashed(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, in lower case; text of each) of the texts data[cuts[i]:cuts[i + 1]]."""
    starts, ends = spans_of(cuts, _SOLID[data])
    return (hashes_of(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), np.searchsorted(cuts, starts, side="right") - 1


def _words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _hashed(data, np.array([0, len(data)]))[0]


def half(words: int) -> int:
    """Words between the beginnings of the blocks of a template of so many words."""
    return 1 << max(0, words - 1).bit_length()


def needed(size: int, threshold: int) -> int:
    return -(-threshold * size // 100)


def _frequencies(texts: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of the templates' words (sorted) in all texts: a number a word of the templates reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, cuts in text_slices(batch["text"]):
                words, _ = _hashed(data, cuts)
                at = np.searchsorted(vocabulary, words) % len(vocabulary)
                total += np.bincount(at[vocabulary[at] == words], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    found = texts.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


class _Index:
    """Templates as sets of ranks in the global order, with the words that index them."""

    def __init__(self, templates: Sequence[tuple[str, str]], vocabulary: np.ndarray, counts: np.ndarray, threshold: int) -> None:
        self.vocabulary, self.rank = vocabulary, np.empty(len(vocabulary), np.int64)
        self.rank[np.lexsort((vocabulary, counts))] = np.arange(len(vocabulary))
        self.templates = []
        for label, text in templates:
            words = _words_of(text)
            ranks = np.sort(self.rank[np.searchsorted(vocabulary, np.unique(words))])
            has = np.zeros(len(vocabulary), bool)
            has[ranks] = True
            place = np.full(len(vocabulary), -1)
            place[ranks] = np.arange(len(ranks))
            need = needed(len(ranks), threshold)
            place[ranks[len(ranks) - need + 1 :]] = -1  # words beyond the prefix don't index
            self.templates.append((label, half(len(words)), len(ranks), need, has, place))

    def matches(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, str, int, np.ndarray, np.ndarray, int]]:
        """(texts, label, h, first words of blocks, shared words, template's size) of the matching blocks of some texts."""
        at = np.searchsorted(self.vocabulary, words) % len(self.vocabulary)
        here = np.flatnonzero(self.vocabulary[at] == words)
        if not len(here):
            return
        rank, doc_of = self.rank[at[here]], doc[here]
        place = here - np.searchsorted(doc, doc_of)
        for h in sorted({t[1] for t in self.templates}):
            later = place // h
            two = later > 0
            block = np.concatenate([doc_of << 32 | later, doc_of[two] << 32 | later[two] - 1])
            names, block = np.unique(block, return_inverse=True)
            key = np.unique(block * len(self.vocabulary) + np.concatenate([rank, rank[two]]))
            block, ranks = key // len(self.vocabulary), key % len(self.vocabulary)
            first = np.searchsorted(block, np.arange(len(names)))
            size = np.diff(np.append(first, len(block)))
            for label, own, n, need, has, in_prefix in self.templates:
                if own != h:
                    continue
                met = np.flatnonzero((in_prefix[ranks] >= 0) & (size[block] >= need))
                met = met[np.concatenate([[True], block[met][1:] != block[met][:-1]])] if len(met) else met
                candidates, i, j = block[met], in_prefix[ranks[met]], met - first[block[met]]
                candidates = candidates[1 + np.minimum(n - i - 1, size[candidates] - j - 1) >= need]
                if not len(candidates):
                    continue
                sums = np.concatenate([[0], np.cumsum(has[ranks])])
                both = sums[first[candidates] + size[candidates]] - sums[first[candidates]]
                candidates, both = candidates[both >= need], both[both >= need]
                yield names[candidates] >> 32, label, h, (names[candidates] & 0xFFFFFFFF) * h, both, n


def _places(words: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after another in one text."""
    k = len(phrase)
    if len(words) < k:
        return np.zeros(0, np.int64)
    here = doc[: len(words) - k + 1] == doc[k - 1 :]
    for i, word in enumerate(phrase):
        here &= words[i : len(words) - k + 1 + i] == word
    return np.flatnonzero(here)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks (label, first word, words, share)
    for every row of docs (doc_id, text); other columns are ignored.

    score is the largest share of a matching template's words, 1 where a phrase stands, 0 where nothing was found. A null text
    is empty: it has no words, no labels and score 0. Rows are scanned each by itself, so repeated rows and ids keep
    their rows; labels of several templates count once. A table without rows gives none. Long texts are read whole.
    """
    if not 1 <= len(templates) <= MOST:
        raise ValueError(f"scan takes 1 to {MOST} templates a call")
    if not 1 <= threshold <= 100 or any(not len(_words_of(text)) for _, text in (*templates, *phrases)):
        raise ValueError("a threshold is 1 to 100 percent, and templates and phrases have words")
    small_batches(docs.sparkSession, 1 << 12)
    kind = docs.schema["doc_id"].dataType
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = np.unique(np.concatenate([_words_of(text) for _, text in templates]))
    index = _Index(templates, vocabulary, _frequencies(texts, vocabulary), threshold)
    hashed = [(_words_of(text), label) for text, label in phrases]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n_words, n_base = np.zeros(m, np.int64), np.zeros(m, np.int64)
            ends: list[list[int]] = [[] for _ in range(m)]
            base: list[set[str]] = [set() for _ in range(m)]
            blocks: list[list[dict]] = [[] for _ in range(m)]
            for lo, hi, data, cuts in text_slices(batch["text"]):
                words, doc = _hashed(data, cuts)
                n_words[lo:hi] = np.bincount(doc, minlength=hi - lo)
                begin = np.searchsorted(doc, np.arange(hi - lo))
                for phrase, label in hashed:
                    at = _places(words, doc, phrase)
                    n_base[lo:hi] += np.bincount(doc[at], minlength=hi - lo)
                    for d in np.unique(doc[at]).tolist():
                        mine = at[doc[at] == d] - begin[d]
                        base[lo + d].add(label)
                        ends[lo + d] += [int(mine[0]), int(mine[-1])]
                for which, label, h, first, both, n in index.matches(words, doc):
                    for d, f, b in zip(which.tolist(), first.tolist(), both.tolist(), strict=True):
                        blocks[lo + d].append({"label": label, "first_word": f, "words": min(2 * h, int(n_words[lo + d]) - f), "share": b / n})
            found = [sorted({x["label"] for x in b} | s) for b, s in zip(blocks, base, strict=True)]
            score = [1.0 if s else max((x["share"] for x in b), default=0.0) for b, s in zip(blocks, base, strict=True)]
            columns = [
                batch["doc_id"], pa.array(n_words), pa.array(n_base),
                pa.array([min(e) if e else None for e in ends], pa.int64()), pa.array([max(e) if e else None for e in ends], pa.int64()),
                pa.array([",".join(sorted(s)) for s in base], pa.string()), pa.array([",".join(s) for s in found], pa.string()),
                pa.array(score, pa.float64()), pa.array(blocks, block_type),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    schema += "blocks array<struct<label: string, first_word: long, words: long, share: double>>"
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    block_type = to_arrow_type(docs.sparkSession.createDataFrame([], schema).schema["blocks"].dataType)
    return texts.mapInArrow(find, schema)


def _oracle() -> str:
    """DuckDB SQL for the op13 query, from the same phrases and templates."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    lowered = lambda s: re.findall(WORD, s.lower())
    phrase_rows = ", ".join(f"({text(label)}, {[*lowered(p)]!r})" for p, label in PHRASES)
    template_rows = ", ".join(
        f"({i}, {text(label)}, {half(len(ws))}, {len(set(ws))}, {sorted(set(ws))!r})" for i, (label, ws) in enumerate((label, lowered(t)) for label, t in TEMPLATES)
    )
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
w AS (SELECT rid, i - 1 AS i, ws[i] AS word, ws[i:i + 4] AS ahead FROM t, unnest(range(1, len(ws) + 1)) AS u(i)),
phrase(label, p) AS (VALUES {phrase_rows}),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
  FROM w JOIN phrase ON word = p[1] AND ahead[1:len(p)] = p GROUP BY rid),
template(tid, label, h, size, words) AS (VALUES {template_rows}),
tw AS (SELECT tid, label, h, size, unnest(words) AS word FROM template),
part AS (SELECT rid, tid, label, size, w.i // h - b AS block, tw.word FROM w JOIN tw ON tw.word = w.word, unnest([0, 1]) AS v(b) WHERE w.i // h >= b),
found AS (SELECT rid, tid, label, count(DISTINCT word) / size::DOUBLE AS share FROM part GROUP BY rid, tid, label, size, block HAVING 100 * count(DISTINCT word) >= {THRESHOLD} * size),
method AS (SELECT rid, max(share) AS share, list(DISTINCT label) AS labels FROM found GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ',') AS labels,
  CASE WHEN base.rid IS NOT NULL THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM t LEFT JOIN base USING (rid) LEFT JOIN method USING (rid)
"""


ORACLE = _oracle()
