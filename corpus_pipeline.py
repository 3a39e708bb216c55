"""A training corpus from documents: quality rules, one of each group of near duplicates, pseudonyms, a mixture, ids.

Each stage takes (spark, docs, sf_dir); docs is what the stage before kept. All but the last return the columns
of documents; the last returns the ids' digests of every text of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, mixing, pii, quality, setjoin
from granary.llm._common import load, written
from granary.llm.queries import pseudonym_key, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setjoin.one_of_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(docs, pseudonym_key(spark)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", pseudonyms),
    ("mixing", mixture),
    ("BPE encoding and decoding", token_ids),
]

#: Keyed permutations and byte-pair merges have no SQL twin; tests/llm/test_brute_force.py holds run() and its stages
#: against plain Python versions of all of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
