"""The queries of this subpackage with production parameters, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import ann, bpe, collocations, licenses, mixing, pii, quality, setjoin, sharding, spelling, suffix_tree, token_store, warc
from granary.llm._common import load


def tokenizer_path() -> str:
    """The vocabulary file: GRANARY_TOKENIZER, or the public one that is installed."""
    named = os.environ.get("GRANARY_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pseudonym_key(spark: SparkSession) -> str:
    """The key of pseudonyms: the session's spark.granary.pseudonymKey. Only a demonstration runs without."""
    return spark.conf.get("spark.granary.pseudonymKey", "for demonstration only")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    shards = F.array_join(F.array_sort(F.array_distinct(F.transform("takings", lambda t: t["shard"].cast("string")))), ",").alias("shards")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards)


def op2_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(load(spark, sf_dir, "documents"))


def op3_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"))


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(load(spark, sf_dir, "documents"))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(load(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.tokens_round_trip(load(spark, sf_dir, "documents"), tokenizer_path())


def op8_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(load(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(quality.ledger(load(spark, sf_dir, "documents")))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(load(spark, sf_dir, "documents"), pseudonym_key(spark))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents")).drop("blocks")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_source_mix, op2_suffix_tree_scores, op3_projected_neighbours, op4_warc_segments, op5_shingle_join,
        op6_stratified_shards, op7_token_files, op8_tree_bpe, op9_quality_ledger, op10_pseudonyms, op11_collocations, op12_spelling_variants, op13_license_scan,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op5_shingle_join": setjoin.ORACLE, "op9_quality_ledger": quality.ORACLE, "op1_source_mix": mixing.ORACLE, "op4_warc_segments": warc.ORACLE, "op11_collocations": collocations.ORACLE, "op13_license_scan": licenses.ORACLE}
