"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontaminate, edit_embedding, embedding_join, jaccard_join, language_id, quality, sharding, toxicity, url_filter, vector_codes, warc_zip

SHARDS = 8
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3, keep=["doc_id"])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = bpe.build_lexicon(docs, TOKENIZER)
    return bpe.digests(bpe.encode_decode(docs, TOKENIZER, lexicon, ["doc_id"]))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.cosine_components(_table(spark, sf_dir, "embeddings"), 0.95)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_language(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, k=5)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), 90, 100, 3)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc_zip.write_archives(_table(spark, sf_dir, "pages"), warc_zip.archive_folder(spark))
    return warc_zip.read_archives(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), most=3, least=10, share=50, top=2000)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op13_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.edited_fingerprints(_table(spark, sf_dir, "documents"), share=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_sharding, op3_url_filter, op4_bpe, op5_embedding_dedup, op6_language_id, op7_decontamination, op8_jaccard_join, op9_warc, op10_toxicity, op11_collocations, op12_vector_codes, op13_edit_embedding)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.oracle_sql()
