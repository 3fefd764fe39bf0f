"""From raw documents to token ids: five stages, each an operator of ``sparkquire.llm``.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquire.llm import bpe, decontaminate, jaccard_join, quality, sieve, toxicity
from sparkquire.llm.queries import TOKENIZER
from sparkquire.storage import cut, shared_dir

#: The production parameters of the near-duplicate stage: five words, a similarity of 0.8.
SHINGLE_WORDS, SIMILAR = 5, (80, 100)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _key() -> Column:
    """What names a row beside its id: rows of one id are judged one by one."""
    return F.xxhash64("doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    score, _ = toxicity.toxicity_scorer(docs, _labels(spark, sf_dir))
    return docs.where(score(F.col("text"))["score"] <= 0.5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose statistics score 0.3 or more."""
    return docs.where(quality.quality_scorer(docs, _labels(spark, sf_dir))(F.col("text")) >= 0.3)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least (id, hash of id and text) in each component of near copies; rows without
    words or without an id all stay.  Of kept rows that repeat id and text, the least by the other columns stays."""
    gone, repeated = jaccard_join.repeats(docs, *SIMILAR, words=SHINGLE_WORDS)
    kept = sieve.leave_out(docs, gone, _key(), "doc_id")
    if repeated.isEmpty():
        return kept
    single = sieve.leave_out(kept, repeated, _key(), "doc_id")
    again = repeated.alias("r")
    rows = kept.withColumn(" key", _key()).alias("d").join(again, (F.col("d.` key`") == F.col("r.key")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), "left_semi")
    least = rows.groupBy("` key`", "doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.unionByName(least)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item (or the whole of a shorter one)."""
    found = decontaminate.contaminated_keys(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, k=5)
    return sieve.leave_out(docs, found, _key(), "doc_id")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids (little-endian 32-bit)."""
    return bpe.digests(bpe.encode_decode(docs, TOKENIZER, bpe.build_lexicon(docs, TOKENIZER), ["doc_id"]), keep=["ids"])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: Trained models and an automaton can't be put in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
