"""The queries of this subpackage but ``pipeline``: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import decontaminate, importance, language, nearest, negatives, oracles, packing, pieces, quality, records, secrets, setjoin, sharding, suffixes


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that overlap with benchmark items, and with which."""
    return decontaminate.leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte strings that stand elsewhere too."""
    return suffixes.remove_repeats(C.table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for each query vector."""
    return nearest.top_k(C.table(spark, sf_dir, "embeddings"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents whose three-word shingle sets are 90 percent alike."""
    return setjoin.join(C.table(spark, sf_dir, "documents"), 3, 90)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document through binary record files and back."""
    return records.write_and_read(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return sharding.shard(C.table(spark, sf_dir, "documents"), 40)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their decoding."""
    return pieces.encode_decode(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.predict(C.table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(C.table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return quality.classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's texts, and the five percent that are drawn."""
    return importance.resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each anchor and positive; every seventh row has the next label."""
    rows = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(rows)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        C.ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = {q.__name__: _shipped(q) for q in (op1_decontaminate, op2_suffix_dedup, op3_top_k, op4_jaccard_join, op5_token_records, op6_sharding, op7_sentencepiece, op8_language, op9_secrets, op10_quality, op11_importance, op12_hard_negatives, op13_packing)}
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": oracles.LEAKS, "op2_suffix_dedup": oracles.REPEATS, "op3_top_k": oracles.TOP_K, "op4_jaccard_join": oracles.JACCARD, "op6_sharding": oracles.SHARDS, "op8_language": oracles.LANGUAGES, "op9_secrets": oracles.SECRETS, "op11_importance": oracles.IMPORTANCE, "op12_hard_negatives": oracles.NEGATIVES}
