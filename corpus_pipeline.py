"""A corpus pipeline over ``documents``: quality, near duplicates, decontamination, secrets, token ids.

Every stage works on all that the one before it kept, is written as Parquet below the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scoreforge.llm import common as C
from scoreforge.llm import decontaminate, pieces, quality, secrets, setjoin

#: Learned models and numpy encoders are in it: SQL can't express it; tests compare it with a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay, with all their columns. Null texts count as empty ones, which
    score as the labelled rows do on average; repeated rows stay or go together; without labels all stay."""
    C.ship(spark)
    return quality.keep(docs, quality.fit(docs, C.table(spark, sf_dir, "labels")))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the one of the smallest doc_id stays, of repeated
    rows one; null, empty and wordless texts all stay; a null id stays only where the group has no other."""
    C.ship(spark)
    return setjoin.keep_one(docs, 5, 80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text overlaps with a benchmark item go. Null, empty and wordless texts stay, and so do rows that only
    share their id (or null) with one that goes."""
    return decontaminate.drop_leaks(docs, C.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts and n_chars is counted anew there; all rows stay, null texts as they are."""
    return secrets.redact(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of ids and decoded text; null and empty texts have no ids."""
    C.ship(spark)
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("sentencepiece", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another; what a stage wrote is deleted once the next one is written."""
    rows, last = C.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        rows = C.checkpointed(stage(spark, rows, sf_dir))
        if last is not None:
            C.forget(last)
        last = rows
    return rows
