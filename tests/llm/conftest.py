import pytest

LONG = "lorem ipsum dolor sit amet " * 8000

#: null and empty texts, a null id, repeated rows, ties and a very long text; further columns whose names the operators use inside.
EDGE = [(None, "null id token=abcdefghijklmnop"), (1, None), (2, ""), (3, " \n "), (4, "x"), (4, "x"), (5, "one two three four five six"), (6, "one two three four five six"), (7, LONG), (8, "ONE two  three four five six"), (9, "1234 !!"), (10, "é漢字🎵 ▁ a  b\x00")]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(EDGE, "doc_id long, text string")
    for name in ("key", "n", "h", "rid", "token", "_spans", "_score", "_id", "_keep", "_bad", "w", "id", "score", "shard", "size", "c0", "c1", "part", "cells"):
        rows = rows.withColumn(name, F.lit(7))
    return rows.withColumn("lang", F.when(F.col("doc_id") > 4, "xx")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
