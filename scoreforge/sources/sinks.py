"""Sinks: sharded features by data set, and the metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(features: DataFrame, path: str, shard_size: int = 50000) -> None:
    """Rows whose status is ok as Parquet, a folder a data set, at most ``shard_size`` rows a file."""
    ok = features.where("status = 'ok'").drop("status")
    ok.write.mode("overwrite").option("maxRecordsPerFile", shard_size).partitionBy("dataset_name").parquet(path)


def append_scalars(scalars: DataFrame, path: str) -> None:
    """(step, key, value) rows added to the metrics table."""
    scalars.coalesce(1).write.mode("append").parquet(path)


def files(spark: SparkSession, path: str) -> int:
    """How many Parquet files a table has; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return found.agg(F.count("path")).first()[0]


def described(spark: SparkSession, path: str, description: str = "") -> DataFrame:
    """One row that describes stored features: description, features (the schema as JSON), num_rows, num_shards and the names of
    the files. Rows are counted from the files' footers."""
    rows = spark.read.parquet(path)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("n"))
    found = names.agg(F.count("n").alias("num_shards"), F.array_sort(F.collect_list("n")).alias("files"))  # names of files
    counted = rows.agg(F.count(F.lit(1)).alias("num_rows"))
    return counted.join(F.broadcast(found)).select(F.lit(description).alias("description"), F.lit(rows.schema.json()).alias("features"), "num_rows", "num_shards", "files")
