"""Scoring of predictions as they arrive: each sample stands alone, so the stream is stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scoreforge.operators.metrics import per_sample

INCOMING = "sid long, gt_text string, pred_text string"


def scored_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """A stream of per-sample errors of the JSON-lines files that come into ``folder``."""
    rows = spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", files_a_trigger).json(folder)
    return per_sample(rows).drop("gt_text", "pred_text")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the stream to Parquet, each file once; with ``once`` what is there now, else on and on."""
    writer = scored_stream(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
