"""Lengths, paddings and masks of model inputs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IGNORED = -100


def encoder_length(frames: Column) -> Column:
    """Audio tokens of a number of mel frames: 13 for each 100, and one for each 8 begun of the rest."""
    return (F.ceil((frames % 100) / 8.0) + F.floor(frames / 100.0) * 13).cast("int")


def frame_count(samples: Column, rate: int = 16000) -> Column:
    """Mel frames of so many samples, 100 a second."""
    return F.floor(samples * F.lit(100) / F.lit(rate)).cast("int")


def expand_placeholder(ids: Column, audio_id: int, n: Column) -> Column:
    """The one audio placeholder among ``ids`` as ``n`` copies; ids with none, or several, or n under 2 stay as they are."""
    one = F.size(F.filter(ids, lambda x: x == audio_id)) == 1
    grown = F.flatten(F.transform(ids, lambda x: F.when(x == audio_id, F.array_repeat(x, n)).otherwise(F.array(x))))
    return F.when(one & (n > 1), grown).otherwise(ids)


def expanded_prefix(prefix: Column, ids: Column, audio_id: int, n: Column) -> Column:
    """Length of the prefix once the placeholder is expanded."""
    one = F.size(F.filter(ids, lambda x: x == audio_id)) == 1
    return F.when(one & (n > 1), prefix + n - 1).otherwise(prefix)


def label_mask(ids: Column, prefix: Column, pad_id: int) -> Column:
    """Labels: ids, but ``IGNORED`` inside the prefix and at padding."""
    return F.transform(ids, lambda x, i: F.when((i < prefix) | (x == pad_id), F.lit(IGNORED)).otherwise(x))


def padded(rows: DataFrame, ids: str, by: list[str], pad_id: int, left: bool = False) -> DataFrame:
    """``rows`` with ``ids`` padded to the longest of its batch, a 0/1 ``attention_mask`` and the ``pad_offset`` in front."""
    most = F.max(F.size(ids)).over(W.partitionBy(*by))
    out = rows.withColumn("_n", F.size(ids)).withColumn("_gap", (most - F.size(ids)).cast("int"))
    fill, ones, zeros = F.array_repeat(F.lit(pad_id), F.col("_gap")), F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), F.col("_gap"))
    kind = rows.schema[ids].dataType
    out = out.withColumn(ids, F.concat(fill.cast(kind), F.col(ids)) if left else F.concat(F.col(ids), fill.cast(kind)))
    out = out.withColumn("attention_mask", F.concat(zeros, ones) if left else F.concat(ones, zeros))
    return out.withColumn("pad_offset", F.col("_gap") if left else F.lit(0)).drop("_n", "_gap")


def padded_frames(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` whose input_features (mel_frames by mel_bins half floats) are filled up with zeros to the longest of the batch, and
    a 0/1 ``feature_mask`` of the frames that are real."""
    gap = F.max("mel_frames").over(W.partitionBy(*by)) - F.col("mel_frames")
    out = rows.withColumn("_gap", gap)
    fill = F.unhex(F.repeat(F.lit("0000"), F.col("_gap") * F.col("mel_bins")))
    out = out.withColumn("input_features", F.concat("input_features", fill))
    return out.withColumn("feature_mask", F.concat(F.array_repeat(F.lit(1), F.col("mel_frames")), F.array_repeat(F.lit(0), F.col("_gap")))).drop("_gap")


def generated(ids: Column, pad_offset: Column, prefix: Column) -> Column:
    """What a model added behind the padding and the prompt."""
    start = pad_offset + prefix
    return F.slice(ids, start + 1, F.greatest(F.size(ids) - start, F.lit(0)))


def fit_length(values: Column, n: Column, fill) -> Column:
    """``values`` cut or filled up to ``n``."""
    return F.concat(F.slice(values, F.lit(1), n), F.array_repeat(F.lit(fill), F.greatest(n - F.size(values), F.lit(0))))
