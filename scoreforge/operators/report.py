"""Metrics as a table by step, score geometry, and the latest checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreforge.functions.vocab import note_beats

LOGGED = ("cer", "pitch_mae", "note_mae", "dur_mae", "bpm_mae")


def scalars(metrics: DataFrame, step: int) -> DataFrame:
    """(step, key, value) of the means that are defined."""
    pairs = F.array(*[F.struct(F.lit(f"eval/{n}").alias("key"), F.col(n).alias("value")) for n in LOGGED])
    return metrics.select(F.lit(step).alias("step"), F.explode(pairs).alias("m")).select("step", "m.key", "m.value").where("value is not null and not isnan(value)")


def rates(logs: DataFrame, world: int = 1, summed: list[str] | None = None, by: list[str] | None = None, step: str = "step", at: str = "ts") -> DataFrame:
    """A log with its ``summed`` columns (loss, gradient norms: added up over all ranks) by rank, and ``steps_per_second`` since the line
    before, of the same run if ``by`` names what tells runs apart (a task sees one run's lines). Null for the first line, where
    the step did not go up, and where no time passed."""
    before = W.partitionBy(*(by or [])).orderBy(at, step)
    now = F.unix_micros(F.col(at).cast("timestamp"))
    done, took = F.col(step) - F.lag(step).over(before), now - F.lag(now).over(before)
    out = logs.withColumns({c: F.col(c) / world for c in summed or []}) if world > 1 else logs
    return out.withColumn("steps_per_second", F.when((done > 0) & (took > 0), F.round(done * 1e6 / took, 2)))


def geometry(notes: DataFrame, by: str | list[str], order: str) -> DataFrame:
    """``notes`` with each one's width in beats and where it starts in its score."""
    width = note_beats(F.col("note"))
    before = W.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return notes.withColumn("width", width).withColumn("start", F.coalesce(F.sum("width").over(before), F.lit(0.0)))


def first_samples(samples: DataFrame, n: int, order: str = "sample_id") -> DataFrame:
    """The first ``n`` samples in order, all if ``n`` is negative, none if 0."""
    return samples if n < 0 else samples.orderBy(order).limit(n)


def latest_checkpoint(names: DataFrame, name: str = "name", is_dir: str = "is_dir") -> DataFrame:
    """The directory ``checkpoint-<number>`` of the greatest number; no row if there is none."""
    step = F.regexp_extract(name, "^checkpoint-([0-9]+)$", 1).try_cast("long")
    return names.where(F.col(is_dir)).select(F.col(name).alias("name"), step.alias("step")).where("step is not null").agg(F.max_by("name", "step").alias("name"), F.max("step").alias("step")).where("name is not null")


def as_json(value: Column) -> Column:
    return F.to_json(value)
