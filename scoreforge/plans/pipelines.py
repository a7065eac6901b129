"""The jobs: preprocessing, batch transcription, scoring, validation in training; and the rows of training batches."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scoreforge.config import RunConfig
from scoreforge.functions import tensors
from scoreforge.operators import batching, encode, features, infer, metrics, parse, report, splits, tokens
from scoreforge.session import written
from scoreforge.sources import annotations, sinks

#: What a preprocessing run tells of itself.
STATISTICS = "num_samples long, num_shards long, errors long, skipped_missing long, elapsed_seconds double, format string, sample_rate int, num_workers int, total_bytes long, avg_mel_frames double"


def preprocess(spark: SparkSession, config: RunConfig, extractor: features.Extractor, decoder=features.decode_pcm16) -> DataFrame:
    """Reads all data sets, extracts features and writes those that are ok; returns the run's statistics (one row).

    Each task opens its samples' audio by path; failures are statuses. Counts are observed while the features are written.
    """
    samples = annotations.all_datasets(spark, config.datasets, config.max_samples)
    seen, began = Observation("preprocess"), time.monotonic()
    made = features.extract(samples, extractor, decoder, config.sample_rate).observe(seen, *features.statistics())
    sinks.write_features(made, config.output_dir, config.shard_size)
    took = round(time.monotonic() - began, 1)
    counts = seen.get
    shards = sinks.files(spark, config.output_dir) if counts["num_samples"] else 0
    run = {"num_shards": shards, "elapsed_seconds": took, "format": "parquet", "sample_rate": config.sample_rate, "num_workers": spark.sparkContext.defaultParallelism}
    row = {**counts, **run}
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in STATISTICS.split(", "))], STATISTICS)


def targets(samples: DataFrame, config: RunConfig) -> DataFrame:
    """``samples`` (syllables, bpm) with what a model is to write."""
    make = encode.cot_target if config.asr_cot else lambda s, b, p: encode.target(encode.text(s, b, p))
    return samples.withColumn("target", make(F.col("syllables"), F.col("bpm"), config.bpm_position))


def raw_records(samples: DataFrame, prefix: str, config: RunConfig) -> DataFrame:
    """audio, text, prefix_text of raw training: the lyrics never stand in front here."""
    return samples.select(F.col("audio_path").alias("audio"), encode.target(encode.text(F.col("syllables"), F.col("bpm"), config.bpm_position)).alias("text"), F.lit(prefix).alias("prefix_text"))


def train_and_validation(spark: SparkSession, config: RunConfig) -> tuple[DataFrame, DataFrame | None]:
    """Stored features by part; an evaluation file stands in where no data set is named or found."""
    train, val = splits.split(annotations.stored(spark, config.output_dir), config.val_datasets)
    if val is not None and val.isEmpty():
        val = None
    if val is None and config.eval_file:
        val = annotations.eval_json(spark, config.eval_file)
    return train, val


def training_batches(samples: DataFrame, config: RunConfig, epoch: int = 0, drop_last: bool = False, shuffle: bool = True) -> DataFrame:
    """batch_id, pos, sample_id, length under the padded budget, and ``turn``: a random order of the batches for the epoch. Rows are
    shuffled among others of like length before they are packed, anew for each epoch; without ``shuffle`` they come, and so do
    the batches, in order of sample_id."""
    size = {"budget": config.max_batch_tokens, "cap": config.max_batch_size, "padded": True}
    if shuffle:
        ordered = batching.shuffled_order(samples, "mel_frames", config.seed, epoch)
        made = batching.pack(ordered, "mel_frames", order="order_key", **size)
    else:
        made = batching.pack(samples, "mel_frames", order="sample_id", **size)
    made = batching.drop_last(made) if drop_last else made
    return made.withColumn("turn", batching.draw(config.seed + epoch, F.col("batch_id")) if shuffle else F.col("batch_id"))


def model_inputs(samples: DataFrame, batches: DataFrame, config: RunConfig, tokenizer: tokens.Factory, prefix: str, end: str, pad_id: int, audio_id: int | None = None) -> DataFrame:
    """Stored samples (sample_id, syllables, bpm, mel_frames and, if wanted, features) as inputs, batch by batch: targets, their ids behind
    the prompt's, and all that ``collate`` adds."""
    rows = targets(samples.join(batches.select("sample_id", "batch_id", "pos"), "sample_id"), config)
    return collate(tokens.training_ids(rows, tokenizer, prefix, end), ["batch_id"], pad_id, audio_id)


def collate(rows: DataFrame, by: list[str], pad_id: int, audio_id: int | None = None) -> DataFrame:
    """Rows (ids, prefix, mel_frames) of batches as model inputs: the placeholder expanded to the audio's tokens, ids padded on
    the right, attention mask, and labels that ignore prefix and padding. Features that are there (input_features, mel_bins:
    frames by bins of half floats) are filled up with silent frames to the longest of the batch, with a mask of the real ones."""
    if audio_id is not None:
        n = tensors.encoder_length(F.col("mel_frames"))
        rows = rows.withColumn("prefix", tensors.expanded_prefix(F.col("prefix"), F.col("ids"), audio_id, n)).withColumn("ids", tensors.expand_placeholder(F.col("ids"), audio_id, n))
    if "input_features" in rows.columns:
        rows = tensors.padded_frames(rows, by)
    return tensors.padded(rows, "ids", by, pad_id).withColumn("labels", tensors.label_mask(F.col("ids"), F.col("prefix"), pad_id))


def transcribe(samples: DataFrame, factory: infer.Factory, payload: str, frames: str, budget: int = 24_000, cap: int = 32, partitions: int | None = None, ordered: bool = True, **options) -> DataFrame:
    """Texts, in the order of sample_id if ``ordered`` (for which Spark generates them twice: to find ranges, and to deal them). Batches hold samples of like length, at most ``cap`` and at most ``budget`` frames in all
    (no bound if 0); a batch is one task's, and batches are dealt to tasks by their numbers."""
    batches = batching.pack(samples, frames, budget=budget, cap=cap, partitions=partitions).select("batch_id", "pos", "sample_id")
    dealt = samples.join(batches, "sample_id").repartition("batch_id").sortWithinPartitions("batch_id", "pos")
    texts = infer.transcribe(dealt, factory, payload, batch="batch_id", **options)
    return texts.orderBy("sample_id") if ordered else texts


def evaluate(references: DataFrame, predictions: DataFrame, step: int, table: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(per-sample errors, data-set means) of texts joined by sample_id; the means are added to the metrics table if one is named."""
    rows = references.select("sample_id", "gt_text").join(predictions.select("sample_id", F.col("text").alias("pred_text")), "sample_id", "left")
    samples = metrics.per_sample(rows)
    means = metrics.over_all(samples)
    if table:
        sinks.append_scalars(report.scalars(means, step), table)
    return samples, means


#: Characters of a text that a validation pass shows.
SHOWN = 300


def validate(samples: DataFrame, factory: infer.Factory, payload: str, step: int, config: RunConfig, num_samples: int = 5, num_display: int = 5, budget: int = 0, cap: int = 32, table: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A validation pass at a training step, over the first ``num_samples`` of ``samples`` (sample_id, syllables, bpm, mel_frames; all if
    negative): texts are generated in batches of like length, at most ``cap`` samples and ``budget`` frames (no bound if 0).

    Returns the shown texts (sample_id, gt, pred, readable) of the first ``num_display`` samples; their scores as notes (sample_id, side,
    k, pitch, note, width, start) wherever both can be read; and the scalars (step, key, value) of all samples' errors, which are
    added to the metrics table if one is named. Samples without a text count as read wrong, not as missing.
    """
    rows = written(targets(report.first_samples(samples, num_samples), config))  # read by packing, generating and the join
    texts = transcribe(rows, factory, payload, "mel_frames", budget, cap, ordered=False)
    both = rows.select("sample_id", F.col("target").alias("gt_text")).join(texts.withColumnRenamed("text", "pred_text"), "sample_id", "left")
    both = written(both)  # generated once, read three times
    scalars = report.scalars(metrics.over_all(metrics.per_sample(both)), step)
    if table:
        sinks.append_scalars(scalars, table)
    shown = report.first_samples(both, min(num_display, num_samples) if num_samples > 0 else num_display)
    shown = shown.withColumn("_g", parse.parse(F.col("gt_text"))).withColumn("_p", parse.parse(F.col("pred_text")))
    readable = F.col("_g").isNotNull() & F.col("_p").isNotNull()
    heads = shown.select("sample_id", F.left("gt_text", F.lit(SHOWN)).alias("gt"), F.left("pred_text", F.lit(SHOWN)).alias("pred"), readable.alias("readable"))
    sides = F.array(*[F.struct(F.lit(name).alias("side"), F.col(f"{c}.entries").alias("entries")) for name, c in (("gt", "_g"), ("pred", "_p"))])
    notes = shown.where(readable).select("sample_id", F.explode(sides).alias("s")).select("sample_id", "s.side", F.posexplode("s.entries").alias("k", "e")).select("sample_id", "side", "k", "e.pitch", "e.note")
    return heads, report.geometry(notes, ["sample_id", "side"], "k"), scalars
