"""Queries of sources, sinks and whole jobs, over files that they write below the shared folder, with DuckDB SQL for each."""

from __future__ import annotations

import io
import json
import wave
from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreforge.config import RunConfig
from scoreforge.functions import template, vocab
from scoreforge.operators import encode, features
from scoreforge.session import put, scratch
from scoreforge.sources import annotations as sources
from scoreforge.sources import sinks
from scoreforge.streaming import score

from . import pipelines
from .fixtures import annotations, songs, stub_features, sylls, table, texts
from .oracles import ANNOTATIONS, DIM, METRICS, PACK, PAD_W, TEXTS, packed, parsed
from .oracles import ORACLE_SQL as SCORED_SQL
from .registry import query

#: Songs of one file of a JSON list.
SONGS_A_FILE = 5000
BUDGET, CAP, SHARD = 24_000, 64, 1000
CHAT = "{% for m in messages %}{% if loop.first and m.role != 'system' %}{{ '<|system|>' }}{% endif %}<|{{ m['role'] }}|>{{ m.content | trim }}{% if not loop.last %},{% endif %}{% endfor %}{% if add_generation_prompt %}<|assistant|>{% endif %}"


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


# ---------------------------------------------------------------- sources


def _sound(n: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(b"\x01\x01" * n)
    return out.getvalue()


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """A song for each nation (25): a segment with sound, for some a second file that is none, a broken annotation, one without
    sound; a quarter of the songs have no tempo."""
    root = scratch(spark, "songs")
    for (k,) in table(spark, sf_dir, "nation").select("n_nationkey").collect():
        n = 1 + k % 3
        note = json.dumps({"word": ["la"] * n, "pitch": [60 + i for i in range(n)], "note": ["<NOTE_4>"] * n, "pitch2word": list(range(n)), "bpm": 1}).encode()
        files = {"seg0.wav": _sound(160 * (k % 5)), "seg0.json": note, "seg2.json": note}
        if k % 4:
            files["metadata.json"] = json.dumps({"bpm": 60 + k}).encode()
        if k % 3 == 0:
            files["seg0.flac"] = b"odd"
        if k % 7 == 0:
            files |= {"seg1.wav": _sound(160), "seg1.json": b"{broken"}
        for name, content in files.items():
            put(spark, f"{root}/song{k}/{name}", content)
    return root


def _json_list(spark: SparkSession, sf_dir: str) -> str:
    """All songs as a JSON list in files; half of their sound files are there (tables stand in for them)."""
    path = scratch(spark, "list")
    sound = F.element_at(F.array(*[F.lit(x) for x in ("region.parquet", "nation.parquet", "gone.flac", "")]), (F.col("sid") % 4 + 1).cast("int"))
    item = F.to_json(F.struct("word", "pitch", "note", "pitch2word", F.when(F.col("sid") % 13 != 0, F.col("bpm")).alias("bpm"), sound.alias("wav_fn")))
    lists = annotations(spark, sf_dir).groupBy(F.floor(F.col("sid") / SONGS_A_FILE).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value"))
    lists.write.partitionBy("file").text(path)
    return path


@query
def folder_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.folder(spark, "songs", _tree(spark, sf_dir))
    return rows.select(F.regexp_extract("audio_path", "([^/]+/[^/]+)$", 1).alias("name"), "bpm", F.size("syllables").alias("n_syllables"))


@query
def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.json_file(spark, "list", _json_list(spark, sf_dir), sf_dir, split_bytes=1 << 18)
    pitches = F.aggregate(F.flatten(F.transform("syllables", lambda s: s["pitch"])), F.lit(0), lambda a, x: a + x)
    rows = rows.select(F.regexp_extract("audio_path", "([^/]+)$", 1).alias("name"), "bpm", F.size("syllables").alias("w"), pitches.alias("p"))
    return rows.groupBy("name", "bpm").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("n_words"), F.sum("p").alias("pitches"))


@query
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = [
        {"name": "songs", "root": _tree(spark, sf_dir)},
        {"name": "odd", "type": "unknown"},
        {"name": "list", "type": "json_file", "json_path": _json_list(spark, sf_dir), "audio_root": sf_dir},
    ]
    return sources.all_datasets(spark, configs, 40).groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"))


@query
def eval_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "eval")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.json(path)
    return sources.eval_json(spark, path).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def in_memory_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves that a program holds, one for each supplier, as a table."""
    held = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_nationkey").collect()  # what is in memory by its nature
    rows = sources.arrays(spark, [np.full(r.s_suppkey % 64, r.s_nationkey / 2) for r in held])
    return rows.select("sample_id", F.size("wave").alias("n"), F.aggregate("wave", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query
def run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration over the documents' languages as data sets: known fields, defaults, and what wins over what."""
    langs = [r.lang for r in table(spark, sf_dir, "documents").where("lang is not null").select("lang").distinct().orderBy("lang").collect()]  # data sets
    n = table(spark, sf_dir, "documents").count()
    given = {"datasets": [{"name": x} for x in langs], "output_dir": "out", "max_samples": n, "unknown": 1, "asr_cot": True, "seed": None, "val_datasets": langs[:1]}
    made = RunConfig.of(given, max_samples=n // 2, bpm_position=None, shard_size=100)
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in asdict(made).items()], "name string, value string")


@query
def vocabulary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as checkpoints whose vocabularies are some hundred tokens larger than their base's."""
    base = F.when(F.col("p_partkey") % 2 == 0, 151_936).otherwise(0).cast("long")
    rows = table(spark, sf_dir, "part").select("p_partkey", base.alias("base"), (base + 390 + F.col("p_partkey") % 1010).alias("size"))
    return rows.withColumn("fits", vocab.vocabulary_fits(F.col("base"), F.col("size")))


# ---------------------------------------------------------------- features


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "features")
    sinks.write_features(stub_features(spark, sf_dir), path, SHARD)
    return path


@query
def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written, read again by column, and whether no file has too many rows."""
    path = _stored(spark, sf_dir)
    files = sources.stored(spark, path).groupBy("dataset_name", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    most = files.groupBy(F.col("dataset_name").alias("name")).agg((F.max("n") <= SHARD).alias("files_fit"))
    rows = sources.stored(spark, path, ["dataset_name", "mel_frames", "input_features"])
    rows = rows.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), F.sum("mel_frames").alias("n_frames"), F.sum(F.octet_length("input_features")).cast("long").alias("n_bytes"))
    return rows.join(most, F.col("dataset_name") == F.col("name")).drop("name")


@query
def feature_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = sinks.described(spark, _stored(spark, sf_dir), "events")
    return told.select("description", "num_rows", F.json_array_length(F.get_json_object("features", "$.fields")).alias("n_columns"), (F.size("files") == F.col("num_shards")).alias("all_files"))


def _shapes(batches):
    for pdf in batches:
        shape = [features.frames_of(*r).shape for r in pdf[["input_features", "mel_frames", "mel_bins"]].itertuples(index=False)]
        yield pdf[["dataset_name"]].assign(n_frames=[s[0] for s in shape], n_bins=[s[1] for s in shape])


@query
def feature_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored features as frames by bins again."""
    rows = stub_features(spark, sf_dir).where("status = 'ok'").mapInPandas(_shapes, "dataset_name string, n_frames long, n_bins long")
    return rows.groupBy("dataset_name", "n_frames", "n_bins").agg(F.count(F.lit(1)).alias("n"))


@query
def preprocess_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = RunConfig.of({"datasets": [{"name": "songs", "root": _tree(spark, sf_dir)}], "output_dir": scratch(spark, "preprocessed"), "shard_size": 10})
    told = pipelines.preprocess(spark, config, features.energy_bins(), features.decode_audio())
    return told.select("num_samples", "errors", "skipped_missing", "total_bytes", "avg_mel_frames", "format", "sample_rate")


# ---------------------------------------------------------------- training and scoring


def _samples(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Songs as samples, with more columns made of them."""
    rows = songs(spark, sf_dir)
    return rows.select(F.col("sid").alias("sample_id"), F.format_string("songs/%d.flac", "sid").alias("audio_path"), sylls("gt").alias("syllables"), "bpm", (F.col("sid") % 90).cast("int").alias("mel_frames"), *more)


@query
def raw_training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.raw_records(_samples(spark, sf_dir), "prompt", RunConfig())


def letters():
    """A tokenizer of letters: the id of each is its code point."""
    return lambda texts: [[ord(c) for c in t] for t in texts], lambda ids: ["".join(map(chr, x)) for x in ids]


@query
def training_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs of batches of songs; the prompt is a letter and a placeholder of audio."""
    rows = _samples(spark, sf_dir)
    batches = rows.select("sample_id", (F.col("sample_id") % 50).alias("batch_id"), F.lit(0).alias("pos"))
    made = pipelines.model_inputs(rows, batches, RunConfig(), letters, "ab", "c", 0, ord("b"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return made.select("sample_id", F.size("ids").alias("n_ids"), total("attention_mask").alias("n_real"), "prefix", F.size(F.filter("labels", lambda x: x != -100)).alias("n_labels"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("n_chars").alias("mel_frames"), "text")


@query
def plain_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = RunConfig(max_batch_tokens=BUDGET, max_batch_size=CAP)
    return pipelines.training_batches(_lengths(spark, sf_dir), config, shuffle=False).select("batch_id", "pos", "sample_id", "length")


@query
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of an epoch, packed in its shuffled order, and the turn of each."""
    config = RunConfig(max_batch_tokens=BUDGET, max_batch_size=CAP)
    return pipelines.training_batches(_lengths(spark, sf_dir), config, epoch=1)


def batch_sizes():
    """Stands in for a model: each text tells the size of its batch."""
    return lambda payloads, prompts: [str(len(payloads))] * len(payloads)


@query
def transcription_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.transcribe(_lengths(spark, sf_dir), batch_sizes, "text", "mel_frames", BUDGET, 32)


@query
def evaluation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and predictions of two tables, met by sample_id; a prediction of no reference plays no part."""
    rows = texts(spark, sf_dir)
    predictions = rows.select(F.col("sid").alias("sample_id"), F.col("pred_text").alias("text"))
    stray = spark.createDataFrame([(-1, "la <P_60> <NOTE_4> <BPM_120>")], "sample_id long, text string")
    scored, _ = pipelines.evaluate(rows.select(F.col("sid").alias("sample_id"), "gt_text"), predictions.unionByName(stray), 1)
    return _rounded(scored.drop("gt_text", "pred_text"))


def recalled():
    """Stands in for a model: each payload is the text that it writes."""
    return lambda payloads, prompts: list(payloads)


def _validated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _samples(spark, sf_dir, encode.text(sylls("pred"), F.col("pred_bpm")).alias("pred_text"))
    return pipelines.validate(rows, recalled, "pred_text", 7, RunConfig(), num_samples=-1, num_display=20, budget=2000)


@query
def validation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a validation pass shows: its first twenty samples."""
    return _validated(spark, sf_dir)[0]


@query
def validation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of those, as a figure of both would have them."""
    return _validated(spark, sf_dir)[1]


@query
def validation_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of a validation pass over all songs."""
    return _validated(spark, sf_dir)[2].withColumn("value", F.round("value", 4))


@query
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a chat template writes them."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    text = template.rendered(CHAT, F.col("m"), turns.schema["m"].dataType, True)
    return turns.select("conv_id", F.size("m").alias("n_turns"), F.md5(text.cast("binary")).alias("text_md5"))


@query
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same errors by the stream, of files that came in."""
    incoming, out = scratch(spark, "incoming"), scratch(spark, "scores")
    texts(spark, sf_dir).write.json(incoming)
    score.start(spark, incoming, out, scratch(spark, "progress")).awaitTermination()
    return _rounded(spark.read.parquet(out))


_ERRORS = "cer, pitch_mae, note_mae, dur_mae, bpm_mae, n_gt_words, n_pred_words, n_aligned_pairs"

_FILES = "s AS (SELECT n_nationkey AS k FROM nation), f AS (SELECT k, 'wav' AS e FROM s UNION ALL SELECT k, 'flac' FROM s WHERE k % 3 = 0)"
_EVENTS = "e AS (SELECT event_type AS dataset_name, event_id % 5 AS frames FROM events WHERE event_id % 10 > 1)"
ORACLE_SQL = {
    "folder_source": f"WITH {_FILES} SELECT 'song' || k || '/seg0.' || e AS name, CAST(CASE WHEN k % 4 = 0 THEN 120 ELSE 60 + k END AS INTEGER) AS bpm, CAST(1 + k % 3 AS INTEGER) AS n_syllables FROM f",
    "json_source": f"""WITH {ANNOTATIONS}, w AS (SELECT sid, count(DISTINCT word_no) AS w, sum(pitch) AS p FROM syl GROUP BY sid)
SELECT CASE sid % 4 WHEN 0 THEN 'region.parquet' ELSE 'nation.parquet' END AS name, CAST(CASE WHEN sid % 13 = 0 THEN 120 ELSE sid % 300 END AS INTEGER) AS bpm, count(*) AS n,
  CAST(sum(coalesce(w, 0)) AS BIGINT) AS n_words, CAST(sum(coalesce(p, 0)) AS BIGINT) AS pitches
FROM ann LEFT JOIN w USING (sid) WHERE sid % 4 < 2 AND len(word) > 0 AND len(pitch) > 0 AND len(note) > 0 GROUP BY 1, 2""",
    "source_dispatch": f"WITH {_FILES} SELECT 'songs' AS dataset_name, count(*) AS n FROM f UNION ALL SELECT 'list', 40 - count(*) FROM f",
    "eval_source": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "in_memory_waves": "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS sample_id, CAST(s_suppkey % 64 AS INTEGER) AS n, CAST(s_suppkey % 64 * s_nationkey / 2.0 AS DOUBLE) AS total FROM supplier",
    "run_config": """WITH l AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
SELECT 'datasets' AS name, '[' || string_agg('{"name": "' || lang || '"}', ', ' ORDER BY lang) || ']' AS value FROM l UNION ALL SELECT 'val_datasets', '["' || min(lang) || '"]' FROM l
UNION ALL SELECT 'max_samples', CAST(count(*) // 2 AS VARCHAR) FROM documents
UNION ALL SELECT unnest(['eval_file', 'output_dir', 'bpm_position', 'asr_cot', 'shard_size', 'sample_rate', 'max_batch_tokens', 'max_batch_size', 'seed']),
  unnest(['""', '"out"', '"last"', 'true', '100', '16000', '24000', '64', '42'])""",
    "vocabulary_sizes": """SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 151936 ELSE 0 END AS BIGINT) AS base, CASE WHEN p_partkey % 2 = 0 THEN 151936 ELSE 0 END + 390 + p_partkey % 1010 AS size,
  390 + p_partkey % 1010 IN (128 + 12 + 256, 128 + 12 + 256 + 2 + 1000) AS fits FROM part""",
    "stored_features": f"WITH {_EVENTS} SELECT dataset_name, count(*) AS n, CAST(sum(frames) AS BIGINT) AS n_frames, CAST(sum(frames * 16) AS BIGINT) AS n_bytes, true AS files_fit FROM e GROUP BY dataset_name",
    "feature_descriptor": f"WITH {_EVENTS} SELECT 'events' AS description, count(*) AS num_rows, 6 AS n_columns, true AS all_files FROM e",
    "feature_frames": f"WITH {_EVENTS} SELECT dataset_name, frames AS n_frames, CAST(8 AS BIGINT) AS n_bins, count(*) AS n FROM e GROUP BY dataset_name, frames",
    "preprocess_job": """SELECT count(*) AS num_samples, count(*) FILTER (WHERE n_nationkey % 3 = 0) AS errors, CAST(0 AS BIGINT) AS skipped_missing, CAST(sum(n_nationkey % 5 * 16) AS BIGINT) AS total_bytes,
  round(avg(n_nationkey % 5), 1) AS avg_mel_frames, 'parquet' AS format, 16000 AS sample_rate FROM nation""",
    "raw_training_records": f"WITH {TEXTS} SELECT 'songs/' || sid || '.flac' AS audio, 'language Chinese<asr_text>' || gt_text AS text, 'prompt' AS prefix_text FROM gt_texts",
    "training_inputs": f"""WITH {TEXTS}, n AS (SELECT sid, 1 + greatest(1, ceil(sid % 90 / 8.0)) AS p, length('language Chinese<asr_text>' || gt_text) + 1 AS t FROM gt_texts)
SELECT sid AS sample_id, CAST(max(p + t) OVER (PARTITION BY sid % 50) AS INTEGER) AS n_ids, CAST(p + t AS INTEGER) AS n_real, CAST(p AS INTEGER) AS prefix, CAST(t AS INTEGER) AS n_labels FROM n""",
    "plain_batches": f"WITH RECURSIVE {packed('pk', PAD_W, BUDGET, CAP, order='doc_id')} SELECT batch_id, pos, doc_id AS sample_id, n AS length FROM pk",
    "epoch_batches": f"""WITH RECURSIVE c AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // greatest(100, count(*) OVER () // 10) AS chunk FROM documents),
shuf AS (SELECT doc_id, n_chars, md5('43:' || chunk) AS a, md5('43:' || doc_id) AS b FROM c),{packed('pk', PAD_W, BUDGET, CAP, order='a, b', source='shuf')}
SELECT batch_id, pos, doc_id AS sample_id, n AS length, md5('43:' || batch_id) AS turn FROM pk""",
    "transcription_job": f"WITH RECURSIVE {PACK} SELECT doc_id AS sample_id, CAST(count(*) OVER (PARTITION BY batch_id) AS VARCHAR) AS text FROM pk",
    "evaluation_job": f"WITH RECURSIVE {METRICS} SELECT sid AS sample_id, {_ERRORS} FROM metrics",
    "validation_texts": f"""WITH {TEXTS},{parsed('p', 'pred_texts', 'pred_text')} SELECT sid AS sample_id, left('language Chinese<asr_text>' || gt_text, 300) AS gt, left(pred_text, 300) AS pred,
  sid IN (SELECT sid FROM p_e) AS readable FROM gt_texts JOIN pred_texts USING (sid) ORDER BY sid LIMIT 20""",
    "validation_notes": f"""WITH {TEXTS}, {DIM},{parsed('p', 'pred_texts', 'pred_text')}, f AS (SELECT sid FROM gt_texts ORDER BY sid LIMIT 20),
n AS (SELECT sid AS sample_id, 'gt' AS side, k, pitch, note FROM notes_gt SEMI JOIN p_e USING (sid) SEMI JOIN f USING (sid) UNION ALL SELECT sid, 'pred', entry_idx, pitch, note FROM p_e SEMI JOIN f USING (sid))
SELECT sample_id, side, k, pitch, note, beats AS width, coalesce(sum(beats) OVER (PARTITION BY sample_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM n JOIN dim USING (note)""",
    "validation_scalars": SCORED_SQL["metrics_scalars"],
    "chat_prompts": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, CAST(any_value(n) AS INTEGER) AS n_turns, md5(string_agg(CASE WHEN i = 1 AND coalesce(role, '') <> 'system' THEN '<|system|>' ELSE '' END || '<|' || coalesce(role, '') || '|>'
  || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') || CASE WHEN i < n THEN ',' ELSE '' END, '' ORDER BY i) || '<|assistant|>') AS text_md5 FROM t GROUP BY conv_id""",
    "stream_scores": f"WITH RECURSIVE {METRICS} SELECT sid, {_ERRORS} FROM metrics",
}
