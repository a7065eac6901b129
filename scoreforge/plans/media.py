"""Queries of sound, over waves that Spark makes from the notes of ``lineitem``, with DuckDB SQL for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreforge.operators import align, features, sound

from .fixtures import songs
from .oracles import GT
from .registry import query

#: Samples of a note, the rate, and the spectra's window, hop and bins: few of each, so that SQL can transform them directly.
NOTE, RATE, SIZE, HOP, BINS = 16, 160, 16, 8, 4


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, wave: each note a saw-tooth of its own pitch, in samples of 16 bits."""
    one = lambda n: F.transform(F.sequence(F.lit(0), F.lit(NOTE - 1)), lambda t: ((t * (n["pitch"] - 50)) % 64 - 32) * 200)
    return songs(spark, sf_dir).select("sid", F.flatten(F.transform("gt", one)).alias("wave"))


def _per_wave(column: str, function, names: dict[str, pa.DataType]):
    """A task's function that puts what ``function`` makes of each value of ``column`` beside sid."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            made = [function(x) for x in batch.column(at).to_pylist()]
            cols = zip(*made) if made else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, names.values()))], ["sid", *names])

    return run


def _files(rate: int):
    """A task's function that puts FLAC files of the waves beside sid, those of a batch together."""

    def run(batches):
        for batch in batches:
            wave, offs = align.flat(batch.column(batch.schema.get_field_index("wave")))
            made = sound.encode_flac_many(wave.to_numpy(zero_copy_only=False), offs, rate)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["sid", "content"])

    return run


@query
def flac_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves as FLAC files and back: number of samples, their sum, and their sum weighted by place."""
    files = _waves(spark, sf_dir).mapInArrow(_files(16000), "sid long, content binary")

    def told(batches):
        for batch in batches:
            rows = []
            for made in sound.decode_flac_many(batch.column(1).to_pylist()):
                if isinstance(made, Exception):
                    raise made
                x = made[0][:, 0]
                rows.append((len(x), int(x.sum()), int(x @ np.arange(1, len(x) + 1))))
            cols = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["sid", "n", "total", "weighted"])

    return files.mapInArrow(told, "sid long, n long, total long, weighted long")


@query
def mel_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-mel spectra of the waves: frames, and the sum of all values."""
    extract = sound.log_mel(BINS, SIZE, HOP)

    def told(x: list[int]):
        mel, frames = extract(np.array(x) / 32768, RATE)
        return frames, round(float(mel.astype(np.float64).sum()), 3)

    return _waves(spark, sf_dir).mapInArrow(_per_wave("wave", told, {"mel_frames": pa.int32(), "total": pa.float64()}), "sid long, mel_frames int, total double")


@query
def flac_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of FLAC files: decoded, brought to twice their rate, and measured."""
    files = _waves(spark, sf_dir).mapInArrow(_files(8000), "sid long, content binary")
    files = files.withColumn("dataset_name", F.col("sid").cast("string")).withColumn("bpm", F.lit(120)).withColumn("syllables", F.lit(None).cast("array<struct<char:string,pitch:array<int>,note:array<string>>>"))
    made = features.extract(files, sound.log_mel(BINS, SIZE, HOP), features.decode_audio(16000))
    return made.groupBy("status", "mel_bins").agg(F.count(F.lit(1)).alias("n"), F.sum("mel_frames").alias("n_frames"), F.sum(F.octet_length("input_features")).cast("long").alias("n_bytes"))


@query
def align_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of songs and of their predictions aligned where pitches differ by one at most and beats by half at most."""
    from scoreforge.functions.vocab import note_beats

    notes = lambda c: F.transform(c, lambda n: F.struct(n["pitch"].alias("pitch"), note_beats(n["note"]).alias("beats")))
    near = lambda x, y: (np.abs(x["pitch"] - y["pitch"]) <= 1) & (np.maximum(x["beats"], y["beats"]) <= 1.5 * np.minimum(x["beats"], y["beats"]))
    rows = songs(spark, sf_dir).select("sid", F.posexplode(align.align_where(notes("gt"), notes("pred"), near)).alias("step", "x"))
    return rows.select("sid", "step", "x.g", "x.p")


_WAVES = f"""{GT},
wv AS (SELECT sid, list(CAST(((t * (pitch - 50)) % 64 - 32) * 200 AS BIGINT) ORDER BY k, t) AS x FROM notes_gt, range({NOTE}) r(t) GROUP BY sid)"""
# A direct transform: each window's products with cosines and sines, then triangles between corners 16 Hz apart.
MEL = f"""WITH {_WAVES},
fr AS (SELECT sid, x, unnest(range(0, CAST(ceil(len(x) / {HOP}.0) AS BIGINT))) AS f FROM wv),
cut AS (SELECT sid, f, list_transform(range({SIZE}), lambda i: coalesce(x[abs(f * {HOP} + i - {SIZE // 2}) + 1], 0) / 32768.0 * (0.5 - 0.5 * cos(2 * pi() * i / {SIZE}))) AS c FROM fr),
pw AS (SELECT sid, f, list_transform(range({SIZE // 2 + 1}), lambda k: pow(list_sum(list_transform(range({SIZE}), lambda i: c[i + 1] * cos(2 * pi() * k * i / {SIZE}))), 2)
  + pow(list_sum(list_transform(range({SIZE}), lambda i: c[i + 1] * sin(2 * pi() * k * i / {SIZE}))), 2)) AS p FROM cut),
ml AS (SELECT sid, f, log10(greatest(list_sum(list_transform(range({SIZE // 2 + 1}), lambda k: greatest(0, least((10 * k - 16 * b) / 16.0, (16 * (b + 2) - 10 * k) / 16.0)) / 16.0 * p[k + 1])), 1e-10)) AS v FROM pw, range({BINS}) r(b)),
mx AS (SELECT *, max(v) OVER (PARTITION BY sid) AS m FROM ml)
SELECT sid, CAST(max(f) + 1 AS INTEGER) AS mel_frames, round(sum(CAST(CAST((greatest(v, m - 8) + 4) / 4 AS FLOAT) AS DOUBLE)), 3) AS total FROM mx GROUP BY sid"""
ORACLE_SQL = {
    "flac_round_trip": f"WITH {_WAVES} SELECT sid, len(x) AS n, CAST(list_sum(x) AS BIGINT) AS total, CAST(list_sum(list_transform(x, lambda v, i: v * i)) AS BIGINT) AS weighted FROM wv",
    "mel_spectra": MEL,
    "flac_features": f"WITH {GT}, n AS (SELECT sid, count(*) * {NOTE} * 2 // {HOP} AS f FROM notes_gt GROUP BY sid) SELECT 'ok' AS status, CAST({BINS} AS INTEGER) AS mel_bins, count(*) AS n, CAST(sum(f) AS BIGINT) AS n_frames, CAST(sum(f) * {BINS} * 2 AS BIGINT) AS n_bytes FROM n",
}
