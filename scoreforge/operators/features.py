"""Mel features: an extractor is an adapter, and so is a decoder; rows never fail a task but carry a status.

Audio is opened by path in the task that needs it, so that no audio crosses a shuffle.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreforge.schemas import FEATURE
from scoreforge.sources.files import store_of

from . import sound

#: waveform (float32), sample rate -> (mel of bins x frames, frames that are real)
Extractor = Callable[[np.ndarray, int], tuple[np.ndarray, int]]


def energy_bins(bins: int = 8, hop: int = 160) -> Extractor:
    """A cheap extractor for tests: mean absolute value of each hop's ``bins`` parts; that of speech models is ``sound.log_mel``."""

    def run(x: np.ndarray, rate: int) -> tuple[np.ndarray, int]:
        frames = len(x) // hop
        cut = np.abs(x[: frames * hop]).reshape(frames, bins, hop // bins)
        return cut.mean(axis=2).T.astype(np.float32), frames

    return run


def trim(mel: np.ndarray, frames: int) -> tuple[bytes, int, int]:
    """Real frames only (all if none is marked), frames by bins, as little-endian half floats."""
    own = mel[:, : frames or mel.shape[1]].T
    return np.ascontiguousarray(own, dtype="<f2").tobytes(), own.shape[0], own.shape[1]


def frames_of(data: bytes, frames: int, bins: int) -> np.ndarray:
    """Frames by bins of stored features."""
    return np.frombuffer(data, "<f2").reshape(frames, bins)


def decode_pcm16(content: bytes) -> np.ndarray:
    """Raw 16-bit mono samples as float32: the decoder for tests; other codecs are adapters of the same shape."""
    return np.frombuffer(content, "<i2").astype(np.float32) / 32768.0


def decode_wav(rate: int = 16000) -> Callable[[bytes], np.ndarray]:
    """A decoder of RIFF/WAVE files of 8, 16 or 32 bits: channels become one by their mean, and the rate becomes ``rate``."""

    def run(content: bytes) -> np.ndarray:
        with wave.open(io.BytesIO(content)) as f:
            own, channels, width, data = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128 if width == 1 else np.frombuffer(data, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
        return sound.resample(x.reshape(-1, channels).mean(axis=1), own, rate)

    return run


def decode_audio(rate: int = 16000) -> Callable[[bytes], np.ndarray]:
    """A decoder of WAVE and FLAC files, told apart by their first bytes; other containers are adapters of the same shape."""
    waves = decode_wav(rate)

    def run(content: bytes) -> np.ndarray:
        if content[:4] != sound.MAGIC:
            return waves(content)
        return made(*sound.decode_flac(content))

    def made(x: np.ndarray, own: int, width: int) -> np.ndarray:
        return sound.resample((x / (1 << (width - 1))).mean(axis=1), own, rate)

    def many(contents: list[bytes | None]) -> list[np.ndarray | Exception | None]:
        """The same of many, FLAC files decoded together; of one that can't be read the error, of none none."""
        out: list = [None] * len(contents)
        flac = [i for i, c in enumerate(contents) if c is not None and c[:4] == sound.MAGIC]
        found = dict(zip(flac, sound.decode_flac_many([contents[i] for i in flac])))
        for i, c in enumerate(contents):
            try:
                out[i] = None if c is None else found[i] if isinstance(found.get(i), Exception) else made(*found[i]) if i in found else waves(c)
            except Exception as odd:  # noqa: BLE001 - a status of its row
                out[i] = odd
        return out

    run.many = many
    return run


def open_file(path: str) -> bytes | None:
    """What is in a file of any store that Arrow reads; None if it is not there or empty."""
    store, inside = store_of(path)
    try:
        with store.open_input_stream(inside) as f:
            return f.read() or None
    except FileNotFoundError:
        return None


def extract(samples: DataFrame, extractor: Extractor, decoder: Callable[[bytes], np.ndarray] = decode_pcm16, rate: int = 16000, opener: Callable[[str], bytes | None] = open_file) -> DataFrame:
    """Features of ``samples`` (dataset_name, syllables, bpm and either content binary or audio_path): status ok, missing (null
    content, no such file, an empty one) or error."""
    given = "content" if "content" in samples.columns else "audio_path"
    many = getattr(decoder, "many", None) if given == "content" else None  # what is opened by path is held one at a time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):  # what is made of so many is in memory
                rows, some = [], pdf.iloc[at : at + 256]
                together = many(some["source"].tolist()) if many else [None] * len(some)
                for r, heard in zip(some.itertuples(index=False), together):
                    data, frames, bins, status = None, None, None, "ok"
                    try:
                        if isinstance(heard, Exception):
                            raise heard
                        content = r.source if given == "content" or r.source is None else opener(r.source)
                        if content is None:
                            status = "missing"
                        else:
                            data, frames, bins = trim(*extractor(decoder(content) if heard is None else heard, rate))
                    except Exception:  # noqa: BLE001 - a bad file is a status, not a failed task
                        status = "error"
                    rows.append((r.dataset_name, data, frames, bins, r.syllables, r.bpm, status))
                yield pd.DataFrame(rows, columns=["dataset_name", "input_features", "mel_frames", "mel_bins", "syllables", "bpm", "status"]).astype({"mel_frames": "Int32", "mel_bins": "Int32", "bpm": "Int32"})

    return samples.select("dataset_name", F.col(given).alias("source"), "syllables", "bpm").mapInPandas(run, FEATURE)


def statistics() -> list[Column]:
    """Counts by status, bytes stored and mean frames, as aggregates: of a table, or observed while it is written."""
    ok = F.col("status") == "ok"
    return [
        F.count_if(ok).alias("num_samples"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "missing").alias("skipped_missing"),
        F.coalesce(F.sum(F.when(ok, F.octet_length("input_features"))), F.lit(0)).alias("total_bytes"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("mel_frames"))), F.lit(0)) / F.greatest(F.count_if(ok), F.lit(1)), 1).alias("avg_mel_frames"),
    ]


def run_statistics(features: DataFrame) -> DataFrame:
    """``statistics`` of all rows."""
    return features.agg(*statistics())
