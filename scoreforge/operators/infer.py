"""Batch transcription through a model adapter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import adapters, parse
from .encode import prompt

MODES = ("audio-only", "audio-lyric")
#: Makes, once a worker, a function from (payloads, prompts) of a batch to texts. Its result for a sample must not depend on the batch.
Factory = Callable[[], Callable[[list, list[str]], list[str]]]
#: What raw audio gives in validation, where nothing is generated (a fixed text; it does not parse).
NOT_SUPPORTED = "[generation not supported for raw audio mode]"


def transcribe(samples: DataFrame, factory: Factory, payload: str, mode: str = "audio-only", lyrics: str | None = None, template: str = "", batch_size: int = 32, batch: str | None = None) -> DataFrame:
    """``sample_id, text`` for each row of ``samples``. In ``audio-lyric`` mode every row needs lyrics: rows without get a null
    text and the job goes on; no lyrics column at all is an error. Batches are runs of ``batch_size`` rows of a partition, or
    rows of one value of column ``batch`` that stand next to each other. The model is made once a worker, however many tasks
    it runs."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "audio-lyric" and lyrics is None:
        raise ValueError("audio-lyric needs a lyrics column")
    known = F.when(F.trim(F.coalesce(F.col(lyrics), F.lit(""))) != "", F.col(lyrics)) if mode == "audio-lyric" else None
    rows = samples.select("sample_id", F.col(payload).alias("payload"), prompt(F.lit(template), known).alias("prompt"), (F.col(batch) if batch else F.lit(None)).cast("long").alias("batch"))
    made = adapters.once(factory)

    def texts_of(model, part: pd.DataFrame) -> pd.DataFrame:
        ready = part["prompt"].notna()
        own = part[ready]
        texts = pd.Series([None] * len(part), index=part.index, dtype="object")
        if len(own):
            texts[ready] = model(own["payload"].tolist(), own["prompt"].tolist())
        return pd.DataFrame({"sample_id": part["sample_id"], "text": texts})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = made(), None
        for pdf in batches:
            if not len(pdf):
                continue
            if batch is None:
                for at in range(0, len(pdf), batch_size):
                    yield texts_of(model, pdf.iloc[at : at + batch_size])
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            run_no = (pdf["batch"] != pdf["batch"].shift()).cumsum()
            for no, part in pdf.groupby(run_no):
                if no < run_no.iloc[-1]:
                    yield texts_of(model, part)
            held = pdf[run_no == run_no.iloc[-1]]  # the next rows may belong to it
        if held is not None:
            yield texts_of(model, held)

    return rows.mapInPandas(run, "sample_id long, text string")


def parsed(texts: DataFrame, text: str = "text") -> DataFrame:
    """Transcriptions with what can be read of them."""
    return texts.withColumn("score", parse.parse(F.col(text)))


def echo() -> Callable[[list, list[str]], list[str]]:
    """A deterministic stand-in for a model: one note a sample, made of its payload's length."""
    return lambda payloads, prompts: [f"{p}la <P_{60 + len(str(x)) % 12}> <NOTE_4> <BPM_{len(str(x)) % 256}>" for x, p in zip(payloads, prompts)]
