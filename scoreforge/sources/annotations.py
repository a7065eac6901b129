"""Annotation sources: JSON lists, folder trees, several data sets under one budget, stored features."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreforge.functions.expr import once
from scoreforge.functions.vocab import DEFAULT_BPM
from scoreforge.operators.annotate import syllables
from scoreforge.operators.numbering import numbered
from scoreforge.schemas import ANNOTATION, SAMPLE
from scoreforge.session import written

from . import files

AUDIO = (".flac", ".wav", ".mp3")
#: Rows that a task may keep as its first ones in some order.
HEAD = 10_000


def whole_number(text: Column) -> Column:
    """An int of a JSON number read as text; a fraction is cut off, anything else null."""
    return F.when(text.rlike("^-?[0-9]+(\\.[0-9]+)?$"), text.try_cast("double").cast("int"))


def _numbers(texts: Column) -> Column:
    """Ints of whole JSON numbers; other elements are null, their places stay."""
    return F.transform(texts, lambda x: F.when(x.rlike("^-?[0-9]+$"), x.try_cast("int")))


def _kept(rows: DataFrame) -> DataFrame:
    """Rows with words, pitches, notes and links; syllables made of them."""
    some = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("word", "pitch", "note", "pitch2word")]
    rows = rows.where(reduce(lambda a, b: a & b, some))
    return rows.withColumn("syllables", syllables(F.col("word"), _numbers(F.col("pitch")), F.col("note"), _numbers(F.col("pitch2word"))))


def with_files(rows: DataFrame, found: DataFrame, path: str = "audio_path") -> DataFrame:
    """``rows`` whose path is among those ``found``, whatever names of the store either begins with."""
    return rows.join(found.select(files.bare(F.col("found")).alias("_found")), files.bare(F.col(path)) == F.col("_found"), "left_semi")


def json_file(spark: SparkSession, name: str, path: str, audio_root: str, max_samples: int = -1, split_bytes: int = files.SPLIT_BYTES) -> DataFrame:
    """One JSON list of annotations (or several, in the files of a folder); rows without a file name, or whose audio file is not
    there, go. Lists are read by ranges of ``split_bytes``, so that a long one is many tasks' work."""
    if files.arrow_reads(path):
        rows = once(files.json_elements(spark, path, split_bytes), "a", F.from_json("element", ANNOTATION)).select("a.*")  # not parsed anew for each condition
    else:
        rows = spark.read.option("multiLine", True).schema(ANNOTATION).json(path)
    rows = rows.where("wav_fn is not null and wav_fn <> ''").withColumn("audio_path", F.concat(F.lit(audio_root.rstrip("/") + "/"), "wav_fn"))
    rows = _kept(with_files(rows, files.existing(spark, audio_root)))
    rows = rows.select(F.lit(name).alias("dataset_name"), "audio_path", F.coalesce(whole_number(F.col("bpm")), F.lit(DEFAULT_BPM)).alias("bpm"), "syllables")
    return rows.limit(max_samples) if max_samples > 0 else rows


def folder(spark: SparkSession, name: str, root: str, max_samples: int = -1, extensions: tuple[str, ...] = AUDIO) -> DataFrame:
    """A tree root/song/segment.{audio,json} with one metadata.json a song, which alone gives the tempo (120 without it).
    A segment needs both files; each of its audio files is a sample; unreadable annotations go, and so do links. Tasks list the
    songs' folders and open their annotations; the driver sees neither. (Of stores that only Spark reads, Spark's index is used.)"""
    if files.arrow_reads(root):
        found = files.listed(spark, root, 2).where("size > 0")
        notes = files.opened(found.where("found like '%.json'").select("found")).select("found", F.from_json("content", ANNOTATION).alias("a")).select("found", "a.*")
    else:
        depth = len([p for p in root.split(":", 1)[-1].split("/") if p]) + 2
        found = files.indexed(spark, root).where(F.size(F.filter(F.split(files.bare(F.col("found")), "/"), lambda p: p != "")) == depth)
        notes = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).schema(ANNOTATION).json(root)
        notes = notes.withColumn("found", F.col("_metadata.file_path"))
    own = lambda rows: rows.withColumn("song", F.regexp_extract("found", "([^/]+)/[^/]+$", 1)).withColumn("file", F.regexp_extract("found", "([^/]+)$", 1)).withColumn("base", F.regexp_replace("file", "\\.[^.]+$", ""))
    audio = own(found).where(F.lower(F.regexp_extract("file", "(\\.[^.]+)$", 1)).isin(*extensions)).select("song", "base", F.col("found").alias("audio_path"))
    notes = own(notes)
    tempo = notes.where("file = 'metadata.json'").groupBy("song").agg(F.max(whole_number(F.col("bpm"))).alias("song_bpm"))
    rows = audio.join(_kept(notes.where("file <> 'metadata.json'")).select("song", "base", "syllables"), ["song", "base"]).join(tempo, "song", "left")
    rows = rows.select(F.lit(name).alias("dataset_name"), "audio_path", F.coalesce("song_bpm", F.lit(DEFAULT_BPM)).alias("bpm"), "syllables")
    return rows.limit(max_samples) if max_samples > 0 else rows


def budget(parts: list[DataFrame], max_samples: int, order: list[str]) -> DataFrame:
    """The parts one after another, ``max_samples`` rows in all (no bound if not positive), earlier parts first, each part's rows in
    ``order`` (rows of equal order in any). Parts behind the bound are not read.

    Of a part that may bring up to ``HEAD`` rows only its first ones are kept, by each task and then of all tasks; it is written and
    counted without the rest. For a larger bound it is written whole, and if it meets the bound its rows are numbered over ranges of
    the order, in which a checksum of the row parts those of equal order, so no task sees more than a range.
    """
    if max_samples <= 0:
        return reduce(DataFrame.unionByName, parts)
    whole, room = [], max_samples
    for part in parts:
        few = room <= HEAD
        part = written(part.orderBy(*order).limit(room) if few else part)  # read from its files once
        n = part.count()
        if n > room:
            ties = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in part.columns])))
            whole.append(numbered(part, [*order, ties], "_n").where(F.col("_n") < room).drop("_n"))
            break
        whole.append(part)
        room -= n
        if not room:
            break
    return reduce(DataFrame.unionByName, whole)


def all_datasets(spark: SparkSession, configs: list[dict], max_samples: int = -1) -> DataFrame:
    """Data sets by their ``type`` (``folder_based`` if none; unknown ones are left out), tagged by name, under one budget."""
    parts = []
    for c in configs:
        kind = c.get("type", "folder_based")
        if kind == "folder_based":
            parts.append(folder(spark, c["name"], c["root"] if "root" in c else c["dataset_root"], extensions=tuple(c.get("extensions", AUDIO))))
        elif kind == "json_file":
            parts.append(json_file(spark, c["name"], c["json_path"], c["audio_root"]))
    return budget(parts, max_samples, ["audio_path"]) if parts else spark.createDataFrame([], SAMPLE)


def eval_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines for evaluation."""
    return spark.read.json(path)


def stored(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Stored features; only the columns asked for are read."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def arrays(spark: SparkSession, waves: list) -> DataFrame:
    """In-memory waveforms as a table (sample_id, wave), by Arrow."""
    flat = [np.asarray(w, np.float32) for w in waves]
    wave = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(w) for w in flat])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.float32), *flat])))
    return spark.createDataFrame(pa.table({"sample_id": pa.array(range(len(flat)), pa.int64()), "wave": wave}), "sample_id long, wave array<float>")
