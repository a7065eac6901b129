"""Errors of predicted scores against references, by sample and over a data set.

A sample is scored inside its own row: scoring adds no shuffle. Both texts of a batch's rows are read, aligned and compared in numpy
together (``reading``, ``align``), in the one pass through Python; rates and means over a data set are columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreforge.functions.vocab import SILENCES
from scoreforge.schemas import ALIGNED

from . import align, reading

#: (name, needs the extra flag)
MEANS = (("cer", False), ("pitch_mae", False), ("note_mae", False), ("dur_mae", False), ("bpm_mae", False), ("pitch_error_rate", True), ("note_num_mean_error", True))


#: What alignment adds to a row: whether the prediction can be read, the difference of tempos, the words' alignment, the lyrics but silences,
#: their errors and lengths, the numbers of words, the words that face each other, their notes' alignments, and means over the notes that face each other.
ADDED = T.StructType(
    [T.StructField("_read", T.BooleanType()), T.StructField("_bpm_gap", T.IntegerType()), T.StructField("_words", ALIGNED.elementType), T.StructField("_gs", T.ArrayType(T.StringType())), T.StructField("_ps", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.IntegerType()) for n in ("_errors", "_n_gl", "_n_pl", "_n_gw", "_n_pw", "_n_pairs")]
    + [T.StructField("_facing", ALIGNED.elementType), T.StructField("_notes", ALIGNED)]
    + [T.StructField(n, T.DoubleType()) for n in ("_pitch_gap", "_note_gap", "_dur_gap", "_pitch_wrong", "_count_gap")]
)


#: What can be asked of ``aligned``, with the columns that it adds.
PARTS = {
    "words": ("_words", "_n_gw", "_n_pw"), "sung": ("_gs", "_ps"), "lyrics": ("_errors", "_n_gl", "_n_pl"), "notes": ("_facing", "_notes", "_n_gw", "_n_pw"),
    "errors": ("_read", "_bpm_gap", "_n_gw", "_n_pw", "_n_pairs", "_pitch_gap", "_note_gap", "_dur_gap", "_pitch_wrong", "_count_gap"),
}


def _means(values: np.ndarray, of: np.ndarray, rows: int) -> pa.Array:
    """Means of values by row; null for no values, or where one of them is."""
    n = np.bincount(of, minlength=rows)
    means = np.bincount(of, values, rows) / np.maximum(n, 1)
    return pa.array(means, pa.float64(), mask=(n == 0) | np.isnan(means))


def _alignments(gt: pa.Array, pred: pa.Array, by_place: bool, parts: set[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Which rows of a batch have a reference that can be read, and columns of ``ADDED``, as far as they are asked for."""
    names: dict[str, int] = {}
    sides = g, p = reading.read(gt, names), reading.read(pred, names)
    ints = lambda x: pa.array(np.asarray(x, np.int32))
    rows, notes = len(gt), bool(parts & {"notes", "errors"})
    made = {"_read": pa.array(p.readable), "_n_gw": ints(np.diff(g.word_offs)), "_n_pw": ints(np.diff(p.word_offs))}
    made["_bpm_gap"] = pa.array(np.abs(g.bpm - p.bpm).astype(np.int32), mask=~p.readable)
    if "words" in parts or (notes and not by_place):
        met_g, met_p, met_offs = align.align_many(g.chars, g.word_offs, p.chars, p.word_offs)
        made["_words"] = align.listed(align.cells(met_g, met_p), met_offs) if "words" in parts else None
    silent, lyrics = [names[x] for x in SILENCES if x in names], []
    for x in sides:
        at = np.flatnonzero(~np.isin(x.chars, silent))
        row = np.searchsorted(x.word_offs, at, side="right") - 1
        lyrics.append((x.chars[at], at - x.word_offs[row], np.searchsorted(row, np.arange(rows + 1))))
    (gl, g_at, gl_offs), (pl, p_at, pl_offs) = lyrics
    made |= {"_n_gl": ints(np.diff(gl_offs)), "_n_pl": ints(np.diff(pl_offs))}
    if "sung" in parts:
        words_ = pa.array(list(names), pa.string())
        made |= {n: align.listed(words_.take(pa.array(x)), offs) for n, x, offs in (("_gs", gl, gl_offs), ("_ps", pl, pl_offs))}
    if "lyrics" in parts:
        lg, lp, l_offs = align.align_many(gl, gl_offs, pl, pl_offs)
        of = np.repeat(np.arange(rows), np.diff(l_offs))
        wrong = (lg < 0) | (lp < 0)
        both = np.flatnonzero(~wrong)
        wrong[both] = gl[gl_offs[of[both]] + lg[both]] != pl[pl_offs[of[both]] + lp[both]]
        made["_errors"] = ints(np.bincount(of[wrong], minlength=rows))
    if not notes:
        return g.readable, made
    if by_place:
        n = np.minimum(np.diff(gl_offs), np.diff(pl_offs))
        face_row = np.repeat(np.arange(rows), n)
        k = np.arange(len(face_row)) - np.repeat(np.cumsum(n) - n, n)
        face_g, face_p = g_at[gl_offs[face_row] + k], p_at[pl_offs[face_row] + k]
    else:
        at = np.flatnonzero((met_g >= 0) & (met_p >= 0))
        face_row = np.repeat(np.arange(rows), np.diff(met_offs))[at]
        face_g, face_p = met_g[at], met_p[at]
    own, seqs = [], []
    for x, place in ((g, face_g), (p, face_p)):
        word = x.word_offs[face_row] + place
        start, n = x.note_offs[word], x.note_offs[word + 1] - x.note_offs[word]
        offs = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(start - offs[:-1], n) + np.arange(offs[-1])
        own.append((start, n))
        seqs += [x.pitch[at] * len(reading.BEATS) + x.note[at], offs]
    note_g, note_p, note_offs = align.align_many(*seqs)
    if "notes" in parts:
        face_offs = np.searchsorted(face_row, np.arange(rows + 1))
        made["_facing"] = align.listed(align.cells(face_g, face_p), face_offs)
        made["_notes"] = align.listed(align.listed(align.cells(note_g, note_p), note_offs), face_offs)
    if "errors" not in parts:
        return g.readable, made
    both = np.flatnonzero((note_g >= 0) & (note_p >= 0))
    face = np.repeat(np.arange(len(face_row)), np.diff(note_offs))[both]
    (g_start, g_n), (p_start, p_n) = own
    at_g, at_p, of = g_start[face] + note_g[both], p_start[face] + note_p[both], face_row[face]
    g_pitch, p_pitch = (np.where(x.pitch[at] < 0, np.nan, x.pitch[at]) for x, at in ((g, at_g), (p, at_p)))
    g_beats, p_beats = reading.BEATS[g.note[at_g]], reading.BEATS[p.note[at_p]]
    g_spb, p_spb = (60.0 / np.maximum(x.bpm, 1) for x in sides)
    gap = g_pitch - p_pitch
    made |= {"_n_pairs": ints(np.bincount(of, minlength=rows)), "_pitch_gap": _means(np.abs(gap), of, rows), "_pitch_wrong": _means(np.where(np.isnan(gap), np.nan, gap != 0), of, rows)}
    made["_note_gap"] = _means(np.abs(np.log2(g_beats) - np.log2(p_beats)), of, rows)
    made["_dur_gap"] = _means(np.abs(np.log2(g_beats * g_spb[of]) - np.log2(p_beats * p_spb[of])), of, rows)
    made["_count_gap"] = _means(np.abs(g_n - p_n).astype(float), face_row, rows)
    return g.readable, made


def aligned(rows: DataFrame, gt: str = "gt_text", pred: str = "pred_text", keep: list[str] | None = None, length_matched: bool = False, parts: tuple[str, ...] = ("errors", "lyrics")) -> DataFrame:
    """The columns ``keep`` (all by default) of rows whose reference can be read, with what the ``parts`` asked for bring (``PARTS``). Texts are read
    and only those alignments are made, a batch at a time; the rows pass through Python once."""
    keep = rows.columns if keep is None else keep
    sent = rows.select(*keep, *[c for c in (gt, pred) if c not in keep])
    g_at, p_at, n_kept = sent.columns.index(gt), sent.columns.index(pred), len(keep)
    asked = {*parts, "lyrics"} if length_matched else set(parts)
    added = [f for f in ADDED.fields if any(f.name in PARTS[p] for p in asked)]
    if length_matched and "errors" not in asked:
        added.append(ADDED["_read"])
    wanted = [f.name for f in added]

    def run(batches):
        for batch in batches:
            readable, made = _alignments(batch.column(g_at), batch.column(p_at), length_matched, asked)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *(made[n] for n in wanted)], [*keep, *wanted]).filter(pa.array(readable))

    out = sent.mapInArrow(run, T.StructType([*sent.schema.fields[:n_kept], *added]))
    return out.where("not _read or _n_gl = _n_pl") if length_matched else out


def per_sample(rows: DataFrame, gt: str = "gt_text", pred: str = "pred_text", inference_only: bool = False, length_matched: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``rows`` (their columns ``keep``, all by default) with the errors of each sample; what is undefined is null. Rows whose reference can't be read go; those whose
    prediction can't be read have an error rate of 1 and nothing else. With ``length_matched`` rows whose lyrics differ in
    length go, and words face each other by place."""
    keep = rows.columns if keep is None else keep
    cer = F.when(~F.col("_read"), F.lit(1.0)).when(F.col("_n_gl") == 0, F.when(F.col("_n_pl") == 0, 0.0).otherwise(1.0)).otherwise(F.col("_errors") / F.col("_n_gl"))
    found = {
        "cer": cer,
        "pitch_mae": F.col("_pitch_gap"),
        "note_mae": F.col("_note_gap"),
        "dur_mae": F.col("_dur_gap"),
        "bpm_mae": F.col("_bpm_gap").cast("double"),
        "n_gt_words": F.col("_n_gw"),
        "n_pred_words": F.col("_n_pw"),
        "n_aligned_pairs": F.col("_n_pairs"),
    }
    if inference_only:
        found |= {"pitch_error_rate": F.col("_pitch_wrong"), "note_num_mean_error": F.col("_count_gap")}
    return aligned(rows, gt, pred, keep, length_matched).select(*keep, *[c.alias(n) for n, c in found.items()])


def over_all(samples: DataFrame, by: list[str] | None = None, inference_only: bool = False) -> DataFrame:
    """Means of the samples' means and counts; nothing for no samples."""
    names = [n for n, extra in MEANS if inference_only or not extra]
    out = samples.groupBy(*(by or [])).agg(
        *[F.avg(F.nanvl(F.col(n), F.lit(None).cast("double"))).alias(n) for n in names],
        F.count(F.lit(1)).cast("double").alias("n_samples"), F.count(F.lit(1)).alias("n_total_samples"), F.count_if(F.col("n_pred_words") > 0).alias("n_parseable"),
    )
    return out.where("n_total_samples > 0")
