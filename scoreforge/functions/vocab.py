"""Pitch, note-value and tempo tokens, and beats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Beats of each note value, a quarter being one, ascending.
NOTE_BEATS = {
    "<NOTE_32>": 0.125,
    "<NOTE_DOT_32>": 0.1875,
    "<NOTE_16>": 0.25,
    "<NOTE_DOT_16>": 0.375,
    "<NOTE_8>": 0.5,
    "<NOTE_DOT_8>": 0.75,
    "<NOTE_4>": 1.0,
    "<NOTE_DOT_4>": 1.5,
    "<NOTE_2>": 2.0,
    "<NOTE_DOT_2>": 3.0,
    "<NOTE_1>": 4.0,
    "<NOTE_DOT_1>": 6.0,
}
# Sizes of the vocabulary and defaults.
PITCHES, TEMPOS, DEFAULT_BPM, DEFAULT_NOTE, CONTINUED = 128, 256, 120, "<NOTE_4>", "·"
SILENCES = ("AP", "SP")
LEGACY_DURATIONS = 1000


def note_beats(note: Column) -> Column:
    """Beats of a note token, 1.0 for an unknown one."""
    table = F.create_map(*[F.lit(x) for kv in NOTE_BEATS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, note), F.lit(1.0))


def nearest_note(beats: Column) -> Column:
    """The note token whose beats are nearest; of two as near, the shorter."""
    dim = F.array(*[F.struct(F.lit(b).alias("beats"), F.lit(n).alias("note")) for n, b in NOTE_BEATS.items()])
    return F.array_min(F.transform(dim, lambda d: F.struct(F.abs(d["beats"] - beats), d["beats"], d["note"].alias("note"))))["note"]


def seconds_per_beat(bpm: Column) -> Column:
    return F.lit(60.0) / F.greatest(bpm, F.lit(1))


def _numbered(kind: str, n: int, no: Column) -> Column:
    """``<kind_no>`` of an int below ``n``, else null: looked up among the tokens, as formatting a number takes many times as long."""
    return F.get(F.split(F.lit(" ".join(f"<{kind}_{i}>" for i in range(n))), " "), no)


def bpm_token(bpm: Column) -> Column:
    """``<BPM_n>``, that of 120 if out of range."""
    return F.coalesce(_numbered("BPM", TEMPOS, bpm), F.lit(f"<BPM_{DEFAULT_BPM}>"))


def pitch_token(pitch: Column) -> Column:
    """``<P_n>``, null if out of range."""
    return _numbered("P", PITCHES, pitch)


def note_token(note: Column) -> Column:
    return F.when(F.startswith(note, F.lit("<NOTE")), note)


def tokens(spark: SparkSession, legacy: bool = False) -> DataFrame:
    """kind, no, token of every added token; ``legacy`` adds the slur, mask and duration tokens of earlier models."""
    plain = [n for n in NOTE_BEATS if "DOT" not in n][::-1]
    notes = plain + [n.replace("NOTE_", "NOTE_DOT_") for n in plain]
    numbers = lambda kind, n, token: spark.range(n).select(F.lit(kind).alias("kind"), F.col("id").cast("int").alias("no"), token.alias("token"))
    out = numbers("pitch", PITCHES, F.format_string("<P_%d>", "id"))
    out = out.unionByName(spark.createDataFrame([("note", i, n) for i, n in enumerate(notes)], "kind string, no int, token string"))
    out = out.unionByName(numbers("bpm", TEMPOS, F.format_string("<BPM_%d>", "id")))
    if legacy:
        out = out.unionByName(spark.createDataFrame([("legacy", 0, "<SLUR>"), ("legacy", 1, "<SVS_MASK>")], "kind string, no int, token string"))
        out = out.unionByName(numbers("duration", LEGACY_DURATIONS, F.format_string("<dur_%.2f>", (F.col("id") + 1) / 100.0)))
    return out


def vocabulary_fits(base: int | Column, size: int | Column) -> bool | Column:
    """Whether a checkpoint's vocabulary is the base's with the added tokens, or with the legacy ones too; of numbers or columns."""
    added = PITCHES + len(NOTE_BEATS) + TEMPOS
    return (size == base + added) | (size == base + added + 2 + LEGACY_DURATIONS)
