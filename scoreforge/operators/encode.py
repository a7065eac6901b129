"""Scores as text: lyric, pitch, note-value and tempo tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreforge.functions import template
from scoreforge.functions.expr import joined
from scoreforge.functions.vocab import bpm_token, note_token, pitch_token

from .annotate import lyrics

# Fixed values of the target format.
SEPARATOR, OPENING = "<|file_sep|>", "language Chinese<asr_text>"


def text(sylls: Column, bpm: Column, bpm_position: str = "last") -> Column:
    """Each word's character once, then pitch and note of each of its notes; the tempo at the end, at the start
    (``first``), or, for any other position, nowhere. Pitches and notes that are no tokens are left out."""

    def one(s):
        n = F.least(F.size(s["pitch"]), F.size(s["note"]))
        pairs = F.arrays_zip(F.slice(s["pitch"], F.lit(1), n).alias("pitch"), F.slice(s["note"], F.lit(1), n).alias("note"))
        played = F.flatten(F.transform(pairs, lambda p: F.array(pitch_token(p["pitch"]), note_token(p["note"]))))
        single = F.array(s["char"], pitch_token(F.get(s["pitch"], F.lit(0))), note_token(F.get(s["note"], F.lit(0))))  # most words: no lists to cut
        return F.when((F.size(s["pitch"]) == 1) & (F.size(s["note"]) == 1), single).when(n > 0, joined(F.array(s["char"]), played)).otherwise(F.array().cast("array<string>"))

    body = F.flatten(F.transform(sylls, one))
    tempo = F.array(bpm_token(bpm))
    parts = {"last": joined(body, tempo), "first": joined(tempo, body)}.get(bpm_position, body)
    return F.array_join(parts, " ")


def target(score: Column, lyric: Column | None = None) -> Column:
    """What a model is to write: with ``lyric``, the lyrics first and the score behind a separator."""
    return F.concat(F.lit(OPENING), score) if lyric is None else F.concat(F.lit(OPENING), lyric, F.lit(SEPARATOR), score)


def cot_target(sylls: Column, bpm: Column, bpm_position: str = "last") -> Column:
    return target(text(sylls, bpm, bpm_position), lyrics(sylls))


def prompt(prefix: Column, lyric: Column | None = None) -> Column:
    """A chat template's prefix; with lyrics given, they and the separator already stand behind it."""
    return prefix if lyric is None else F.concat(prefix, F.lit(OPENING), lyric, F.lit(SEPARATOR))


def chat_prefix(render: Callable[[list[dict]], str]) -> str:
    """The prefix that a chat template (an adapter that renders messages) gives a sample: an empty system message and one audio."""
    return render([{"role": "system", "content": ""}, {"role": "user", "content": [{"type": "audio", "audio": None}]}])


def template_prefix(source: str, audio: str) -> Column:
    """The same as an expression of a template's source, rendered natively: ``audio`` stands for the user's sound."""
    kind = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), F.lit(content).alias("content"))
    return template.rendered(source, F.array(message("system", ""), message("user", audio)), kind, True)
