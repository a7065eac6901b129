"""Annotations: parallel arrays to syllables, syllables to notes. Everything stays inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreforge.functions.expr import let
from scoreforge.functions.vocab import DEFAULT_NOTE, SILENCES


def syllables(word: Column, pitch: Column, note: Column, pitch2word: Column) -> Column:
    """array<struct<char, pitch array, note array>>: each word with the pitches that point at it, in their order; words that
    none points at go. A place beyond ``pitch`` has pitch 0, one beyond ``note`` a quarter; a null in range stays null."""
    note_at = lambda k: F.when(k < F.size(note), F.get(note, k)).otherwise(F.lit(DEFAULT_NOTE))

    def places(known):
        pitch_at = lambda k: F.when(k < F.size(known), F.get(known, k)).otherwise(F.lit(0))
        return F.transform(pitch2word, lambda w, k: F.struct(w.alias("w"), pitch_at(k).alias("pitch"), note_at(k).alias("note")))

    def of(ps):
        def one(w, i):
            return let(F.filter(ps, lambda x: x["w"] == i), lambda own: F.struct(w.alias("char"), own["pitch"].alias("pitch"), own["note"].alias("note")))

        return F.transform(word, one)

    return F.filter(let(let(pitch, places), of), lambda s: F.size(s["pitch"]) > 0)


def notes_of(sylls: Column) -> Column:
    """array<struct<char, pitch, note, word_idx>>, one a note; pitches and notes are paired up to the shorter list, a word of
    no pitch has no note but keeps its number."""

    def one(s, i):
        n = F.least(F.size(s["pitch"]), F.size(s["note"]))
        pairs = F.arrays_zip(F.slice(s["pitch"], F.lit(1), n).alias("pitch"), F.slice(s["note"], F.lit(1), n).alias("note"))
        return F.transform(pairs, lambda p: F.struct(s["char"].alias("char"), p["pitch"].alias("pitch"), p["note"].alias("note"), i.alias("word_idx")))

    return F.flatten(F.transform(sylls, one))


def expand(samples: DataFrame, sylls: str = "syllables") -> DataFrame:
    """A row a note: the other columns, note_idx, word_idx, char, pitch, note."""
    others = [c for c in samples.columns if c != sylls]
    return samples.select(*others, F.posexplode(notes_of(F.col(sylls))).alias("note_idx", "_n")).select(*others, "note_idx", "_n.word_idx", "_n.char", "_n.pitch", "_n.note")


def without_silence(sylls: Column, field: str = "char") -> Column:
    """Syllables (or words) but the silence marks."""
    return F.filter(sylls, lambda s: ~F.coalesce(s[field].isin(*SILENCES), F.lit(False)))


def lyrics(sylls: Column) -> Column:
    """The lyrics as one string, without silence marks."""
    return F.array_join(F.transform(without_silence(sylls), lambda s: s["char"]), "")
