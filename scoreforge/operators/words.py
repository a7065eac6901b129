"""Entries to words, and tied notes to one. Inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreforge.functions.expr import joined, let
from scoreforge.functions.vocab import CONTINUED, nearest_note, note_beats

from .annotate import without_silence


def _runs(values: Column, begins) -> Column:
    """array<struct<a, n>> of the runs whose first places are those where ``begins(i)``."""
    places = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    def spans(heads):
        ends = joined(F.slice(heads, F.lit(2), F.greatest(F.size(heads) - 1, F.lit(0))), F.array(F.size(values)))
        return F.zip_with(heads, F.when(F.size(heads) > 0, ends).otherwise(heads), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))

    return let(F.filter(places, lambda i: (i == 0) | begins(i)), spans)


def words(entries: Column) -> Column:
    """array<struct<char, pairs>>: entries that continue a word join the one before; a continuation at the start is a word."""

    def of(es):
        one = lambda r: F.struct(
            F.get(es, r["a"])["word"].alias("char"),
            F.transform(F.slice(es, r["a"] + 1, r["n"]), lambda e: F.struct(e["pitch"].alias("pitch"), e["note"].alias("note"))).alias("pairs"),
        )
        return F.transform(_runs(es, lambda i: F.get(es, i)["word"] != CONTINUED), one)

    return let(entries, of)


def chars(entries: Column) -> Column:
    """array<string>: what ``words`` gives as its words' characters, without their notes."""
    return F.transform(F.filter(entries, lambda e, i: (i == 0) | (e["word"] != CONTINUED)), lambda e: e["word"])


def merged(pairs: Column) -> Column:
    """Neighbouring pairs of one pitch as one, of the note nearest to their beats; single pairs keep their note."""

    def one(own):
        beats = F.aggregate(own, F.lit(0.0), lambda s, p: s + note_beats(p["note"]))
        return F.struct(own[0]["pitch"].alias("pitch"), F.when(F.size(own) == 1, own[0]["note"]).otherwise(let(beats, nearest_note)).alias("note"))

    def of(ps):
        runs = _runs(ps, lambda i: F.get(ps, i)["pitch"] != F.get(ps, i - 1)["pitch"])
        return F.transform(F.transform(runs, lambda r: F.slice(ps, r["a"] + 1, r["n"])), one)

    return F.when(F.size(pairs) < 2, pairs).otherwise(let(pairs, of))


def sung(ws: Column) -> Column:
    """Words but silences."""
    return without_silence(ws)
