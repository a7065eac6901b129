"""Error-tolerant parsing of score text, inside the row: no shuffle and no Python.

The tokens are joined by a mark and cut at every valid pitch token. Of the piece before a pitch the last lyric is its
word; of the piece behind it the first known note token is its note. The last valid tempo holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreforge.functions.expr import let
from scoreforge.functions.vocab import CONTINUED, DEFAULT_BPM, DEFAULT_NOTE

from .encode import SEPARATOR

# Tokens that are no lyrics, and a token (white space as Python has it).
SKIPPED = ("<asr_text>", "language", "Chinese", "English", "Japanese", "Korean")
SPACES = "\\s\\x1c-\\x1f\\x85\\p{Z}"
TOKEN = f"<[^>]+>|[^{SPACES}<>]+"
#: A noncharacter around each token.
MARK = "﷐"
NOTE = f"{MARK}(<NOTE_(?:DOT_)?(?:1|2|4|8|16|32)>){MARK}"


def score_part(text: Column) -> Column:
    """What stands behind the last separator, or all."""
    return F.substring_index(text, SEPARATOR, -1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(score_part(text), F.lit(TOKEN), F.lit(0))


def _joined(text: Column) -> Column:
    return F.concat(F.lit(MARK), F.array_join(tokens(F.translate(text, MARK, "�")), MARK + MARK), F.lit(MARK))


def _entries(joined: Column) -> Column:
    def word(piece):
        found = F.filter(F.split(piece, MARK), lambda t: (t != "") & ~t.contains("<") & ~t.contains(">") & ~t.isin(*SKIPPED))
        return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(CONTINUED))

    def one(before, piece):
        note = F.regexp_extract(piece, NOTE, 1)
        return F.struct(word(before).alias("word"), F.regexp_extract(piece, "^([0-9]+)>", 1).try_cast("int").alias("pitch"), F.when(note == "", F.lit(DEFAULT_NOTE)).otherwise(note).alias("note"))

    def paired(pieces):
        n = F.size(pieces) - 1
        return F.zip_with(F.slice(pieces, F.lit(1), n), F.slice(pieces, F.lit(2), n), one)

    return let(F.split(joined, f"{MARK}<P_(?=[0-9]+>{MARK})"), paired)


def _bpm(joined: Column) -> Column:
    found = F.regexp_extract(joined, f"(?s).*{MARK}<BPM_([0-9]+)>{MARK}", 1)
    return F.coalesce(found.try_cast("int"), F.lit(DEFAULT_BPM))


def entries(text: Column) -> Column:
    """array<struct<word, pitch, note>>: null for a null text, empty if nothing can be read."""
    return let(_joined(text), _entries)


def bpm(text: Column) -> Column:
    """The last valid tempo, 120 if there is none."""
    return _bpm(_joined(text))


def parse(text: Column) -> Column:
    """struct<bpm, entries>, or null where nothing can be read."""
    both = let(_joined(text), lambda j: F.struct(_bpm(j).alias("bpm"), _entries(j).alias("entries")))
    return let(both, lambda s: F.when(F.size(s["entries"]) > 0, s))
