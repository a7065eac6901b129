"""The texts of an Arrow batch read together in numpy: what ``parse`` and ``words`` tell of one text, for all of them at once.

Tokens are found from the bytes (a ``<`` with the next ``>`` of its text, and what stands between spaces outside of these), each
different token is looked at once, and the word and note of an entry are the nearest ones of their kind before and behind its pitch.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scoreforge.functions.vocab import CONTINUED, DEFAULT_BPM, DEFAULT_NOTE, NOTE_BEATS

from .encode import SEPARATOR
from .parse import MARK, SKIPPED

NOTES = {n: i for i, n in enumerate(NOTE_BEATS)}
BEATS = np.array(list(NOTE_BEATS.values()))
#: Bytes of texts that are read at once.
BYTES = 1 << 23
_SPACE = np.isin(np.arange(256), [*b"\t\n\x0b\f\r\x1c\x1d\x1e\x1f "])
_NUMBER = re.compile("<(P|BPM)_([0-9]+)>")
LYRIC, PITCH, NOTE, TEMPO, OTHER = range(5)


class Scores(NamedTuple):
    """Entries of texts one after another (``offs``: n+1 by text), their words (``at``: first entries, ``word_offs`` by text) and their notes
    with ties merged (``note_offs`` by word). A pitch of -1 is null."""

    readable: np.ndarray
    bpm: np.ndarray
    offs: np.ndarray
    chars: np.ndarray
    word_offs: np.ndarray
    note_offs: np.ndarray
    pitch: np.ndarray
    note: np.ndarray


def _kind(token: str, names: dict[str, int]) -> tuple[int, int]:
    """What a token is, and its number: of a lyric that in ``names``, of a note its place, of a pitch beyond 32 bits -1."""
    if token[:1] != "<":
        return (OTHER, 0) if token in SKIPPED else (LYRIC, names.setdefault(token.replace(MARK, "�"), len(names)))
    if token in NOTES:
        return NOTE, NOTES[token]
    found = _NUMBER.fullmatch(token)
    if not found:
        return OTHER, 0
    digits = found[2].lstrip("0") or "0"
    small = len(digits) <= 10 and int(digits) < 1 << 31
    return (PITCH, int(digits) if small else -1) if found[1] == "P" else (TEMPO, int(digits) if small else DEFAULT_BPM)


def _tokens(texts: pa.Array, names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind and number of each token, and the offsets by text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if pc.any(pc.match_substring(texts, SEPARATOR)).as_py():
        texts = pc.replace_substring_regex(texts, f"(?s)^.*{re.escape(SEPARATOR)}", "")
    if pc.any(pc.match_substring_regex(texts, r"[\x{85}\p{Z}]")).as_py():
        texts = pc.replace_substring_regex(texts, r"[\x{85}\p{Z}]", " ")
    offs = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    row_of = lambda at: np.searchsorted(offs, at, side="right") - 1
    opens, closes = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
    near, row = np.searchsorted(closes, opens), row_of(opens)
    close = np.append(closes, len(data))[near]
    first = np.ones(len(opens), bool)
    first[1:] = (near[1:] != near[:-1]) | (row[1:] != row[:-1])
    own = first & (close < offs[row + 1]) & (close - opens > 1)
    begin, end = opens[own], close[own] + 1
    turns = np.zeros(len(data) + 1, np.int8)
    turns[begin] += 1
    turns[end] -= 1
    between = _SPACE[data] | (np.cumsum(turns[:-1], dtype=np.int8) > 0)
    between[opens] = between[closes] = True
    before, behind = np.append(True, between[:-1])[: len(data)], np.append(between[1:], True)[: len(data)]
    before[offs[:-1][offs[:-1] < len(data)]] = True
    behind[offs[1:][offs[1:] > 0] - 1] = True
    begin = np.concatenate([begin, np.flatnonzero(~between & before)])
    end = np.concatenate([end, np.flatnonzero(~between & behind) + 1])
    order = np.argsort(begin)
    begin, end = begin[order], end[order]
    at = np.searchsorted(row_of(begin), np.arange(len(texts) + 1))
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), at
    cuts = np.stack([begin, end], axis=1).ravel().astype(np.int32)  # tokens, and what stands between them
    coded = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    codes = coded.indices.to_numpy()[::2]
    known = np.zeros((len(coded.dictionary), 2), np.int64)
    used = np.flatnonzero(np.bincount(codes, minlength=len(known)))
    known[used] = [_kind(t, names) for t in coded.dictionary.take(pa.array(used)).to_pylist()]
    return known[codes, 0], known[codes, 1], at


def read(texts: pa.Array, names: dict[str, int]) -> Scores:
    """Scores of texts; ``names`` numbers their words and takes up new ones."""
    lens = pc.fill_null(pc.binary_length(texts.cast(pa.string())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lens) // BYTES
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(texts)]
    found = [_tokens(texts.slice(a, b - a), names) for a, b in zip(cuts, cuts[1:])] or [_tokens(texts, names)]
    kind, value = (np.concatenate([x[i] for x in found]) for i in (0, 1))
    tokens = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in found]))])
    rows, count, place = np.arange(len(texts) + 1), len(kind), np.arange(len(kind))
    last = lambda k: np.append(np.maximum.accumulate(np.where(kind == k, place, -1)), -1)
    tempo = last(TEMPO)[tokens[1:] - 1]
    bpm = np.where(tempo >= tokens[:-1], np.append(value, 0)[tempo], DEFAULT_BPM)
    pitched = np.flatnonzero(kind == PITCH)
    row = np.searchsorted(tokens, pitched, side="right") - 1
    lyric = last(LYRIC)[pitched]
    continued = names.setdefault(CONTINUED, len(names))
    before = np.maximum(np.append(-1, pitched)[:-1], tokens[row] - 1)
    word = np.where(lyric > before, np.append(value, 0)[lyric], continued)
    follows = np.minimum.accumulate(np.where(kind == NOTE, place, count)[::-1])[::-1][pitched]
    note = np.where(follows < np.minimum(np.append(pitched, count)[1:], tokens[row + 1]), np.append(value, 0)[follows], NOTES[DEFAULT_NOTE])
    pitch, offs = value[pitched], np.searchsorted(row, rows)
    begins = word != continued
    begins[offs[:-1][np.diff(offs) > 0]] = True
    at = np.flatnonzero(begins)
    fresh = begins.copy()
    fresh[1:] |= (pitch[1:] != pitch[:-1]) & (pitch[1:] >= 0) & (pitch[:-1] >= 0)
    runs = np.flatnonzero(fresh)
    tied = np.flatnonzero(np.diff(runs, append=len(fresh)) > 1)
    merged = note[runs]
    if len(tied):
        beats = np.add.reduceat(BEATS[note], runs)[tied]
        gap, nearest = np.full(len(tied), np.inf), np.zeros(len(tied), np.int64)
        for i, b in enumerate(BEATS):  # of two as near, the shorter
            nearer = np.abs(b - beats) < gap
            gap[nearer], nearest[nearer] = np.abs(b - beats)[nearer], i
        merged[tied] = nearest
    return Scores(np.diff(offs) > 0, bpm, offs, word[at], np.searchsorted(row[at], rows), np.searchsorted(runs, np.append(at, len(fresh))), pitch[runs], merged)
