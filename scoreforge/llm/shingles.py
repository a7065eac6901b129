"""Sets of word shingles as 64-bit hashes, for a whole chunk of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import common as C

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(col: pa.Array, k: int, secret: bytes, further: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text's runs of ``k`` words (of all its words, if fewer), ascending, one text after another,
    their number per text, and the least of 64 ``further`` bits of each run (0: no words, or not asked for). Words are what
    blanks part, A-Z in lower case; a text without words has none. Two runs that differ can't be made to agree without the secret."""
    raw, offs = C.utf8_flat(col)
    raw = LOWER[raw]
    blank = _SPACE[raw]
    n = len(offs) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    start = ~blank
    start[1:] &= blank[:-1]
    heads = offs[:-1][np.diff(offs) > 0]
    start[heads] = ~blank[heads]
    starts = np.flatnonzero(start)
    stop = blank.copy()
    ends = np.flatnonzero(stop)
    ends = np.sort(np.concatenate([ends, offs[1:]]))
    words = C.segment_digests(raw, starts, ends[np.searchsorted(ends, starts, side="right")], secret, 1 + further)
    first = np.searchsorted(starts, offs)
    count = np.diff(first)
    runs = np.where(count >= k, count - k + 1, np.where(count > 0, 1, 0))
    at = C.gather(np.arange(len(starts)), first[:-1], runs)
    width = np.repeat(np.minimum(count, k), runs)
    short = count.min(initial=k) < k

    def run(of: np.ndarray, salt: str) -> np.ndarray:
        of = np.concatenate([of, np.zeros(k, np.uint64)])
        return C.combined([np.where(i < width, of[at + i], 0) if short else of[at + i] for i in range(k)], secret, salt)

    h, least, some = run(words[0], "run"), np.zeros(n, np.uint64), np.flatnonzero(runs)
    if further and len(some):
        least[some] = np.minimum.reduceat(run(words[1], "further"), (np.cumsum(runs) - runs)[some])
    owner = np.repeat(np.arange(n), runs)
    cuts = np.concatenate([[0], np.cumsum(runs)]).tolist()
    for a, b in zip(cuts, cuts[1:]):  # text by text: much faster than all of them by text and hash
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.bincount(owner[keep], minlength=n).astype(np.int64), least
