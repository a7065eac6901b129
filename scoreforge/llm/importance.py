"""Importance resampling towards a target distribution (operator 11): a dictionary of distinct n-grams, and their buckets' gains.

1. Each task finds the distinct n-grams (1 to 3 words) of its texts, with their counts: words are numbered by an exact dictionary
   of the chunk, n-grams are sorted numbers. They are dealt by their first two words, as words and counts packed together,
   so that a frequent word's n-grams spread over all tasks, and are counted over all texts.
2. Each distinct n-gram is hashed once, its count is added to its bucket; the buckets of the corpus and of the target texts give
   a gain for each bucket (``BUCKETS`` numbers, the only thing broadcast).
3. Each text's feature counts are joined with the gains, again over distinct n-grams: those of a chunk. To ask the dictionary
   itself, every n-gram of every text would have to travel to it, several times the input; the checksum of an n-gram is
   made from those of its words, so a second one costs less than its journey.
4. Rows are numbered by score over ranges of the order; the first share of them is drawn.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreforge.operators.numbering import numbered
from scoreforge.session import size_of

from . import common as C
from .shingles import LOWER

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 42, 20, 5
#: Bytes of text that are taken apart together, unless one text is longer.
CHUNK = 2_000_000
#: Parts that n-grams are dealt to: as many as the session shuffles to, more where one were of over ``PART_BYTES`` of input, up to
#: ``MOST_PARTS``; of a part larger still, ``HELD`` bytes are counted at a time.
PART_BYTES, MOST_PARTS, HELD = 4 << 20, 4096, 64 << 20
#: Buckets whose sums travel in one row; divides ``BUCKETS``.
SLICE = 500
BLANK = 32
HEAD = struct.Struct("<3Q")

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# ---------------------------------------------------------------- checksums of n-grams


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)  # fixed value: the polynomial of crc32
    return table


TABLE = _table()
#: Words of more bytes are hashed one by one.
LONG = 40


def _advances(most: int) -> np.ndarray:
    """What ``n`` further bytes do to a checksum, for n up to ``most``: four tables by byte of the checksum."""
    out = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])]
    for _ in range(most):
        out.append((out[-1] >> np.uint32(8)) ^ TABLE[out[-1] & np.uint32(255)])
    return np.stack(out)


ADVANCE = _advances(LONG + 1)


class Vocabulary:
    """Distinct words (each with a blank behind it) and their checksums, with the blank and without."""

    def __init__(self, words: pa.Array):
        self.flat, offs = C.utf8_flat(words)
        self.at, self.size = offs[:-1], np.diff(offs) - 1
        state = np.full(len(words), 0xFFFFFFFF, np.uint32)
        live, i = np.flatnonzero(self.size > 0), 0
        while len(live) and i < LONG:
            state[live] = self._step(state[live], self.flat[self.at[live] + i])
            i += 1
            live = live[self.size[live] > i]
        self.crc = ~state
        for i in live.tolist():
            self.crc[i] = zlib.crc32(self._bytes(i))
        self.blanked = ~self._step(~self.crc, np.uint32(BLANK))

    @staticmethod
    def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return (state >> np.uint32(8)) ^ TABLE[(state ^ byte) & np.uint32(255)]

    def _bytes(self, i: int, blank: int = 0) -> bytes:
        return self.flat[self.at[i] : self.at[i] + self.size[i] + blank].tobytes()

    def _joined(self, left: np.ndarray, no: np.ndarray, blank: int) -> np.ndarray:
        """The crc32 of strings, of which ``left`` are the checksums, each with the word ``no`` (and a blank) behind it."""
        n = np.minimum(self.size[no], LONG) + blank
        out = (self.blanked if blank else self.crc)[no]
        for j in range(4):
            out = out ^ ADVANCE[n, j, (left >> np.uint32(8 * j)) & np.uint32(255)]
        for i in np.flatnonzero(self.size[no] > LONG).tolist():
            out[i] = zlib.crc32(self._bytes(no[i], blank), int(left[i]))
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._joined(self.blanked[a], b, 0)

    def triples(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self._joined(self._joined(self.blanked[a], b, 1), c, 0)


# ---------------------------------------------------------------- n-grams of a chunk


def _listed(flat: np.ndarray) -> pa.Array:
    """The words of bytes in which each word has one blank behind it (kept with the word)."""
    at = np.concatenate([[0], np.flatnonzero(flat == BLANK) + 1]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))])


class Grams:
    """The distinct runs of one to three words of a chunk of texts."""

    def __init__(self, col: pa.Array):
        raw, offs = C.utf8_flat(col)
        n = len(offs) - 1
        wide = np.insert(LOWER[raw], offs[1:], BLANK)  # a blank behind each text
        inside = _IN_WORD[wide]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        words = _listed(np.where(inside, wide, BLANK).astype(np.uint8)[keep])
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        before = np.concatenate([np.zeros(1, np.int32), np.cumsum(start, dtype=np.int32)])
        self.words = (before[offs[1:] + np.arange(1, n + 1)] - before[offs[:-1] + np.arange(n)]).astype(np.int64)  # of each text
        coded = words.dictionary_encode()
        self.known = coded.dictionary
        a = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = np.repeat(np.arange(n), self.words)
        left = np.repeat(np.cumsum(self.words), self.words) - np.arange(len(a))  # words from here to the text's end
        some = len(self.known) + 1
        b, c = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)  # 0: the text has ended
        b[:-1] = np.where(left[:-1] > 1, a[1:] + 1, 0)
        c[:-2] = np.where(left[:-2] > 2, a[2:] + 1, 0)
        self.order = np.argsort((a * some + b) * some + c) if some < 1 << 21 else np.lexsort((c, b, a))
        self.a, self.b, self.c = a[self.order], b[self.order], c[self.order]
        fresh = np.ones((3, len(a)), bool)
        fresh[0, 1:] = self.a[1:] != self.a[:-1]
        fresh[1, 1:] = fresh[0, 1:] | (self.b[1:] != self.b[:-1])
        fresh[2, 1:] = fresh[1, 1:] | (self.c[1:] != self.c[:-1])
        self.at = [np.flatnonzero(f) for f in fresh]  # where each distinct word, pair, triple begins
        self.n = [np.diff(np.append(x, len(a))) for x in self.at]

    def gains(self, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of features and sum of their gains for each text; a gain is looked up once for each distinct n-gram."""
        known = Vocabulary(self.known)
        owner = self.owner[self.order]
        one, two, three = self.at
        a2, b2, a3, b3, c3 = self.a[two], self.b[two], self.a[three], self.b[three], self.c[three]
        real2, real3 = b2 > 0, c3 > 0
        found = [gain[known.crc[self.a[one]] % BUCKETS], np.zeros(len(two), np.int64), np.zeros(len(three), np.int64)]
        found[1][real2] = gain[known.pairs(a2[real2], b2[real2] - 1) % BUCKETS]
        found[2][real3] = gain[known.triples(a3[real3], b3[real3] - 1, c3[real3] - 1) % BUCKETS]
        many = len(self.words)
        weight = np.zeros(many, np.int64)
        for value, n in zip(found, self.n):
            weight += np.bincount(owner, weights=np.repeat(value, n), minlength=many).astype(np.int64)  # below 2**53: exact
        w = self.words
        return w + np.maximum(w - 1, 0) + np.maximum(w - 2, 0), weight

    def parted(self, parts: int):
        """(part, packed words and counts, their size unpacked) of the distinct n-grams; what part an n-gram is in only depends on its words."""
        crc = Vocabulary(self.known).crc.astype(np.uint64)
        one, two, three = self.at
        own = self.a[one]
        part1 = (C.mix(crc[own]) % np.uint64(parts)).astype(np.int64)
        real = self.b[two] > 0
        pair_of = np.repeat(np.arange(len(two)), np.diff(np.append(np.searchsorted(three, two), len(three))))  # of each triple
        a, b, n2 = self.a[two], self.b[two] - 1, self.n[1]
        part2 = np.where(real, (C.mix(C.mix(crc[a]) + crc[b]) % np.uint64(parts)).astype(np.int64), -1)
        ends = self.c[three] > 0
        pair3, c, n3 = pair_of[ends], self.c[three][ends] - 1, self.n[2][ends]
        tails = np.bincount(pair3, minlength=len(two))
        by1, by2, by3 = (np.argsort(x, kind="stable") for x in (part1, part2, part2[pair3]))
        cuts = [np.searchsorted(p[by], np.arange(parts + 1)) for p, by in ((part1, by1), (part2, by2), (part2[pair3], by3))]
        for part in range(parts):
            u, p, t = (by[cut[part] : cut[part + 1]] for by, cut in zip((by1, by2, by3), cuts))
            if len(u) or len(p):
                words = np.concatenate([own[u], np.stack([a[p], b[p]], axis=1).ravel(), c[t]])
                text = self.known.take(pa.array(words))
                counts = np.concatenate([self.n[0][u], n2[p], tails[p], n3[t]]).astype("<u4")
                data = HEAD.pack(len(u), len(p), len(t)) + counts.tobytes() + C.utf8_flat(text)[0].tobytes()
                yield part, pa.compress(data, "zstd", asbytes=True), len(data)


# ---------------------------------------------------------------- counts over all texts


def _deal(parts: int):
    def run(batches):
        for batch in batches:
            col = C.texts_of(batch)
            for a, b in C.chunks(col, CHUNK):
                found = list(Grams(col.slice(a, b - a)).parted(parts))
                part, packed, size = zip(*found) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(packed, pa.binary()), pa.array(size, pa.int64())], ["part", "packed", "size"])

    return run


def _unpacked(packed: bytes, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    data = pa.decompress(packed, size, "zstd", asbytes=True)
    u, p, t = HEAD.unpack_from(data)
    counts = np.frombuffer(data, "<u4", u + 2 * p + t, HEAD.size).astype(np.int64)
    return np.split(counts, np.cumsum([u, p, p])), np.frombuffer(data, np.uint8, offset=HEAD.size + 4 * len(counts))


def _settle(blobs: list[tuple[bytes, int]], sums: np.ndarray) -> None:
    """Adds the counts of a part's n-grams to their buckets; each distinct one is hashed once."""
    counts, flats = zip(*(_unpacked(*b) for b in blobs))
    coded = _listed(np.concatenate(flats)).dictionary_encode()
    known, codes = Vocabulary(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
    del flats
    sizes = np.array([[len(x) for x in c] for c in counts])  # words, pairs, pairs, triples of each blob
    cut = np.cumsum(np.stack([sizes[:, 0], 2 * sizes[:, 1], sizes[:, 3]], axis=1).ravel())
    pieces = np.split(codes, cut[:-1])
    own, pair, c = (np.concatenate(pieces[i::3]) for i in range(3))
    del codes, coded, pieces
    n1, n2, tails, n3 = (np.concatenate([x[i] for x in counts]) for i in range(4))
    a, b = pair[::2], pair[1::2]
    some = max(len(known.crc), 1)

    def add(crc: np.ndarray, n: np.ndarray) -> None:
        sums[:] += np.bincount(crc % BUCKETS, weights=n, minlength=BUCKETS).astype(np.int64)  # below 2**53: exact

    words, which = np.unique(own, return_inverse=True)
    add(known.crc[words], np.bincount(which, weights=n1, minlength=len(words)).astype(np.int64))
    pairs, which = np.unique(a.astype(np.int64) * some + b, return_inverse=True)
    add(known.pairs(pairs // some, pairs % some), np.bincount(which, weights=n2, minlength=len(pairs)).astype(np.int64))
    triples, which = np.unique(np.repeat(which, tails) * some + c, return_inverse=True)
    a, b = pairs[triples // some] // some, pairs[triples // some] % some
    add(known.triples(a, b, triples % some), np.bincount(which, weights=n3, minlength=len(triples)).astype(np.int64))


def _count(batches):
    """Rows in order of part: a part's n-grams are in memory together, or ``HELD`` bytes of them (then one may be hashed again)."""
    sums, part, held, room = np.zeros(BUCKETS, np.int64), None, [], HELD
    for batch in batches:
        for no, packed, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and (no != part or size > room):
                _settle(held, sums)
                held, room = [], HELD
            part, room = no, room - size
            held.append((packed, size))
    if held:
        _settle(held, sums)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["bucket", "n"])


def _count_sliced(batches):
    """What ``_count`` gives, ``SLICE`` buckets a row: as many rows a task whatever was counted."""
    for found in _count(batches):
        sums = np.zeros(BUCKETS, "<i8")
        sums[found.column(0)] = found.column(1)
        at = np.arange(0, BUCKETS, SLICE, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([sums[x : x + SLICE].tobytes() for x in at], pa.binary())], ["bucket", "n"])


def _add(batches):
    """The sum of the rows of each slice."""
    found = {}
    for batch in batches:
        for at, n in zip(*(batch.column(i).to_pylist() for i in range(2))):
            found[at] = found.get(at, 0) + np.frombuffer(n, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of ``texts`` (text) fall into each bucket."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, min(MOST_PARTS, (size_of(texts) or 0) // PART_BYTES))
    dealt = texts.select(F.col("`text`").alias("text")).mapInArrow(_deal(parts), "part int, packed binary, size long")
    found = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_count_sliced, "bucket int, n binary")
    out = np.zeros(BUCKETS, np.int64)
    for r in found.repartition(BUCKETS // SLICE, "bucket").mapInArrow(_add, "bucket int, n binary").collect():  # BUCKETS numbers
        out[r["bucket"] : r["bucket"] + SLICE] += np.frombuffer(r["n"], "<i8")
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target share / own share)) of each bucket, each count and the number of buckets one larger for safety."""
    s, t = float(own.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * s / ((float(x) + 1) * t))) for x, y in zip(own.tolist(), target.tolist())], np.int64)


# ---------------------------------------------------------------- scores and draws


def _weights(gain):
    def run(batches):
        for batch in batches:
            col = C.texts_of(batch)
            for a, b in C.chunks(col, CHUNK):
                made = Grams(col.slice(a, b - a))
                n, weight = made.gains(gain.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(weight), pa.array(made.words)], ["doc_id", "n_features", "weight", "n_words"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, drawn by the id (null: as if it were empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scored(documents: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, n_words of each row of ``documents`` (doc_id, text), measured against ``target`` (text)."""
    gain = documents.sparkSession.sparkContext.broadcast(gains(bucket_counts(documents), bucket_counts(target)))
    rows = documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    rows = rows.mapInArrow(_weights(gain), "doc_id long, n_features long, weight long, n_words long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of ``documents``: of the rows with at least ``least_words`` words the
    ``percent`` of highest score are drawn, ranked from 1 (ties to smaller ids, null ids last); the others' rank is null.

    Null, empty and wordless texts have no features and weight 0. Rows that repeat an id are rows of their own: equal ones have
    equal scores and take ranks one after another. An empty target makes a gain of the corpus alone; an empty table gives no
    rows. Further columns are ignored.
    """
    rows = C.checkpointed(scored(documents, target, seed))
    able = F.col("n_words") >= least_words
    quota = percent * rows.where(able).count() // 100
    order = [F.when(able, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_row")]
    out = numbered(rows.withColumn("_row", F.monotonically_increasing_id()), order, "_no")
    return out.select("doc_id", "n_features", "weight", "score", F.when(able & (F.col("_no") < quota), F.col("_no") + 1).alias("rank"))


def brute(rows: list[tuple[int | None, str | None]], target: list[str | None], percent: int = PERCENT, least_words: int = LEAST_WORDS) -> list[tuple]:
    """The same text by text: for tests."""
    import hashlib
    import re

    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % BUCKETS for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    made = [features(t) for _, t in rows]
    sums = [np.bincount([x for _, f in some for x in f], minlength=BUCKETS).astype(np.int64) for some in (made, [features(t) for t in target])]
    gain = gains(*sums)
    out = []
    for (doc, _), (n, f) in zip(rows, made):
        h = int(hashlib.sha256(f"{SEED}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = int(sum(gain[x] for x in f))
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]
