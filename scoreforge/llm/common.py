"""What the operators of this subpackage share: tables, shared folders and flat numpy helpers."""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreforge.session import discard, ship
from scoreforge.session import scratch as new_folder

__all__ = ["new_folder", "ship"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (the folder may be in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written below the shared folder and read again as Parquet: lineage is cut, a lost executor costs no recompute."""
    path = new_folder(df.sparkSession, "step")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what ``checkpointed`` wrote for ``df``: only once nothing that may still run reads it."""
    discard(df._step)


def text_key(text: Column) -> Column:
    """The md5 of a text's bytes (null: empty): with the id it names a row, whatever other rows share the id."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact position, whatever further columns there are."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but doc_id and text renamed, so that none clashes with an operator's own; and its names."""
    return docs.toDF(*[n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(docs.columns)]), docs.columns


def together(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns that ``apart`` renamed, under their names again and in their order."""
    return rows.select(*[n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(names)]).toDF(*names)


# ---------------------------------------------------------------- numpy


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column without nulls (null counts as empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.large_string()), "")


def utf8_flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an array one after another, and the n+1 offsets."""
    col = pa.concat_arrays([col])
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def utf32_flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the n+1 offsets."""
    raw, _ = utf8_flat(col)
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    lens = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    return cps, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


def chunks(col: pa.Array, most: int = 3_000_000):
    """(first, last) row ranges of at most ``most`` bytes, or one row; every row is in one range."""
    lens = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    at, room = 0, 0
    for i, n in enumerate(lens):
        if i > at and room + n > most:
            yield at, i
            at, room = i, 0
        room += int(n)
    if at < len(lens):
        yield at, len(lens)


def gather(src: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The segments ``src[starts[i] : starts[i] + lens[i]]`` one after another."""
    total = int(lens.sum())
    if not total:
        return src[:0]
    ends = np.cumsum(lens)
    idx = np.arange(total, dtype=np.int64)
    idx += np.repeat(starts - (ends - lens), lens)
    return src[idx]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The low bytes of a word that belong to a segment with so many bytes left.
_OWN = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words of eight bytes that are hashed side by side; longer segments are hashed one by one.
_WIDE = 32
_LOW = np.uint64(0xFFFFFFFF)
#: What hashes that do not leave this process are made with.
OWN_SECRET = os.urandom(32)


@lru_cache(maxsize=64)
def _keys(secret: bytes, what: str, n: int) -> np.ndarray:
    """n by four passes by two numbers of 32 bits that nobody knows who does not know the secret."""
    data = hashlib.shake_256(what.encode() + b":" + secret).digest(n * 32)
    return np.frombuffer(data, "<u4").reshape(n, 4, 2)


def _passes(words: np.ndarray, keys: np.ndarray):
    """Of each word of 64 bits, pass by pass, the product of its halves, each with a secret number added modulo 2**32."""
    low, high = (words & _LOW).astype(np.uint32), (words >> np.uint64(32)).astype(np.uint32)
    for x, y in keys:
        yield np.multiply(low + x, high + y, dtype=np.uint64)


def _folded(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one + np.uint64(0x9E3779B97F4A7C15) * mix(two))


def segment_digests(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, secret: bytes = OWN_SECRET, halves: int = 2) -> list[np.ndarray]:
    """128 bits of each segment of symbols, as two hashes of 64 (or as many ``halves`` as are asked for).

    Each is made of two sums, over the length and the words of eight bytes, of products of secret numbers and the words' halves:
    two different segments agree in a sum for at most one secret in 2**32, whatever the segments are, so nobody can make two
    segments that agree without the secret. Long segments take BLAKE2 with the secret as its key.
    """
    size = flat.itemsize
    raw = np.concatenate([np.ascontiguousarray(flat).view(np.uint8), np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(raw) - 7,), (1,))  # at every byte
    at, left = starts.astype(np.int64) * size, (ends - starts).astype(np.int64) * size
    keys = _keys(secret, "segment", _WIDE + 1)[:, : 2 * halves]
    sums = list(_passes(left.astype(np.uint64), keys[_WIDE]))
    live, i = None, 0  # all, the first time
    while live is None or len(live):
        own, at_, left_ = (slice(None), at, left) if live is None else (live, at_, left_)
        for total, more in zip(sums, _passes(word[at_] & _OWN[np.minimum(left_, 8)], keys[i])):
            total[own] += more
        on = np.flatnonzero((left_ > 8) & (left_ <= 8 * _WIDE) if live is None else left_ > 8)
        live, at_, left_, i = on if live is None else live[on], at_[on] + 8, left_[on] - 8, i + 1
    out = [_folded(*sums[2 * h : 2 * h + 2]) for h in range(halves)]
    for i in np.flatnonzero(left > 8 * _WIDE).tolist():
        whole = np.frombuffer(hashlib.blake2b(raw[at[i] : at[i] + left[i]], digest_size=16, key=secret).digest(), "<u8")
        for h in range(halves):
            out[h][i] = whole[h]
    return out


def segment_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each segment, the same in every process: for bins, where nothing depends on two segments being apart."""
    return segment_digests(flat, starts, ends, b"no secret", halves=1)[0]


def combined(parts: list[np.ndarray], secret: bytes, salt: str = "run") -> np.ndarray:
    """64 bits of each row of some hashes (0: none), in their order, made like those of segments."""
    keys = _keys(secret, salt, len(parts))
    sums = [np.zeros(len(parts[0]), np.uint64), np.zeros(len(parts[0]), np.uint64)]
    for words, own in zip(parts, keys):
        for total, more in zip(sums, _passes(words, own[:2])):
            total += more
    return _folded(*sums)


def distinct(keys: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """The distinct of some 128-bit keys, a place of each, and which of them each key is."""
    one, two = keys
    order = np.argsort(one)
    if len(one) and (two[order][1:] != two[order][:-1])[one[order][1:] == one[order][:-1]].any():  # equal in 64 bits only
        order = np.lexsort((two, one))
    new = np.ones(len(one), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    inv = np.empty(len(one), np.int64)
    inv[order] = np.cumsum(new) - 1
    first = order[new]
    return (one[first], two[first]), first, inv


class SegmentTable:
    """Distinct segments seen so far by a worker, by 128-bit keys, with what was made of each; emptied when over ``most`` entries.

    ``find`` gives row numbers for keys; the caller adds what is missing with ``add``. Only a cache: a key that shares only its
    first half with an entry counts as missing, and a text can't be made to share both with another, as the process draws its
    own secret for them; so what it returns does not depend on what is in it, but for a chance of 2**-128 a pair of segments.
    """

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.n = 0

    def find(self, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Row, or -1, of each key."""
        one, two = keys
        if not len(self.keys):
            return np.full(len(one), -1, np.int64)
        at = np.searchsorted(self.keys, one)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == one) & (self.check[at] == two), self.rows[at], -1)

    def add(self, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Gives new (distinct, unknown) keys the next rows."""
        rows = np.arange(self.n, self.n + len(keys[0]), dtype=np.int64)
        self.n += len(rows)
        one, two, all_rows = (np.concatenate(x) for x in ((self.keys, keys[0]), (self.check, keys[1]), (self.rows, rows)))
        order = np.argsort(one, kind="stable")
        self.keys, self.check, self.rows = one[order], two[order], all_rows[order]
        return rows


class Ragged:
    """Rows of a flat array, growing at the end."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, flat: np.ndarray, lens: np.ndarray) -> None:
        need = self.used + len(flat)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(need, self.used // 2), self.dtype)])
        self.flat[self.used : need] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.used = need
