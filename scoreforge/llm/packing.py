"""Packing of token ids into sequences of one size (operator 13): bounded-space online best-fit, then a merge of leftovers.

Each task encodes its texts once and keeps a fixed number of open windows. What is to be placed goes where it leaves the least
room; where none has room, the fullest window takes as much as it holds and is emitted, the rest is placed in turn. Texts
longer than a window give whole windows first. So only windows that are open at the end of a task are not full; their pieces
travel on, ids included (``OPEN`` windows a task at most), and are merged in the same way, ``FAN`` tasks' windows at a time,
until one group is left. Its last windows are put one behind the other, and what does not fill a whole one is cut at powers of
two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreforge.operators.numbering import offsets

from . import common as C
from .records import encoder

SIZE, OPEN, FAN = 4096, 64, 16
#: Bits of a task's number in a key of (round, task).
TASK_BITS = 40

PIECES = "key long, no long, window int, doc_id long, start long, doc_tokens long, offset int, length int, ids binary"
_PIECES = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in PIECES.split(", ")])

#: doc_id, start, tokens of the document, ids
Piece = tuple[int | None, int, int, np.ndarray]


def _length(pieces: list[Piece]) -> int:
    return sum(len(p[3]) for p in pieces)


def cut(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``n`` ids of some pieces, and the others."""
    front, rest = [], []
    for doc, start, total, ids in pieces:
        take = min(n, len(ids))
        n -= take
        if take:
            front.append((doc, start, total, ids[:take]))
        if take < len(ids):
            rest.append((doc, start + take, total, ids[take:]))
    return front, rest


class Packer:
    """Open windows, by room; ``full`` takes the sequences that are done."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most = size, most
        self.windows: dict[int, list[Piece]] = {}
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.made = 0
        self.full: list[list[Piece]] = []

    def place(self, pieces: list[Piece]) -> None:
        n = _length(pieces)
        while n >= self.size:
            front, pieces = cut(pieces, self.size)
            self.full.append(front)
            n -= self.size
        if not n:
            return
        at = bisect_left(self.rooms, (n, -1))
        if at < len(self.rooms):
            room, no = self.rooms.pop(at)
            self.windows[no] += pieces
            self._keep(room - n, no)
        elif len(self.rooms) < self.most:
            self.made += 1
            self.windows[self.made] = list(pieces)
            self._keep(self.size - n, self.made)
        else:
            room, no = self.rooms.pop(0)
            front, rest = cut(pieces, room)
            self.full.append(self.windows.pop(no) + front)
            self.place(rest)

    def _keep(self, room: int, no: int) -> None:
        if room:
            insort(self.rooms, (room, no))
        else:
            self.full.append(self.windows.pop(no))

    def left(self) -> list[list[Piece]]:
        """The open windows, fullest first; none is open then."""
        out = [self.windows[no] for _, no in self.rooms]
        self.windows, self.rooms = {}, []
        return out

    def finish(self) -> None:
        """Closes the open windows without padding: whole windows, then powers of two."""
        pieces = [p for w in self.left() for p in w]
        n = _length(pieces)
        while n:
            size = min(self.size, 1 << (n.bit_length() - 1))
            front, pieces = cut(pieces, size)
            self.full.append(front)
            n -= size


class _Rows:
    """Pieces as rows of ``PIECES``."""

    def __init__(self, key: int, keep_ids: bool):
        self.key, self.keep_ids, self.no, self.rows = key, keep_ids, 0, []

    def full(self, sequences: list[list[Piece]]) -> None:
        for pieces in sequences:
            self._add(pieces, self.no, None, self.keep_ids)
            self.no += 1
        sequences.clear()

    def open(self, windows: list[list[Piece]]) -> None:
        for no, pieces in enumerate(windows):
            self._add(pieces, None, no, True)

    def _add(self, pieces: list[Piece], no: int | None, window: int | None, keep: bool) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            data = ids.astype("<u4").tobytes()
            self.rows.append((self.key, no, window, doc, start, total, at, len(ids), data if keep else zlib.crc32(data).to_bytes(4, "big")))
            at += len(ids)

    def batch(self) -> pa.RecordBatch:
        cols = zip(*self.rows) if self.rows else [[]] * len(_PIECES)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECES)], schema=_PIECES)
        self.rows = []
        return out


def _first(model_path: str, end_id: int, size: int, most: int, keep_ids: bool):
    """Texts to sequences; a task's open windows come last."""

    def run(batches):
        from pyspark import TaskContext

        packer, rows = Packer(size, most), _Rows(TaskContext.get().partitionId(), keep_ids)
        for batch in batches:
            col, docs = C.texts_of(batch), batch.column(0).to_pylist()
            for a, b in C.chunks(col):
                flat, counts = encoder(model_path).encode(col.slice(a, b - a))
                cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
                for i, doc in enumerate(docs[a:b]):
                    ids = np.append(flat[cuts[i] : cuts[i + 1]], np.int32(end_id))
                    packer.place([(doc, 0, len(ids), ids)])
                rows.full(packer.full)
                yield rows.batch()
        rows.open(packer.left())
        yield rows.batch()

    return run


def _merge(level: int, last: bool, size: int, most: int, keep_ids: bool):
    """Rows in order of (group, key, window, offset): open windows of several tasks to sequences."""

    def settle(group: int, windows: list[list[Piece]]) -> pa.RecordBatch:
        packer, rows = Packer(size, most), _Rows(level << TASK_BITS | group, keep_ids)
        for pieces in sorted(windows, key=_length, reverse=True):
            packer.place(pieces)
        if last:
            packer.finish()
        rows.full(packer.full)
        rows.open(packer.left())
        return rows.batch()

    def run(batches):
        group, place, windows = None, None, []
        for batch in batches:
            for no, key, window, doc, start, total, ids in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if no != group:
                    if windows:
                        yield settle(group, windows)
                    group, place, windows = no, None, []
                if place != (key, window):
                    place = key, window
                    windows.append([])
                windows[-1].append((doc, start, total, np.frombuffer(ids, "<u4")))
        if windows:
            yield settle(group, windows)

    return run


def pack(docs: DataFrame, model_path: str, size: int = SIZE, end_id: int = 2, open_windows: int = OPEN, fan: int = FAN, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece (and, if asked, its ids).

    Each row of ``docs`` (doc_id, text) is encoded, with ``end_id`` behind it, and lies in one or more pieces. A sequence holds
    ``size`` ids, or a power of two fewer, so nothing needs padding. Null and empty texts are just the end id; rows that repeat an
    id, and null ids, are rows of their own; further columns are ignored; an empty table gives no rows. Sequences are numbered
    without gaps. Which pieces share one depends on how Spark cuts the input into tasks.
    """
    spark = docs.sparkSession
    rows = C.pick(docs, "doc_id", "text")
    rows = rows.select(rows.doc_id.cast("long").alias("doc_id"), "text")
    made = C.checkpointed(rows.mapInArrow(_first(model_path, end_id, size, open_windows, keep_ids), PIECES))
    done, level = [made.where("window is null")], 0
    groups = (made.agg(F.max("key")).first()[0] or 0) + 1  # tasks
    while True:
        level, groups = level + 1, -(-groups // fan)
        group = F.floor(F.col("key").bitwiseAND((1 << TASK_BITS) - 1) / fan).cast("long")
        still = made.where("window is not null").select(group.alias("group"), "key", "window", "doc_id", "start", "doc_tokens", "ids", "offset")
        still = still.repartition("group").sortWithinPartitions("group", "key", "window", "offset")
        made = C.checkpointed(still.mapInArrow(_merge(level, groups == 1, size, open_windows, keep_ids), PIECES))
        done.append(made.where("window is null"))
        if groups == 1:
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    counts = {r["key"]: r["n"] for r in every.groupBy("key").agg((F.max("no") + 1).alias("n")).collect()}  # a row a task
    first = F.broadcast(spark.createDataFrame(list(offsets(counts).items()), "key long, _first long"))
    crc = F.crc32("ids") if keep_ids else F.conv(F.hex("ids"), 16, 10).cast("long")  # without the ids, four bytes of their checksum
    out = every.join(first, "key").select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), crc.alias("ids_crc32"), "doc_tokens", (F.col("_first") + F.col("no")).alias("sequence_id"), F.col("offset").cast("long").alias("offset"), "ids"
    )
    return out if keep_ids else out.drop("ids")


def sequences(pieces: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, n_ids: the pieces of ``pack(keep_ids=True)`` put together and padded (unless they end at a power of two)."""

    def joined(batches):
        for batch in batches:
            no, out, lens = batch.column(0), [], []
            for parts in batch.column(1).to_pylist():
                ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts]).astype(np.int64)
                fill = 0 if len(ids) & (len(ids) - 1) == 0 else size - len(ids)
                lens.append(len(ids))
                out.append(np.concatenate([ids, np.full(fill, pad_id, np.int64)]).tolist())
            yield pa.RecordBatch.from_arrays([no, pa.array(out, pa.list_(pa.int64())), pa.array(lens, pa.int32())], ["sequence_id", "ids", "n_ids"])

    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # size pieces at most
    return rows.mapInArrow(joined, "sequence_id long, ids array<long>, n_ids int")
