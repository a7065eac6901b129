"""Token-ID / binary output (operator 5): length-delimited binary records with an offset index.

Texts are sorted by doc_id (and a hash of the text) over range partitions, encoded, and each partition writes two files below the shared folder:

``part-*.rec``   for each document: u64 length of the payload, u32 masked crc32 of those 8 bytes, the payload, u32 masked
                 crc32 of the payload. Payload: i64 doc_id, u8 flags (1: doc_id is null), u8 bytes per id (2 or 4), the ids.
``part-*.idx``   for each record: i64 doc_id, u64 offset in the data file, u64 ids of the file before it, u64 its ids.
                 A reader that shuffles seeks by it and needs no other record.

All little-endian; a mask is a rotation by 15 bits plus a constant, so that a checksum of data holding checksums stays sound.
A manifest (one row a file) gives each file's place in the order and its first id. A file's name is unique to the attempt
that wrote it and only the manifest of finished tasks names it, so a retried or doubled task leaves whole files only.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

# Fixed values of the file format.
HEAD = struct.Struct("<QI")
INTRO = struct.Struct("<qBB")
TAIL = struct.Struct("<I")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("start", "<u8"), ("n", "<u8")])
MASK_ADD = 0xA282EAD8

#: Entries of a worker's cache of encoded words.
CACHE = 600_000


def masked(crc: int) -> int:
    return ((((crc >> 15) | (crc << 17)) & 0xFFFFFFFF) + MASK_ADD) & 0xFFFFFFFF


def unmasked(value: int) -> int:
    rot = (value - MASK_ADD) & 0xFFFFFFFF
    return ((rot >> 17) | (rot << 15)) & 0xFFFFFFFF


# ---------------------------------------------------------------- encoding

SPACE, LETTER, DIGIT, OTHER, SLOW = range(5)


def _classes() -> np.ndarray:
    """Classes of the code points below 0x250; every other one is left to the library, as are those it treats apart."""
    out = np.empty(0x250, np.uint8)
    for c in range(0x250):
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else OTHER
    out[[9, 10, 11, 12, 13, 32, 0xA0]] = SPACE
    out[[0, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x130]] = SLOW
    return out


#: Endings that form a token of their own after an apostrophe (a fixed value of the vocabulary's pattern).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class WordEncoder:
    """Ids of whole texts as the library gives them.

    The vocabulary's pattern cuts a text into runs of letters, single digits and runs of other characters, which the
    library encodes independently of each other. They are found for a whole chunk at once; each distinct one is encoded
    by the library once and remembered. Texts with characters outside Latin (or special tokens) go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = sorted({t.content for t in self.lib.get_added_tokens_decoder().values()})
        self.kind = _classes()
        self.lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x250)], np.uint32)
        self.known, self.made = C.SegmentTable(CACHE), C.Ragged(np.int32)
        self.wide = self.lib.get_vocab_size() > 0xFFFF

    def slow(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number per text."""
        cps, offs = C.utf32_flat(col)
        n_docs = len(offs) - 1
        doc_of = np.repeat(np.arange(n_docs), np.diff(offs))
        small = cps < 0x250
        kind = np.where(small, self.kind[np.where(small, cps, 0)], SLOW)
        slow_doc = np.zeros(n_docs, bool)
        slow_doc[doc_of[kind == SLOW]] = True
        angle = np.unique(doc_of[cps == ord("<")])
        for i in angle.tolist():
            if not slow_doc[i] and any(s in col[i].as_py() for s in self.special):
                slow_doc[i] = True
        slow_rows = np.flatnonzero(slow_doc)
        if len(slow_rows):
            kind = np.where(slow_doc[doc_of], SPACE, kind)
        flat = self.lower[np.where(small, cps, 0)]
        new = np.ones(len(cps) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (doc_of[1:] != doc_of[:-1])
        quotes = np.flatnonzero((flat == ord("'")) & new[:-1] & (kind == OTHER))
        for q in quotes.tolist():
            after = "".join(map(chr, flat[q + 1 : min(q + 3, int(offs[doc_of[q] + 1]))].tolist()))
            for e in ENDINGS:
                if after.startswith(e):
                    new[q + 1] = False
                    new[q + 1 + len(e)] = True
                    break
        starts = np.flatnonzero(new[:-1])
        ends = np.concatenate([starts[1:], [len(cps)]]) if len(starts) else starts
        word = kind[starts] != SPACE
        starts, ends = starts[word], ends[word]
        counts = np.zeros(n_docs, np.int64)
        ids = np.zeros(0, np.int32)
        if len(starts):
            uniq, first, inv = C.distinct(C.segment_digests(flat, starts, ends))
            if self.known.n > self.known.most:
                self.known.clear()
                self.made.clear()
            rows = self.known.find(uniq)
            miss = np.flatnonzero(rows < 0)
            if len(miss):
                s, e = starts[first[miss]], ends[first[miss]]
                one = C.gather(flat, s, e - s).tobytes().decode("utf-32-le")
                cuts = np.concatenate([[0], np.cumsum(e - s)]).tolist()
                got = self.slow([one[a:b] for a, b in zip(cuts, cuts[1:])])
                sizes = np.array([len(x) for x in got], np.int64)
                self.made.extend(np.fromiter((i for x in got for i in x), np.int32, int(sizes.sum())), sizes)
                rows[miss] = self.known.add((uniq[0][miss], uniq[1][miss]))
            rows = rows[inv]
            n = self.made.lens[rows]
            ids = C.gather(self.made.flat, self.made.starts[rows], n)
            counts += np.bincount(doc_of[starts], weights=n, minlength=n_docs).astype(np.int64)
        if len(slow_rows):
            got = dict(zip(slow_rows.tolist(), self.slow([col[i].as_py() for i in slow_rows.tolist()])))
            cuts = np.concatenate([[0], np.cumsum(counts)])
            parts, at = [], 0
            for i in slow_rows.tolist():
                parts += [ids[cuts[at] : cuts[i]], np.array(got[i], np.int32)]
                at = i
            ids = np.concatenate([*parts, ids[cuts[at] :]])
            counts[slow_rows] = [len(got[i]) for i in slow_rows.tolist()]
        return ids, counts


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- files


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def frame(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    """One record."""
    body = INTRO.pack(doc_id or 0, doc_id is None, 4 if wide else 2) + ids.astype("<u4" if wide else "<u2").tobytes()
    head = struct.pack("<Q", len(body))
    return head + TAIL.pack(masked(zlib.crc32(head))) + body + TAIL.pack(masked(zlib.crc32(body)))


def parse(read) -> tuple[int | None, np.ndarray] | None:
    """The next record of ``read(n)``, checked; None at the end of the file."""
    head = read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("a record's head is cut off")
    size, crc = HEAD.unpack(head)
    if unmasked(crc) != zlib.crc32(head[:8]):
        raise ValueError("a record's length fails its checksum")
    body = read(size + TAIL.size)
    if len(body) < size + TAIL.size or unmasked(TAIL.unpack(body[-4:])[0]) != zlib.crc32(body[:-4]):
        raise ValueError("a record fails its checksum")
    doc, null, width = INTRO.unpack(body[: INTRO.size])
    return (None if null else doc), np.frombuffer(body, dtype=f"<u{width}", offset=INTRO.size, count=(size - INTRO.size) // width)


def write(docs: DataFrame, folder: str, model_path: str, end_id: int | None = 1) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the files; returns the manifest (part, file, rows, ids, first_id).

    Null texts count as empty (just the end id); rows with the same doc_id stand next to each other, by a hash of the text; null ids
    come first; further columns are ignored; an empty table gives an empty manifest.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs = out = idx = None
        offset = start = rows = 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, path = _store(folder)
                fs.create_dir(path, recursive=True)
                out, idx = (fs.open_output_stream(f"{path}/{name}.{x}", buffer_size=1 << 20) for x in ("rec", "idx"))
            enc, col, ids_of = encoder(model_path), C.texts_of(batch), batch.column(0).to_pylist()
            for a, b in C.chunks(col):
                flat, counts = enc.encode(col.slice(a, b - a))
                cuts = np.concatenate([[0], np.cumsum(counts)])
                tab = np.zeros(b - a, INDEX)
                for i, doc in enumerate(ids_of[a:b]):
                    ids = flat[cuts[i] : cuts[i + 1]]
                    if end_id is not None:
                        ids = np.append(ids, end_id)
                    rec = frame(doc, ids, enc.wide)
                    tab[i] = (doc or 0, offset, start, len(ids))
                    out.write(rec)
                    offset, start, rows = offset + len(rec), start + len(ids), rows + 1
                idx.write(tab.tobytes())
        if out is not None:
            out.close()
            idx.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "rows": pa.array([rows], pa.int64()), "ids": pa.array([start], pa.int64())})

    rows = C.pick(docs, "doc_id", "text")
    rows = rows.select(rows.doc_id.cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))  # one id's rows may fill many ranges
    made = rows.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text").select("doc_id", "text").mapInArrow(run, "part long, file string, rows long, ids long")
    made = C.checkpointed(made)  # a row a file: the files are written once, and named here
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return made.withColumn("first_id", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


def read(spark: SparkSession, folder: str, manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, ids_crc32 and, if asked, the ids. Each file is a task's; every checksum is tested."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")

    def run(batches):
        for batch in batches:
            fs, path = _store(folder)
            for row in batch.to_pylist():
                start, rows = row["first_id"], []
                with fs.open_input_stream(f"{path}/{row['file']}.rec", buffer_size=1 << 20) as f:
                    while (got := parse(f.read)) is not None:
                        doc, ids = got
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] if keep_ids else [])))
                        start += len(ids)
                        if len(rows) >= 5000:
                            yield _batch(rows, keep_ids)
                            rows = []
                if start - row["first_id"] != row["ids"]:
                    raise ValueError("a file is cut off")
                if rows:
                    yield _batch(rows, keep_ids)

    return manifest.select("file", "ids", "first_id").repartition("file").mapInArrow(run, schema)


def _batch(rows: list, keep_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * keep_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_at(folder: str, file: str, which: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records of the given places in one file, by its offset index: for shuffled reads."""
    fs, path = _store(folder)
    with fs.open_input_stream(f"{path}/{file}.idx") as f:
        tab = np.frombuffer(f.read(), INDEX)
    with fs.open_input_file(f"{path}/{file}.rec") as f:
        out = []
        for i in which:
            f.seek(int(tab[i]["offset"]))
            out.append(parse(f.read))
        return out


def write_and_read(docs: DataFrame, model_path: str, end_id: int = 1) -> DataFrame:
    """Both, below the shared folder of the session."""
    folder = C.new_folder(docs.sparkSession, "records")
    return read(docs.sparkSession, folder, write(docs, folder, model_path, end_id))
