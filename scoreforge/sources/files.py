"""Files by path, in tasks: folders listed level by level, lists of JSON cut by bytes.

Paths are those of stores that Arrow reads (local, hdfs, s3, gs). What only Spark reads is listed by Spark (``indexed``).
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreforge.session import written

STORES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
ENTRY = "found string, size long, is_dir boolean"
#: Bytes of a list that a task takes, and that it reads at once to find the end of its last element.
SPLIT_BYTES, AHEAD = 8 << 20, 1 << 16


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, and the path in it."""
    bare = re.sub("^file:/*", "/", path)
    return (pafs.LocalFileSystem(), bare) if bare.startswith("/") else pafs.FileSystem.from_uri(path)


def arrow_reads(path: str) -> bool:
    scheme = re.match("^([a-z0-9]+):", path)
    return path.startswith("/") if scheme is None else scheme[1] in STORES


def bare(path: Column) -> Column:
    """A path without its store's name, so that ``file:/x`` and ``/x`` are one."""
    return F.regexp_replace(path, "^[a-z0-9]+:/*", "/")


def bare_path(path: str) -> str:
    """The same of one path."""
    return re.sub("^[a-z0-9]+:/*", "/", path)


def indexed(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below ``root`` that are not empty, as Spark's own index has them; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("found"), F.col("length").alias("size"))


def _children(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, inside = store_of(path)
            head = path[: len(path) - len(inside)] if path.endswith(inside) else ""
            local = isinstance(store, pafs.LocalFileSystem)
            some = []
            for e in store.get_file_info(pafs.FileSelector(inside, allow_not_found=True)):
                if e.type in (pafs.FileType.File, pafs.FileType.Directory) and not (local and os.path.islink(e.path)):
                    some.append((head + e.path, e.size or 0, e.type == pafs.FileType.Directory))
                if len(some) == 10_000:
                    yield _entries(some)
                    some = []
            yield _entries(some)


def _entries(some: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some) if some else [[]] * 3, (pa.string(), pa.int64(), pa.bool_()))], ["found", "size", "is_dir"])


def listed(spark: SparkSession, root: str, depth: int | None = None, tasks: int | None = None) -> DataFrame:
    """found, size, depth of all files below ``root`` (of those ``depth`` levels below it only, if given): the folders of a level are
    dealt to tasks, which list them, so no one task and not the driver sees all files. Links are not followed; a root that is
    not there has no files."""
    folders, files, level = spark.createDataFrame([(root.rstrip("/"),)], "found string"), [], 0
    while True:
        level += 1
        dealt = folders.repartition(tasks, "found") if tasks else folders.repartition("found")
        found = written(dealt.select("found").mapInArrow(_children, ENTRY))
        if depth in (None, level):
            files.append(found.where("not is_dir").select("found", "size", F.lit(level).alias("depth")))
        folders = found.where("is_dir")
        if level == depth or folders.isEmpty():
            break
    out = files[0] if files else spark.createDataFrame([], "found string, size long, depth int")
    for more in files[1:]:
        out = out.unionByName(more)
    return out


def existing(spark: SparkSession, root: str) -> DataFrame:
    """Paths (``found``) of all files below ``root`` that are not empty; no content is read."""
    return (listed(spark, root).where("size > 0") if arrow_reads(root) else indexed(spark, root)).select("found")


def opened(paths: DataFrame, path: str = "found", content: str = "content") -> DataFrame:
    """``paths`` with the text of each file (null if it is gone or no UTF-8): every task opens its own."""
    names = [*paths.columns, content]
    place = names.index(path)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # so many texts are in memory
                part, texts = batch.slice(at, 1000), []
                for name in part.column(place).to_pylist():
                    store, inside = store_of(name)
                    try:
                        with store.open_input_stream(inside) as f:
                            texts.append(f.read().decode("utf-8-sig"))
                    except (FileNotFoundError, UnicodeDecodeError):
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return paths.mapInArrow(run, paths.select("*", F.lit(None).cast("string").alias(content)).schema)


# ---------------------------------------------------------------- lists of JSON

QUOTE, BACK, OPEN, SHUT, COMMA = ord('"'), ord("\\"), [ord("["), ord("{")], [ord("]"), ord("}")], ord(",")
#: What each byte is: nothing, a quote, a bracket that opens, one that shuts, a comma; and how far each of these goes down.
KINDS = np.zeros(256, np.uint8)
KINDS[QUOTE], KINDS[OPEN], KINDS[SHUT], KINDS[COMMA] = 1, 2, 3, 4
DEPTH = np.array([0, 0, 1, -1, 0], np.int8)


def _bytes(f: pa.NativeFile, start: int, end: int) -> np.ndarray:
    f.seek(start)
    return np.frombuffer(f.read(end - start), np.uint8)


def _escaped(f: pa.NativeFile, start: int) -> bool:
    """Whether an odd number of backslashes stands before ``start``."""
    n = 0
    while n < start:
        more = _bytes(f, max(0, start - n - 64), start - n)
        run = len(more) if (more == BACK).all() else int(np.argmax(more[::-1] != BACK))
        n += run
        if run < len(more):
            break
    return n % 2 == 1


def _signs(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes that begin or end a string (those behind an even number of backslashes), brackets and commas, and their kinds."""
    kinds = KINDS[data]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    back = np.flatnonzero(data == BACK)
    if not escaped and not len(back):
        return at, kinds
    heads, tails = back[np.diff(back, prepend=-2) != 1], back[np.diff(back, append=len(data) + 1) != 1]
    begun = escaped and (not len(heads) or heads[0] > 0)  # a backslash of the range before stands before the first byte
    shielded = tails[(tails - heads + 1 + (escaped & (heads == 0))) % 2 == 1] + 1
    plain = (kinds != KINDS[QUOTE]) | ~np.isin(at, np.concatenate([[0], shielded]) if begun else shielded, assume_unique=True)
    return at[plain], kinds[plain]


def _within(kinds: np.ndarray) -> np.ndarray:
    """Which signs stand behind an odd number of quotes."""
    return np.logical_xor.accumulate(kinds == KINDS[QUOTE])


def _steps(kinds: np.ndarray, outside: np.ndarray) -> np.ndarray:
    return DEPTH[kinds] * outside


def _states(batches):
    """Of each split: whether it changes between in and out of strings, and how far it goes down if it begins outside, or inside."""
    for batch in batches:
        rows = []
        for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
            store, inside = store_of(path)
            with store.open_input_file(inside) as f:
                _, kinds = _signs(_bytes(f, start, end), _escaped(f, start))
            odd = _within(kinds)
            rows.append((path, start, bool(len(odd) and odd[-1]), int(_steps(kinds, ~odd).sum(dtype=np.int64)), int(_steps(kinds, odd).sum(dtype=np.int64))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], ["path", "start", "turns", "out_depth", "in_depth"])


def _marks(data: np.ndarray, escaped: bool, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the brackets and commas of the outermost list, and which of them end it."""
    at, kinds = _signs(data, escaped)
    outside = _within(kinds) == inside
    at, kinds = at[outside], kinds[outside]
    after = depth + np.cumsum(DEPTH[kinds], dtype=np.int64)
    outer = np.flatnonzero(after <= 1)
    at, after, step = at[outer], after[outer], DEPTH[kinds[outer]]
    signs = data[at]
    shut = (signs == SHUT[0]) & (after == 0)
    found = ((signs == COMMA) & (after == 1)) | ((signs == OPEN[0]) & (after == 1) & (after - step == 0)) | shut
    return at[found], shut[found]


def _elements(states):
    def run(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                inside, depth = states.value[path, start]
                store, name = store_of(path)
                with store.open_input_file(name) as f:
                    size, more = f.size(), AHEAD
                    escaped, data = _escaped(f, start), _bytes(f, start, min(end + AHEAD, size))
                    marks, shut = _marks(data, escaped, inside, depth)
                    own = marks[~shut & (marks < end - start)]
                    if not len(own):
                        continue
                    # the last element may end in what follows: read on until a mark stands there
                    while marks[-1] == own[-1] and start + len(data) < size:
                        more = 2 * more
                        data = np.concatenate([data, _bytes(f, start + len(data), min(start + len(data) + more, size))])
                        marks, shut = _marks(data, escaped, inside, depth)
                raw = data.tobytes()
                if marks[-1] == own[-1]:
                    own = own[:-1]  # the list is not closed
                ends = marks[np.searchsorted(marks, own) + 1]
                texts = [raw[a + 1 : b].strip() for a, b in zip(own.tolist(), ends.tolist())]
                texts = [t.decode("utf-8", "replace") for t in texts if t]
                for at in range(0, len(texts), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(texts[at : at + 1000], pa.string())], ["element"])

    return run


def json_elements(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The elements of the JSON lists in a file, or in the files of a folder, as texts: each file is cut into ranges of ``split_bytes``.

    Where a range begins is not known from its bytes, so a first pass tells, for each, what it does to the state (in a string or
    not, how deep) from either state; run up on the driver (three numbers a range), that gives the state at each start. In the
    second pass a range gives the elements whose bracket or comma lies in it, the last one read on to its end. White space
    around elements goes; a list that is not closed loses its last element; empty files and lists give none.
    """
    files = indexed(spark, path).select(F.col("found").alias("path"), "size")
    splits = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"), "size")
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("end")).repartition("path", "start")
    states, inside, depth, last = {}, False, 0, None
    for r in sorted(splits.mapInArrow(_states, "path string, start long, turns boolean, out_depth long, in_depth long").collect(), key=lambda r: (r["path"], r["start"])):
        if r["path"] != last:
            inside, depth, last = False, 0, r["path"]
        states[r["path"], r["start"]] = inside, depth
        depth += r["in_depth"] if inside else r["out_depth"]
        inside ^= r["turns"]
    return splits.mapInArrow(_elements(spark.sparkContext.broadcast(states)), "element string")
