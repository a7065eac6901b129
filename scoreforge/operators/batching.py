"""Batches under a length budget, and their shares among ranks.

Greedy packing is one pass over rows in order, each batch depending on the one before. Little input goes through one task, as
(id, length) pairs that stream by. More is numbered in its order and cut into blocks of rows. A batch has at most ``cap`` rows,
so the first batch that begins in a block begins at one of its first ``cap`` rows: for each of these, each block tells where
its batches would end and how many they are. Put together block by block, a few numbers each, that gives the row at which each
block's first batch really begins; then all blocks write their batches side by side. The batches are those of the single pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreforge.session import size_of

from .numbering import numbered

PACKED = "batch_part long, batch_no long, pos int, sample_id long, length long"
#: Bytes of input, as Spark estimates them, up to which one task packs; rows of a block beyond.
SMALL, BLOCK_ROWS = 64 << 20, 1 << 20


def _packer(budget: int, cap: int, padded: bool):
    def run(batches):
        here, no, size, total, most = None, 0, 0, 0, 0
        for batch in batches:
            nos, places = [], []
            for n, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if part != here:
                    here, no, size, total, most = part, 0, 0, 0, 0
                weight = (size + 1) * max(most, n) if padded else total + n
                if size and ((budget > 0 and weight > budget) or size >= cap):
                    no, size, total, most = no + 1, 0, 0, 0
                nos.append(no)
                places.append(size)
                size, total, most = size + 1, total + n, max(most, n)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(nos, pa.int64()), pa.array(places, pa.int32()), batch.column(0), batch.column(1)], ["batch_part", "batch_no", "pos", "sample_id", "length"])

    return run


def _jumps(length: np.ndarray, part: np.ndarray, own: int, budget: int, cap: int, padded: bool) -> np.ndarray:
    """For each of the first ``own`` rows the row behind the batch that would begin with it."""
    size, run, live = np.ones(own, np.int64), length[:own].copy(), np.arange(own)
    for k in range(1, cap):
        live = live[live + k < len(length)]
        more = length[live + k]
        run[live] = np.maximum(run[live], more) if padded else run[live] + more
        fits = part[live + k] == part[live]
        if budget > 0:
            fits &= (run[live] * (k + 1) if padded else run[live]) <= budget
        live = live[fits]
        if not len(live):
            break
        size[live] += 1
    return np.arange(own) + size


def _blocks(batches):
    """(block, columns) of rows that come in order of block and number: block, no, sample_id, length, part."""
    held, last = [], None
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if s < e:
                if held and numbers[s] != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = int(numbers[s])
    if held:
        yield last, pa.Table.from_batches(held)


ENDS = "block long, own long, ends binary, counts binary, lasts binary"


def _ends(size: int, budget: int, cap: int, padded: bool):
    """For each row at which a block's first batch may begin: how far its batches reach into the next block, how many they are, and where
    the last of them begins."""

    def run(batches):
        for block, rows in _blocks(batches):
            no, length, part = (rows.column(i).to_numpy() for i in (1, 3, 4))
            own = int(np.searchsorted(no, (block + 1) * size))
            jump = _jumps(length, part, own, budget, cap, padded).tolist()
            known: dict[int, tuple[int, int, int]] = {}
            for first in range(min(cap, own)):
                way, i = [], first
                while i < own and i not in known:
                    way.append(i)
                    i = jump[i]
                end, n, last = known[i] if i < own else (i - own, 0, -1)
                for i in reversed(way):
                    n, last = n + 1, i if last < 0 else last
                    known[i] = end, n, last
            told = np.array([known[i] for i in range(min(cap, own))], "<i8").reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "own": pa.array([own], pa.int64()), **{k: pa.array([told[:, i].tobytes()], pa.binary()) for i, k in enumerate(("ends", "counts", "lasts"))}})

    return run


def _written(size: int, budget: int, cap: int, padded: bool, starts):
    """Batches of each block, whose first batch begins at a row that is known now."""

    def run(batches):
        for block, rows in _blocks(batches):
            no, ids, length, part = (rows.column(i).to_numpy() for i in (1, 2, 3, 4))
            own = int(np.searchsorted(no, (block + 1) * size))
            jump = _jumps(length, part, own, budget, cap, padded).tolist()
            entry, first, behind = starts.value[block]
            begins, i = [], entry
            while i < own:
                begins.append(i)
                i = jump[i]
            fresh = np.zeros(own, np.int64)
            fresh[begins] = 1
            batch = np.cumsum(fresh)
            begin = np.concatenate([[-behind], begins]).astype(np.int64)  # of the batch that came over from the block before, too
            yield pa.RecordBatch.from_arrays([pa.array(first - 1 + batch), pa.array((np.arange(own) - begin[batch]).astype(np.int32)), pa.array(ids[:own]), pa.array(length[:own])], ["batch_id", "pos", "sample_id", "length"])

    return run


def pack(samples: DataFrame, length: str, sample_id: str = "sample_id", budget: int = 24000, cap: int = 32, padded: bool = False, partitions: int | None = None, order: str | Column | None = None, block_rows: int | None = None) -> DataFrame:
    """batch_id, pos, sample_id, length: a batch is closed before the row that would exceed the budget (the sum of lengths, or with
    ``padded`` rows times the longest) or the cap; a longer row is a batch of its own. Rows come by length (ties by id), or by
    ``order`` (ties by id). With ``partitions`` no batch crosses the borders of so many parts of equal numbers of rows. ``block_rows``
    asks for blocks of so many rows whatever the input's size; the batches are the same."""
    keys = [F.col(length).cast("long")] if order is None else [F.col(order) if isinstance(order, str) else order]
    rows = samples.select(F.col(sample_id).cast("long").alias("sample_id"), F.col(length).cast("long").alias("length"), *[k.alias(f"_o{i}") for i, k in enumerate(keys)])
    places = [*[f"_o{i}" for i in range(len(keys))], "sample_id"]
    known = size_of(samples)
    if block_rows is None and (partitions or 1) == 1 and known is not None and known <= SMALL:
        packed = rows.repartition(1).sortWithinPartitions(*places).select("sample_id", "length", F.lit(0).cast("long").alias("part")).mapInArrow(_packer(budget, cap, padded), PACKED)
        return packed.select(F.col("batch_no").alias("batch_id"), "pos", "sample_id", "length")
    spark, size = samples.sparkSession, max(block_rows or BLOCK_ROWS, cap)
    rows = numbered(rows, places)
    part = F.lit(0).cast("long")
    if (partitions or 1) > 1:
        part = F.floor(F.col("no") * partitions / rows.count())
    own = F.floor(F.col("no") / size).cast("long")
    near = (F.col("no") % size < cap) & (F.col("no") >= size)  # also seen by the block before, whose last batch may reach them
    dealt = rows.select(F.explode(F.when(near, F.array(own - 1, own)).otherwise(F.array(own))).alias("block"), "no", "sample_id", "length", part.alias("part"))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "no")
    entry, first, behind, starts = 0, 0, 0, {}
    for r in sorted(dealt.mapInArrow(_ends(size, budget, cap, padded), ENDS).collect(), key=lambda r: r["block"]):  # three times ``cap`` numbers a block
        starts[r["block"]] = entry, first, behind
        if entry < r["own"]:
            end, n, last = (int(np.frombuffer(r[c], "<i8")[entry]) for c in ("ends", "counts", "lasts"))
            entry, first, behind = end, first + n, r["own"] - last
    return dealt.mapInArrow(_written(size, budget, cap, padded, spark.sparkContext.broadcast(starts)), "batch_id long, pos int, sample_id long, length long")


def drop_last(batches: DataFrame, least: int = 2) -> DataFrame:
    """``batches`` but a last one of fewer than ``least`` rows."""
    last = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("batch_id")).limit(1).where(F.col("_n") < least)
    return batches.join(F.broadcast(last.select("batch_id")), "batch_id", "left_anti")


def draw(seed: int, *of: Column) -> Column:
    """A random key of some values, the same for the same seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in of]).cast("binary"))


def shuffled_order(samples: DataFrame, length: str, seed: int, epoch: int = 0, sample_id: str = "sample_id", chunks: int = 10, least: int = 100) -> DataFrame:
    """``samples`` with ``chunk`` and ``order_key``: by length (ties by id) cut into chunks of a tenth of all rows, at least ``least``;
    chunks in a random order, rows in a random order inside them. The order is one of hashes, the same for the same seed
    and epoch."""
    size = max(least, samples.count() // chunks)
    out = numbered(samples, [length, sample_id]).withColumn("chunk", F.floor(F.col("no") / size).cast("int")).drop("no")
    return out.withColumn("order_key", F.struct(draw(seed + epoch, F.col("chunk")).alias("a"), draw(seed + epoch, F.col(sample_id)).alias("b")))


def pad_world(batches: DataFrame, world: int) -> DataFrame:
    """(batch_id, source_id): batch numbers up to a multiple of ``world``, the added ones repeating from the first."""
    ids = batches.select("batch_id").distinct()
    n = ids.agg((F.max("batch_id") + 1).alias("n"))
    extra = n.select(F.explode(F.when(F.pmod(F.col("n"), F.lit(world)) > 0, F.sequence(F.col("n"), F.ceil(F.col("n") / world) * world - 1)).otherwise(F.array().cast("array<bigint>"))).alias("batch_id"), "n")
    return ids.select("batch_id", F.col("batch_id").alias("source_id")).unionByName(extra.select("batch_id", F.pmod("batch_id", "n").alias("source_id")))


def rank_share(batches: DataFrame, world: int) -> DataFrame:
    """``batches`` with the rank that takes each."""
    return batches.withColumn("rank", F.pmod("batch_id", F.lit(world)).cast("int"))


def length_stats(samples: DataFrame, length: str) -> DataFrame:
    return samples.agg(F.min(length).alias("min_len"), F.max(length).alias("max_len"), F.avg(length).alias("avg_len"), F.count(F.lit(1)).alias("n"))


def batch_stats(batches: DataFrame) -> DataFrame:
    """Number of batches and mean rows of one."""
    return batches.agg(F.countDistinct("batch_id").alias("n_batches"), (F.count(F.lit(1)) / F.greatest(F.countDistinct("batch_id"), F.lit(1))).alias("mean_size"))
