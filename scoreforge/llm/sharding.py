"""Sharding (operator 6), DataFrame functions only: sampled splitters and range partitioning, law ``bytes``.

Records are ordered by (first 60 bits of the text's md5, doc_id), so equal texts stand together, and identical records by a
number of their own. Keys are sampled by size: a record is drawn with probability ``1 - exp(-SAMPLE * size / bytes)``, by
a hash. Quantiles of the sample are the boundaries that cut all records into ranges of nearly equal bytes; ranges that still
hold over ``SLACK`` times their due, or too many rows for a task, are sampled and subdivided in the same way, and so on. A
text with very many copies is no exception, as boundaries are whole keys with doc_id and number. Sums by range are run up
in their order; within a range rows are ranked and summed by one window, so each row's place in all bytes is exact, and
so is the shard it lies in: ``floor(shards * middle of its bytes / all bytes)``. A shard's border may fall into a group of equal
texts. Of at most ``shards - 1`` groups that are cut so, those of no more than a ``WHOLE``-th of a shard's due go wholly to the
side of their middle; larger ones stay cut, or shards would not be equal. So shards differ from an equal share by less than
one record, or half such a group, at either end. No task gets more than a range, and only boundaries, sums by range and the
groups at borders are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, forget

SAMPLE, RANGES, SLACK, PART_ROWS, LEVELS = 8192, 256, 2, 500_000, 7
WHOLE = 20


def _key() -> Column:
    """What orders records, as one value that can be compared (null ids first)."""
    return F.struct("_key", "doc_id", "_row")


def _below(bounds: Column, many: int) -> Column:
    """How many of ``bounds`` (ascending, at most ``many``) are less than a row's key, by halving."""
    low, step = F.lit(0), 1 << (many.bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step //= 2
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), low, lambda at, s: F.when(at + s > F.size(bounds), at).when(F.get(bounds, at + s - 1) < _key(), at + s).otherwise(at))


def shard(docs: DataFrame, shards: int = 40, sample: int = SAMPLE, ranges: int = RANGES, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) for each row.

    A null text has 16 bytes and the crc32 and place of an empty one. Repeated rows each have their slot. Null doc_ids are
    ordered first within their text. An empty table gives no rows. Further columns are ignored.
    """
    text = F.coalesce(F.col("`text`"), F.lit(""))
    rows = docs.select(
        F.col("`doc_id`").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("_key"),
        F.monotonically_increasing_id().alias("_row"),  # written at once, so that it never changes
        F.lit(0).cast("long").alias("_range"),
    )
    rows = checkpointed(rows)  # without the texts
    every = rows.agg(F.sum("size")).first()[0] or 0
    for _ in range(LEVELS):
        sums = rows.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        over = sums.where((F.col("_rows") > 1) & ((F.col("_bytes") > SLACK * every / ranges) | (F.col("_rows") > part_rows))).select("_range", "_bytes")
        over = checkpointed(over)  # at most ranges / SLACK, or a row for part_rows of the table's
        u = (F.pmod(F.xxhash64("_row", F.lit(17)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        drawn = rows.join(F.broadcast(over), "_range").where(-F.log(u) / F.col("size") < sample / F.col("_bytes"))
        tile = F.ntile(ranges).over(W.partitionBy("_range").orderBy(_key()))
        tops = drawn.select("_range", _key().alias("_b"), tile.alias("_t")).groupBy("_range", "_t").agg(F.max("_b").alias("_b"))
        bounds = tops.groupBy("_range").agg(F.array_sort(F.collect_list("_b")).alias("_bounds"))  # ranges keys each
        bounds = checkpointed(bounds.where(F.size("_bounds") > 1).withColumn("_bounds", F.slice("_bounds", 1, F.size("_bounds") - 1)))
        forget(over)
        if bounds.isEmpty():
            break
        cut = rows.join(F.broadcast(bounds), "_range", "left").withColumn("_sub", F.coalesce(_below(F.col("_bounds"), ranges), F.lit(0)))
        cut = checkpointed(cut.withColumn("_range", F.col("_range") * ranges + F.col("_sub")).drop("_bounds", "_sub"))
        forget(rows)
        forget(bounds)
        rows = cut
    parts = rows.groupBy("_range").agg(F.sum("size").alias("_pb"), F.count(F.lit(1)).alias("_pn"))
    run = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # over the sums of ranges only
    zero = F.lit(0).cast("long")
    placed = parts.select("_range", F.coalesce(F.sum("_pb").over(run), zero).alias("_b0"), F.coalesce(F.sum("_pn").over(run), zero).alias("_n0"))
    inside = W.partitionBy("_range").orderBy("_key", "doc_id", "_row").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("_b", F.coalesce(F.sum("size").over(inside), zero)).withColumn("_n", F.count(F.lit(1)).over(inside))
    middle = (F.col("_b0") + F.col("_b")) * 2 + F.col("size")
    shard_of = lambda twice: F.floor(twice.cast("decimal(30,0)") * shards / (2 * max(every, 1))).cast("int")
    at = ranked.join(placed, "_range").select(
        "doc_id", "size", "text_crc32", "_key", (F.col("_n0") + F.col("_n")).alias("_rank"), (F.col("_b0") + F.col("_b")).alias("_before"), shard_of(middle).alias("shard")
    )
    at = checkpointed(at)
    ends = at.groupBy("shard").agg(F.min("_key").alias("low"), F.max("_key").alias("high")).collect()  # at most ``shards`` rows, keys in order
    cut = sorted({r["low"] for r in ends} & {r["high"] for r in ends})  # a group at a border, or one that fills shards
    if cut:
        groups = at.where(F.col("_key").isin(*cut)).groupBy("_key").agg(F.sum("size").alias("_all"), F.min("_before").alias("_from")).where(F.col("_all") * WHOLE * shards <= every)
        groups = groups.select(F.col("_key").alias("_k"), shard_of(F.col("_from") * 2 + F.col("_all")).alias("_whole"))
        at = at.join(F.broadcast(groups), F.col("_key") == F.col("_k"), "left").withColumn("shard", F.coalesce("_whole", "shard"))
    first = at.groupBy("shard").agg(F.min("_rank").alias("_first"))  # at most ``shards`` rows
    return at.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
