"""Numbers of all rows in one order, without a task that sees them all.

Rows are dealt to ranges of the order (Spark samples the boundaries), sorted inside them and written with their place in their
range; the numbers of rows by range are run up, a number a range, and added to the places.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreforge.session import written

#: Bits of ``monotonically_increasing_id`` below the partition's number.
PLACE_BITS = 33


def offsets(counts: dict[int, int]) -> dict[int, int]:
    """The sum of the counts before each key, in order of the keys."""
    keys = sorted(counts)
    return dict(zip(keys, accumulate((counts[k] for k in keys), initial=0)))


def numbered(rows: DataFrame, order: list[str | Column], name: str = "no", partitions: int | None = None) -> DataFrame:
    """``rows`` with their number (from 0) in ``order``, as column ``name``. Rows of equal order are numbered one after another in
    any way, so an order that ends in an id gives the same numbers in every run; it also lets a range border cut a frequent value.

    A task holds a range; the driver sees one count a range. An empty table gives no rows; nulls come where the order puts them.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    placed = written(dealt.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    return run_up(placed, name)


def run_up(placed: DataFrame, name: str = "no") -> DataFrame:
    """The number of each row of a table that was written in the order of its partitions, each row with the id that
    ``monotonically_increasing_id`` gave it there (``_at``)."""
    part = F.shiftright("_at", PLACE_BITS)
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    spark = placed.sparkSession
    first = spark.createDataFrame(list(offsets(counts).items()), "_part long, _first long")
    out = placed.withColumn("_part", part).join(F.broadcast(first), "_part")
    return out.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)).drop("_part", "_first", "_at")
