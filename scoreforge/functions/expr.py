"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often (and inside whatever lambdas) it is referred to."""
    return F.transform(F.array(value), use)[0]


def joined(*arrays: Column) -> Column:
    """Arrays one after another, null if one is: what ``concat`` gives, several times as fast where Spark interprets it (in lambdas)."""
    return F.flatten(F.array(*arrays))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that is computed once a row, whatever filters or explodes by it afterwards. A filter on a column
    made of expressions is moved below them, and they are made once for it and once more for the result; it stays above
    a projection that also holds a random number (which streams may have, too)."""
    return df.withColumns({name: value, "_any": F.rand(0)}).where("_any >= 0").drop("_any")
