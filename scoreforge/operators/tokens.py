"""Subword tokens by a tokenizer adapter, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import adapters

#: Makes, once a worker, a pair of functions: texts to lists of ids (nothing added to them), and lists of ids to texts (special tokens kept).
Factory = Callable[[], tuple[Callable[[list[str]], list[list[int]]], Callable[[list[list[int]]], list[str]]]]


def _mapped(rows: DataFrame, factory: Factory, which: int, columns: dict[str, str], kind: T.DataType) -> DataFrame:
    made = adapters.once(factory)
    names = [f"c{i}" for i in range(len(rows.columns))]
    places = [rows.columns.index(c) for c in columns.values()]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, rows.schema)] + [T.StructField(f"m{i}", kind) for i in range(len(places))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = made()[which]
        for pdf in batches:
            out = pdf.copy()
            for i, place in enumerate(places):
                there = pdf[f"c{place}"].notna()
                values = pd.Series([None] * len(pdf), index=pdf.index, dtype="object")
                if there.any():
                    values[there] = pd.Series(work(pdf.loc[there, f"c{place}"].tolist()), index=pdf.index[there], dtype="object")
                out[f"m{i}"] = values
            yield out

    return rows.toDF(*names).mapInPandas(run, schema).toDF(*rows.columns, *columns)


def encoded(rows: DataFrame, factory: Factory, **columns: str) -> DataFrame:
    """``rows`` with the ids of texts: ``encoded(rows, factory, ids="text")`` adds ids of column text; null texts have null ids."""
    return _mapped(rows, factory, 0, columns, T.ArrayType(T.IntegerType()))


def decoded(rows: DataFrame, factory: Factory, **columns: str) -> DataFrame:
    """``rows`` with the texts of ids."""
    return _mapped(rows, factory, 1, columns, T.StringType())


def training_ids(rows: DataFrame, factory: Factory, prefix: str, end: str, target: str = "target") -> DataFrame:
    """``rows`` with ``ids`` of prefix, target and end as one text, and ``prefix``: how many ids the prefix alone has."""
    out = rows.withColumn("_full", F.concat(F.lit(prefix), F.col(target), F.lit(end))).withColumn("_prefix", F.lit(prefix))
    out = encoded(out, factory, ids="_full", _prefix_ids="_prefix")
    return out.withColumn("prefix", F.size("_prefix_ids")).drop("_full", "_prefix", "_prefix_ids")
