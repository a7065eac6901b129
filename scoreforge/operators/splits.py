"""Train and validation parts by data set, and what each holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(samples: DataFrame, val_datasets: list[str] | None = None, column: str = "dataset_name") -> tuple[DataFrame, DataFrame | None]:
    """(train, validation): validation is None without names or without that column. A null name is training data."""
    if not val_datasets or column not in samples.columns:
        return samples, None
    inside = F.coalesce(F.col(column).isin(list(val_datasets)), F.lit(False))
    return samples.where(~inside), samples.where(inside)


def report(validation: DataFrame, column: str = "dataset_name") -> DataFrame:
    """Rows of each data set."""
    return validation.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def missing(samples: DataFrame, val_datasets: list[str], column: str = "dataset_name") -> DataFrame:
    """Names asked for that no row has."""
    asked = samples.sparkSession.createDataFrame([(n,) for n in sorted(set(val_datasets))], f"{column} string")
    return asked.join(samples.select(column).distinct(), column, "left_anti")
