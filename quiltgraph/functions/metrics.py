"""Accuracy of estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def qerror(true, estimate) -> Column:
    """Signed ratio: the estimate over the true value, each at least 1."""
    return F.greatest(_column(estimate).cast("double"), F.lit(1.0)) / F.greatest(_column(true).cast("double"), F.lit(1.0))


def log_qerror(true, estimate) -> Column:
    return F.log10(qerror(true, estimate))


def summary(df: DataFrame, value: Column) -> DataFrame:
    """One row: total, average and (population) standard deviation of ``value``."""
    return df.agg(F.sum(value).alias("total"), F.avg(value).alias("average"), F.stddev_pop(value).alias("std"))
