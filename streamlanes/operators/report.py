"""The offline evaluator's relational steps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def throughput(number: Column, runtime_ms: Column) -> Column:
    """Events a minute."""
    return F.try_divide(number * 60000.0, runtime_ms)


def rounded(value: Column, digits: int) -> Column:
    """Half to even."""
    return F.bround(value, digits)


def drop_empty(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows of the experiments that have any value in ``column``."""
    return df.join(df.where(F.col(column).isNotNull()).select(*keys).distinct(), list(keys), "left_semi")


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, series, y): a row for each of ``columns``, whose name becomes a grouping key."""
    return df.unpivot(list(keys), list(columns), "series", "y")


def grouped(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates)


def concatenated(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def sorted_by(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Ascending; Spark sorts by ranges, so no task has it all."""
    return df.orderBy(*order)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row for each ``keys`` in ``order``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("nth", nth).where("nth = 1").drop("nth")


def axis_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(axis, low, high) of each column over all groups."""
    long = df.unpivot([], list(columns), "axis", "y")
    return long.groupBy("axis").agg(F.min("y").alias("low"), F.max("y").alias("high"))


def ticks(low: float, high: float, steps: int = 10) -> list[float]:
    """Places of an axis' ticks: multiples of a step of 10^ceil(log10(range)) / steps that cover the range."""
    if high <= low:
        return [low]
    step = 10 ** math.ceil(math.log10(high - low)) / steps
    return [step * k for k in range(math.floor(low / step), math.ceil(high / step) + 1)]


def merged_options(common: Mapping, own: Mapping) -> dict:
    """Options of one experiment: its own over the common ones, nested ones too."""
    out = dict(common)
    for k, v in own.items():
        out[k] = merged_options(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out
