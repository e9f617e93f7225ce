"""Running values and positions over long ordered streams, without one task that sees them all.

A window over a whole stream, or over a lane with a third of its rows, is one task. Here a stream is cut into parts that
follow one another; sums (or maxima, or last values) of parts give every part its start, and only rows of one part are
ordered among themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: The column that says which part of its stream a row is in. It may be carried on as long as the order stays.
PART = "__part"
#: Rows of a part where rows are numbered already.
STRETCH = 10_000


def in_parts(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``df``, staged, with its part: stretches of ``keys`` and ``order`` that Spark cuts by sampling, so of similar sizes however dense the stream is."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()))


#: Parts whose values are put together before those of all parts before them are: a second level, so that no task sees all parts of a stream.
SPAN = 1000
KINDS = {"sum": F.sum, "max": F.max, "min": F.min}


def _all(kind: str, value: str, place: str) -> Column:
    """``value`` of many rows put together; "last" is the last that is not null, by ``place``."""
    return KINDS[kind](value) if kind in KINDS else F.max(F.when(F.col(value).isNotNull(), F.struct(place, value)))[value]


def _before(kind: str, value: str, window) -> Column:
    return (KINDS[kind](value) if kind in KINDS else F.last(value, ignorenulls=True)).over(window)


def _joined(kind: str, earlier: Column, later: Column) -> Column:
    """One of the two where the other is null."""
    if kind == "last":
        return F.coalesce(later, earlier)
    return F.coalesce({"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}[kind](earlier, later), earlier, later)


def carried(parts: DataFrame, values: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, part, values): of each part what all parts before it come to, null where there are none.

    ``parts`` has a row for each part, with its own value in each column; ``values`` tells how they are put together:
    "sum", "max", "min" or "last". Spans of parts come first, then parts within their span.
    """
    span = F.expr(f"{PART} div {SPAN}").alias("__span")
    rows = parts.select(*keys, PART, span, *values)
    upto = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*keys, "__span").agg(*[_all(k, v, PART).alias(v) for v, k in values.items()])
    spans = spans.select(*keys, "__span", *[_before(k, v, upto).alias(f"__{v}") for v, k in values.items()])
    inside = Window.partitionBy(*keys, "__span").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(*keys, PART, "__span", *[_before(k, v, inside).alias(v) for v, k in values.items()])
    return rows.join(spans, [*keys, "__span"]).select(*keys, PART, *[_joined(k, F.col(f"__{v}"), F.col(v)).alias(v) for v, k in values.items()])


def running(df: DataFrame, values: Mapping[str, tuple[str, Column]], *, keys: Sequence[str] = (), order: Sequence[str] = ("time_ms", "channel", "pos"), before: bool = False) -> DataFrame:
    """``df`` with, by name, what the values of all rows up to and with each (``before``: without it) come to, by ``keys``, in ``order``.

    A value is (kind, column) with a kind of ``carried``: any operation whose parts can be put together. Rows are cut
    into parts and staged, unless they say which part they are in already.
    """
    cut = df if PART in df.columns else in_parts(df, order, keys)
    own = {n: f"__value_{n}" for n in values}
    by = [*keys, PART]
    cut = cut.withColumns({own[n]: c for n, (_, c) in values.items()})
    last = F.struct(*order) if any(k == "last" for k, _ in values.values()) else None
    parts = cut if last is None else cut.withColumn("__place", last)
    parts = parts.groupBy(*by).agg(*[_all(k, own[n], "__place").alias(f"__start_{n}") for n, (k, _) in values.items()])
    starts = carried(parts, {f"__start_{n}": k for n, (k, _) in values.items()}, keys)
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = cut.join(starts, by).withColumns({n: _joined(k, F.col(f"__start_{n}"), _before(k, own[n], inside)) for n, (k, _) in values.items()})
    return out.drop(*own.values(), *[f"__start_{n}" for n in values])


def running_sums(df: DataFrame, sums: Mapping[str, Column], *, keys: Sequence[str] = (), order: Sequence[str] = ("time_ms", "channel", "pos")) -> DataFrame:
    """``df`` with, by name, sums over all rows up to and with each: one pass for all of them."""
    out = running(df, {n: ("sum", c.cast("long")) for n, c in sums.items()}, keys=keys, order=order)
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in sums})


def numbered_parts(df: DataFrame, place: str) -> DataFrame:
    """``df`` with its parts, where ``place`` numbers the rows from 0 already: nothing is sampled or staged."""
    return df.withColumn(PART, F.expr(f"{place} div {STRETCH}"))


def with_lead(df: DataFrame, place: str, rows: int) -> DataFrame:
    """``df`` cut into parts by ``place``, each also with the ``rows`` rows before it; ``own`` is false for these."""
    size = max(STRETCH, rows)
    cut = df.withColumn(PART, F.expr(f"{place} div {size}")).withColumn("own", F.lit(True))
    lead = cut.where(F.col(place) % size >= size - rows).withColumn(PART, F.col(PART) + 1).withColumn("own", F.lit(False))
    return cut.unionByName(lead)


def position(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` with each row's place, from 0, by keys and order as in ``running_sums``."""
    return running_sums(df, {name: F.lit(1)}, **options).withColumn(name, F.col(name) - 1).drop(PART)
