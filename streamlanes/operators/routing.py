"""Routing: demux, mux, ordered merge, tee and provenance, all on the long stream of lanes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import PART, position, running_sums, with_lead


def demux(stream: DataFrame, lane: int) -> DataFrame:
    """One lane. On a union with literal lanes Catalyst prunes the other branches, on files it reaches the scan."""
    return stream.where(F.col("channel") == lane)


def each_lane(stream: DataFrame, aggregates: Sequence[Column]) -> DataFrame:
    """(channel, aggregates) of every lane of a demuxed stream: one grouping, whatever the number of lanes."""
    return stream.groupBy("channel").agg(*aggregates)


def sequential_mux(stream: DataFrame, chunk: int) -> DataFrame:
    """``stream`` with ``seq``, its place where each turn takes up to ``chunk`` elements of every lane, lane by lane.

    The model where all lanes are full: order by (pos div chunk, channel, pos). Elements are counted by turn and lane;
    running sums of these counts, by parts, are where each lane's turn begins, and a join brings them to its elements.
    No element is sorted, and the plan is the same for any number of lanes.
    """
    rows = stream.withColumn("turn", F.expr(f"pos div {chunk}"))
    turns = running_sums(rows.groupBy("turn", "channel").agg(F.count("*").alias("n")), {"upto": F.col("n")}, order=["turn", "channel"])
    starts = turns.select("turn", "channel", (F.col("upto") - F.col("n")).alias("start"))
    return rows.join(starts, ["turn", "channel"]).withColumn("seq", (F.col("start") + F.col("pos") % chunk).cast("long")).select(*stream.columns, "seq")


def time_merge(stream: DataFrame) -> DataFrame:
    """``stream`` with ``seq``, its place by time over all lanes; the lower lane first where times tie."""
    return position(stream, "seq", order=["time_ms", "channel", "pos"])


def sync_prefix(stream: DataFrame, lanes: Sequence[int] | None = None) -> DataFrame:
    """What an ordered merge without a flush can emit: times up to the earliest of the lanes' last times.

    A lane of ``lanes`` without elements holds everything back.
    """
    last = stream.groupBy("channel").agg(F.max("time_ms").alias("last")).collect()
    if not last or lanes is not None and set(lanes) - {r.channel for r in last}:
        return stream.where("false")
    return stream.where(F.col("time_ms") <= min(r.last for r in last))


def assert_ordered(stream: DataFrame) -> DataFrame:
    """``stream``, failing where a lane's times fall. Lanes are cut into parts that overlap by an element."""
    before = F.lag("time_ms").over(Window.partitionBy("channel", PART).orderBy("pos"))
    rows = with_lead(stream, "pos", 1).withColumn("__before", before).where("own")
    fine = F.when(F.col("__before") > F.col("time_ms"), F.raise_error(F.lit("times of a lane fall"))).otherwise(F.col("time_ms"))
    return rows.withColumn("time_ms", fine).select(stream.columns)


def tee(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two outputs of one stream. Spark reads a shared exchange once; persist the stream if both are costly."""
    return stream, stream


def with_provenance(stream: DataFrame, node: int, name: str = "via") -> DataFrame:
    """Each element wrapped with the number of the node it passed."""
    return stream.withColumn(name, F.lit(node).cast("long"))


def connect(outputs: Sequence[str], inputs: Sequence[str]) -> list[tuple[str, str]]:
    """Free outputs joined to free inputs by place, as many as both have; none is an error."""
    if not outputs or not inputs:
        raise ValueError("nothing can be connected")
    return list(zip(outputs, inputs, strict=False))
