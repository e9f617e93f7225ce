"""Motifs from profiles: hysteresis segments, overlap sets, the best of each, labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordering
from .ordering import PART, carried, numbered_parts, running, running_sums
from .profile import filtered, matrix_profile, usable_lengths
from .staging import staged

Candidate = tuple[int, int, float]  # start, length, unfitness: low is good
BEGIN, INSIDE, NONE = "MOTIF_BEGIN", "MID_MOTIF", "NA"


# On whole tables -----------------------------------------------------------------------------------------------------

def hysteresis(profile: DataFrame, lo: float, hi: float, unfitness: str = "exit") -> DataFrame:
    """(channel, buffer, start, length, unfitness): segments that open at ``lo`` or less and last while at ``hi`` or less.

    The first and the last point of a profile open and continue nothing. A segment starts at its leftmost minimum; its
    unfitness is the value just after it ("exit") or its minimum ("min"). Profiles are gone through by parts: what is
    open at a part's start follows from the parts before, so no task has a lane's whole profile.
    """
    by = ["channel", "buffer", "m"]
    given = staged(profile)
    cut = numbered_parts(given, "i").withColumn("own", F.lit(True))
    following = cut.where((F.col("i") % ordering.STRETCH == 0) & (F.col(PART) > 0)).withColumn(PART, F.col(PART) - 1).withColumn("own", F.lit(False))
    order = Window.partitionBy(*by, PART).orderBy("i")
    inner = F.col("own") & (F.col("i") >= 1) & (F.col("i") <= F.col("n") - 2)
    mark = F.when(F.col("d") <= lo, 1).when(F.col("d") > hi, 0)
    rows = cut.unionByName(following).withColumn("after", F.lead("d").over(order)).where(inner).withColumn("mark", mark)
    marks = numbered_parts(given, "i").where((F.col("i") >= 1) & (F.col("i") <= F.col("n") - 2)).withColumn("mark", mark)
    last = marks.groupBy(*by, PART).agg(F.max(F.when(F.col("mark").isNotNull(), F.struct("i", "mark")))["mark"].alias("last"))
    last = carried(last, {"last": "last"}, by).select(*by, PART, F.coalesce("last", F.lit(0)).alias("carried"))
    state = F.coalesce(F.last("mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried"))
    rows = rows.join(last, [*by, PART]).withColumn("state", state)
    rows = rows.withColumn("opens", F.coalesce(F.lag("state").over(order), F.col("carried")) == 0)
    # Only open points are numbered by their segments, and the windows above are gone through once.
    rows = staged(rows.where("state = 1").select(*by, PART, "i", "d", "after", "opens"))
    runs = running_sums(rows, {"run": F.col("opens")}, keys=by, order=["i"])
    found = runs.groupBy(*by, "run").agg(F.min(F.struct("d", "i")).alias("low"), F.max(F.struct("i", "after")).alias("end"))
    value = F.col("end.after") if unfitness == "exit" else F.col("low.d")
    return found.select("channel", "buffer", F.col("low.i").alias("start"), F.col("m").alias("length"), value.alias("unfitness"))


def shortest_by_start(candidates: DataFrame) -> DataFrame:
    """Of candidates that start together, the shortest."""
    nth = F.row_number().over(Window.partitionBy("channel", "buffer", "start").orderBy("length"))
    return candidates.withColumn("nth", nth).where("nth = 1").drop("nth")


def overlap_sets(candidates: DataFrame) -> DataFrame:
    """Candidates with ``set``: those that overlap, directly or through others, share one. Ends are inclusive; starts are distinct.

    A set begins where no candidate before reaches. How far those before reach, and how many sets have begun, are running
    values by parts, so no task has a lane's candidates.
    """
    by = ["channel", "buffer"]
    rows = running(candidates, {"reach": ("max", F.col("start") + F.col("length") - 1)}, keys=by, order=["start"], before=True)
    rows = rows.withColumn("fresh", F.col("reach").isNull() | (F.col("start") > F.col("reach"))).drop("reach")
    return running_sums(rows, {"set": F.col("fresh")}, keys=by, order=["start"]).drop("fresh", PART)


def merge_overlaps(candidates: DataFrame) -> DataFrame:
    """The best candidate of each overlap set: lowest unfitness, then the longest, then the leftmost."""
    rank = F.struct("unfitness", (-F.col("length")).alias("shorter"), "start", "length")
    best = overlap_sets(candidates).groupBy("channel", "buffer", "set").agg(F.min(rank).alias("best"))
    return best.select("channel", "buffer", "best.start", "best.length", "best.unfitness")


def motif_labels(lanes: DataFrame, motifs: DataFrame, buffer: int, begin: str = BEGIN, inside: str = INSIDE, none: str = NONE) -> DataFrame:
    """(channel, pos, detected) for every element: ``begin`` where a motif starts, ``inside`` within it, else ``none``."""
    at = F.col("buffer") * buffer + F.col("start")
    points = motifs.select("channel", at.alias("from"), F.explode(F.sequence(at, at + F.col("length") - 1)).alias("pos"))
    points = points.select("channel", "pos", F.when(F.col("pos") == F.col("from"), begin).otherwise(inside).alias("detected"))
    return lanes.select("channel", "pos").join(points, ["channel", "pos"], "left").select("channel", "pos", F.coalesce("detected", F.lit(none)).alias("detected"))


# On one array: what the buffered detector calls ----------------------------------------------------------------------

def segments(d: np.ndarray, m: int, lo: float, hi: float, unfitness: str = "exit") -> list[Candidate]:
    """``hysteresis`` of one profile."""
    out: list[Candidate] = []
    open_at: int | None = None
    for i in range(1, len(d)):
        inner = i <= len(d) - 2
        if open_at is None:
            if inner and d[i] <= lo:
                open_at = i
        elif not inner or d[i] > hi:
            low = open_at + int(np.argmin(d[open_at:i]))
            out.append((low, m, float(d[i] if unfitness == "exit" else d[low])))
            open_at = None
    return out


def merged(candidates: Sequence[Candidate]) -> list[Candidate]:
    """The best of each overlap set, by start."""
    out: list[Candidate] = []
    group: list[Candidate] = []
    reach = -1
    for c in [*sorted(candidates), None]:
        if group and (c is None or c[0] > reach):
            out.append(min(group, key=lambda g: (g[2], -g[1], g[0])))
            group = []
        if c is not None:
            reach = max(reach, c[0] + c[1] - 1) if group else c[0] + c[1] - 1
            group.append(c)
    return out


def find_motifs(values: Sequence[float], lengths: Sequence[int], lo: float, hi: float, *, zone_factor: float = 1.0, mode: str = "NONE", unfitness: str = "exit", digits: int = 6) -> list[Candidate]:
    """Motifs of one series, by start, without overlaps."""
    if not 0 <= lo <= hi <= 2 or any(m < 2 for m in lengths) or zone_factor < 0:
        raise ValueError("0 <= lo <= hi <= 2, lengths of 2 or more and a zone factor of 0 or more are asked for")
    by_start: dict[int, Candidate] = {}
    for m in usable_lengths(len(values), lengths):
        n = len(values) - m + 1
        if n > 1 and int(zone_factor * m) + 1 >= n:
            continue
        d = np.round(filtered(matrix_profile(values, m, zone_factor), mode, m), digits)
        for c in segments(d, m, lo, hi, unfitness):
            by_start.setdefault(c[0], c)
    return merged(list(by_start.values()))


def expand(motifs: Sequence[Candidate], n: int, begin: str = BEGIN, inside: str = INSIDE, none: str = NONE) -> list[str]:
    """Labels of ``n`` points; motifs must come by start, not overlap and end within ``n``."""
    out, reach = [none] * n, 0
    for start, length, _ in motifs:
        if start < reach or start + length > n:
            raise ValueError("motifs overlap, are not in order or end too late")
        out[start : start + length] = [begin] + [inside] * (length - 1)
        reach = start + length
    return out
