"""Precision, recall and F1 by points and by events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .motifs import BEGIN, INSIDE, NONE
from .ordering import PART, running_sums
from .staging import staged


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where a is 0."""
    return F.when(a == 0, 0.0).otherwise(F.try_divide(a, b))


def harmonic(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), 0.0).otherwise(2 * a * b / (a + b))


def point_outcomes(points: DataFrame, none: str = NONE) -> DataFrame:
    """``points`` (label, detected, ...) with 0/1 columns tp, fp, tn, fn; a detected motif on any true one is a tp."""
    got, true = F.col("detected") != none, F.col("label") != none
    flag = lambda c: c.cast("long")
    return points.withColumns({"tp": flag(got & true), "fp": flag(got & ~true), "tn": flag(~got & ~true), "fn": flag(~got & true)})


def point_scores(counts: DataFrame) -> DataFrame:
    """Tables of tp, fp, tn, fn with precision, recall and F1 of both classes, and their harmonic mean."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"pos_precision": ratio(tp, tp + fp), "pos_recall": ratio(tp, tp + fn), "neg_precision": ratio(tn, tn + fn), "neg_recall": ratio(tn, tn + fp)})
    out = out.withColumn("pos_f1", harmonic(F.col("pos_precision"), F.col("pos_recall"))).withColumn("neg_f1", harmonic(F.col("neg_precision"), F.col("neg_recall")))
    return out.withColumn("overall_f1", harmonic(F.col("pos_f1"), F.col("neg_f1")))


def point_f1(points: DataFrame, by: str = "channel") -> DataFrame:
    """Final counts and scores of each lane."""
    return point_scores(point_outcomes(points).groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]))


def running_point_f1(points: DataFrame) -> DataFrame:
    """Counts and scores after every element of each lane (channel, pos, time_ms, label, detected)."""
    counts = ("tp", "fp", "tn", "fn")
    rows = running_sums(point_outcomes(points), {f"{c}_upto": F.col(c) for c in counts}, keys=["channel"], order=["time_ms", "pos"])
    rows = rows.drop(*counts, PART).withColumnsRenamed({f"{c}_upto": c for c in counts})
    return point_scores(rows)


def event_segments(points: DataFrame, column: str, begin: str | None = None, none: str = NONE) -> DataFrame:
    """(channel, first, last, label, closed): maximal runs of equal ``column``; with ``begin``, every such label starts an event that the rest extends.

    Detected labels are given with ``begin``, true ones without. ``closed`` is false for a lane's last event, which may
    go on. Events are numbered by running sums over stretches of a lane, so no task needs it whole.
    """
    size = 10_000
    rows = points.select("channel", "pos", F.col(column).alias("label")).withColumn("part", F.expr(f"pos div {size}"))
    # A run's start is seen from the element before, which each stretch's first gets from the stretch before.
    edge = rows.where(F.col("pos") % size == size - 1).select("channel", (F.col("part") + 1).alias("part"), F.col("label").alias("edge"))
    lag = F.lag("label").over(Window.partitionBy("channel", "part").orderBy("pos"))
    rows = rows.withColumn("before", lag).join(edge, ["channel", "part"], "left").withColumn("before", F.coalesce("before", "edge"))
    if begin is None:
        starts = F.col("before").isNull() | (F.col("label") != F.col("before"))
        kind = F.col("label")
    else:
        starts = F.col("before").isNull() | (F.col("label") == begin) | ((F.col("label") != none) != (F.col("before") != none))
        kind = F.when(F.col("label") == none, none).otherwise(begin)
    rows = running_sums(rows.withColumn("kind", kind).withColumnRenamed("part", PART), {"event": starts}, keys=["channel"], order=["pos"])
    events = staged(rows.groupBy("channel", "event").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("kind").alias("label")))
    final = events.groupBy("channel").agg(F.max("event").alias("final"))
    return events.join(final, "channel").select("channel", "first", "last", "label", (F.col("event") < F.col("final")).alias("closed"))


def event_pairs(detected: DataFrame, true: DataFrame, none: str = NONE, grid: int = 1024) -> DataFrame:
    """(channel, d_first, t_first, f1) of detected and true events that overlap; 0 where only one of them is ``none``.

    Intervals meet on the cells of a grid that both touch, and a pair is taken at the first such cell: an equality join
    that splits lanes, where a condition on ranges alone would compare all with all.
    """
    d = detected.select("channel", F.col("first").alias("d_first"), F.col("last").alias("d_last"), F.col("label").alias("d_label"))
    t = true.select("channel", F.col("first").alias("t_first"), F.col("last").alias("t_last"), F.col("label").alias("t_label"))
    cells = lambda x: F.explode(F.sequence(F.expr(f"{x}_first div {grid}"), F.expr(f"{x}_last div {grid}")))
    met = d.withColumn("cell", cells("d")).join(t.withColumn("cell", cells("t")), ["channel", "cell"])
    met = met.where((F.col("d_first") <= F.col("t_last")) & (F.col("t_first") <= F.col("d_last")) & (F.col("cell") == F.expr(f"greatest(d_first, t_first) div {grid}")))
    shared = F.least("d_last", "t_last") - F.greatest("d_first", "t_first") + 1
    f1 = 2.0 * shared / ((F.col("d_last") - F.col("d_first") + 1) + (F.col("t_last") - F.col("t_first") + 1))
    same = (F.col("d_label") == none) == (F.col("t_label") == none)
    return met.select("channel", "d_first", "t_first", F.when(same, f1).otherwise(0.0).alias("f1"))


def best_f1_events(points: DataFrame, begin: str = BEGIN, none: str = NONE) -> DataFrame:
    """(side, channel, first, is_none, f1, final_at) of every event that counts, with its best overlap's F1 (0 if there is none).

    An event counts once it is closed and the other side's closed events cover its end; ``final_at`` is the place of the
    element that makes it so: the one after its end and the end of the other side's event that covers it.
    """
    points = staged(points)
    d = staged(event_segments(points, "detected", begin, none).where("closed"))
    truth = F.when(F.col("label") == INSIDE, begin).otherwise(F.col("label"))
    t = staged(event_segments(points.withColumn("truth", truth), "truth", None, none).where("closed"))
    pairs = staged(event_pairs(d, t, none))
    sides = []
    for side, own, other, key, theirs in (("detected", d, t, "d_first", "t_first"), ("true", t, d, "t_first", "d_first")):
        covered = other.groupBy("channel").agg(F.max("last").alias("covered"))
        met = pairs.join(other.select("channel", F.col("first").alias(theirs), F.col("last").alias("reach")), ["channel", theirs])
        best = met.groupBy("channel", F.col(key).alias("first")).agg(F.max("f1").alias("f1"), F.max("reach").alias("reach"))
        counts = own.join(covered, "channel").where(F.col("last") <= F.col("covered")).join(best, ["channel", "first"], "left")
        sides.append(counts.select(
            F.lit(side).alias("side"), "channel", "first", (F.col("label") == none).alias("is_none"), F.coalesce("f1", F.lit(0.0)).alias("f1"),
            (F.greatest("last", F.coalesce("reach", F.col("last"))) + 1).alias("final_at"),
        ))
    return sides[0].unionByName(sides[1])


def best_f1(points: DataFrame, begin: str = BEGIN, none: str = NONE) -> DataFrame:
    """(side, channel, first, is_none, f1) of every event that counts."""
    return best_f1_events(points, begin, none).drop("final_at")


def event_f1(points: DataFrame) -> DataFrame:
    """One row: macro precision (over detected events), recall (over true ones) and F1 of motifs and of none, and overall."""
    e = best_f1(points)
    mean = lambda side, none: F.coalesce(F.avg(F.when((F.col("side") == side) & (F.col("is_none") == none), F.col("f1"))), F.lit(0.0))
    out = e.agg(mean("detected", False).alias("pos_precision"), mean("true", False).alias("pos_recall"), mean("detected", True).alias("neg_precision"), mean("true", True).alias("neg_recall"))
    out = out.withColumn("pos_f1", harmonic(F.col("pos_precision"), F.col("pos_recall"))).withColumn("neg_f1", harmonic(F.col("neg_precision"), F.col("neg_recall")))
    return out.withColumn("overall_f1", harmonic(F.col("pos_f1"), F.col("neg_f1")))
