"""Mixing sources to target weights by Pareto order sampling (Rosen 1997), with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace

#: Ranks are cut into so many ranges, and each again, whose sums place a source's cut before single rows are ranked.
RANGES = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) for ``sizes`` (source, source_size), one row a source.

    Sources in code-point order, null last, weigh ``weights`` over and over. Together they get ``share`` of all sizes;
    a target stops at ``limit`` times its source's size and the excess goes to the others by weight, until none is
    above. The fixed point has a closed form: with sources sorted by limit per weight, those up to some place are full
    and the rest share what is left, so two window sums find it without a loop. One row a source passes these windows.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    base = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    base = (
        base.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("w_from"))
    )
    # The first source in this order that is not full sets the level of all after it.
    level = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(everything)
    return base.withColumn("at", level["level"]).select(
        "source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("w"))).alias("target")
    )


def class_rates(classes: DataFrame, limit: float = 2.0) -> DataFrame:
    """(source, class, rate) for ``classes`` (source, class, weight, words, target): the copies each document of a class expects.

    Rates are in proportion to the classes' weights, ``limit`` at most, and come to the source's target in words. The
    level is found as in ``source_targets``; a source has few classes.
    """
    by = Window.partitionBy("source").orderBy(F.desc("weight"), "class")
    base = classes.withColumn("cap", F.col("words") * F.lit(float(limit))).withColumn("share", F.col("words") * F.col("weight"))
    base = base.withColumn("full_before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    base = base.withColumn("share_from", F.sum("share").over(Window.partitionBy("source").orderBy("weight", F.desc("class")).rowsBetween(Window.unboundedPreceding, 0)))
    base = base.withColumn("level", (F.col("target") - F.col("full_before")) / F.col("share_from"))
    level = F.min(F.when(F.col("level") * F.col("weight") < limit, F.struct(-F.col("weight"), F.col("class"), F.col("level").alias("level")))).over(Window.partitionBy("source"))
    return base.withColumn("at", level["level"]).select(
        "source", "class", F.when(F.col("at").isNull(), F.lit(float(limit))).otherwise(F.least(F.lit(float(limit)), F.col("at") * F.col("weight"))).alias("rate")
    )


def uniform(seed: int, *columns: Column) -> Column:
    """A number within (0, 1) from the columns' texts: 52 bits of an MD5, which SQL engines share."""
    told = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\u0001")) for c in columns])
    return (F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def pareto_mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 17, damping: float = 0.25, within: float = 0.001,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row for each row of ``docs``.

    Documents expect copies by their length: those of twice as many words ``damping`` fewer powers of 2 (by classes of
    sizes between powers of 2), so that a few very long ones don't make up a source; rates stop at ``limit`` and come to
    the source's target in words. The whole part of a rate is certain; the rest is the document's inclusion probability
    p. Documents are ranked by the odds of a random number over the odds of p, u/(1-u) : p/(1-p), and a source takes
    them in this order, one after another, each that still fits in what its target lacks, until that is ``within`` of the
    target. So the sample has a fixed size in words, and documents are in it with probabilities close to p.

    Random numbers come from id, size, source and ``seed``: reruns agree, whatever the partitioning. No task ranks a
    source: sums over ranges of the rank, and again over ranges of the one that holds the cut, find the document that no
    longer fits; what is left open by it is filled in the same way from the documents after it that are small enough.
    What is missing shrinks with every turn, below the size of the document that did not fit, so turns are few.

    Null text: size 0, no copies wanted (taken 0); empty texts and very long ones are as any other. Null source: a
    source of its own. Null ids and repeated rows are kept as rows; equal rows have equal ranks and are taken in any
    order, which leaves the same result. Sources of size 0 have target 0. An empty table gives an empty table. Other
    columns of ``docs`` are not read.
    """
    ws = Workspace(docs.sparkSession, "mix")
    given = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # Classes by doubling, without a logarithm's rounding.
    class_of = F.length(F.bin("size")).cast("int")
    rows = ws.stage(given.withColumn("class", class_of).withColumn("u", uniform(seed, F.col("id"), F.col("size"), F.col("source"))).withColumn("row_key", F.monotonically_increasing_id()), "rows")
    classes = ws.stage(rows.groupBy("source", "class").agg(F.sum("size").alias("words")), "classes")
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    targets = ws.stage(source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit), "targets")
    some = classes.where("words > 0").withColumn("weight", F.pow(F.lit(2.0), -F.lit(float(damping)) * F.col("class")))
    rates = class_rates(some.alias("a").join(targets.alias("b"), same).select("a.*", "target"), limit)
    rates = ws.stage(rates.withColumn("whole", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.col("whole")), "rates")
    certain = rates.alias("a").join(classes.alias("b"), same & (F.col("a.class") == F.col("b.class"))).groupBy("a.source").agg(F.sum(F.col("whole") * F.col("words")).alias("certain"))
    lacks = F.greatest(F.lit(0), F.floor("target").cast("long") - F.coalesce("certain", F.lit(0)))
    plan = ws.stage(targets.alias("a").join(certain.alias("b"), same, "left").select("a.source", "source_size", "target", lacks.alias("gap")), "plan")
    # The rank within (0, 1), in the order of the ratio of odds.
    p, u = F.col("p"), F.col("u")
    rank = u * (1 - p) / (u * (1 - p) + (1 - u) * p)
    in_class = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.class") == F.col("b.class"))
    rated = rows.alias("a").join(rates.alias("b"), in_class, "left").select("a.id", "a.source", "a.size", "a.row_key", F.coalesce("whole", F.lit(0)).alias("whole"), F.when(p > 0, rank).alias("rank"))
    rated = ws.stage(rated, "rated")
    state = ws.stage(plan.select("source", "target", "gap", F.lit(-1.0).alias("since"), F.lit(-1).cast("long").alias("since_key")), "state-0")
    segments = []
    # What a turn may take: documents after the last one that did not fit, small enough for the gap.
    at = lambda a, b: F.struct(a, b)
    while True:
        turn = len(segments)
        waiting = state.where((F.col("gap") > 0) & ((F.col("since") < 0) | (F.col("gap") > F.col("target") * within)))
        able = rated.where("rank IS NOT NULL AND size > 0").alias("a").join(waiting.alias("b"), same).where((F.col("size") <= F.col("gap")) & (at(F.col("rank"), F.col("row_key")) > at(F.col("since"), F.col("since_key"))))
        able = able.select("a.source", "size", "row_key", "rank", "gap", F.floor(F.col("rank") * RANGES).alias("cell"), F.floor(F.col("rank") * RANGES * RANGES).alias("part"))

        def crossing(sums: DataFrame, order: list[str], name: str) -> DataFrame:
            """Of a source's ``sums`` in order, the first that no longer fits, with what fits before it."""
            upto = Window.partitionBy("source").orderBy(*order)
            summed = sums.withColumn("upto", F.col("before") + F.sum("words").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
            over = summed.where(F.col("upto") > F.col("gap")).groupBy("source").agg(F.min(F.struct(*order, (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
            return ws.stage(over.select("source", "x.*"), f"{name}-{turn}")

        cells = crossing(able.groupBy("source", "cell", "gap").agg(F.sum("size").alias("words")).withColumn("before", F.lit(0).cast("long")), ["cell"], "cells")
        inside = able.alias("a").join(cells.alias("b"), same & (F.col("a.cell") == F.col("b.cell"))).select("a.*", "before")
        parts = crossing(inside.groupBy("source", "part", "gap", "before").agg(F.sum("size").alias("words")), ["part"], "parts")
        inside = able.alias("a").join(parts.alias("b"), same & (F.col("a.part") == F.col("b.part"))).select("a.*", "before", F.col("size").alias("words"))
        stops = crossing(inside, ["rank", "row_key"], "stops")
        known = waiting.alias("a").join(stops.alias("b"), same, "left")
        step = ws.stage(known.select("a.source", "target", F.col("gap").alias("most"), "since", "since_key", F.col("rank").alias("until"), F.col("row_key").alias("until_key"), (F.col("gap") - F.col("before")).alias("left")), f"segment-{turn}")
        if step.isEmpty():
            break
        segments.append(step.select("source", "most", "since", "since_key", "until", "until_key"))
        state = step.where("until IS NOT NULL").select("source", "target", F.col("left").alias("gap"), F.col("until").alias("since"), F.col("until_key").alias("since_key"))
    chosen = F.lit(0)
    out = rated
    if segments:
        every = segments[0]
        for s in segments[1:]:
            every = every.unionByName(s)
        lists = every.groupBy("source").agg(F.collect_list(F.struct("most", "since", "since_key", "until", "until_key")).alias("segments"))  # a turn each
        fits = F.exists("segments", lambda s: (F.col("size") <= s.most) & (at(F.col("rank"), F.col("row_key")) > at(s.since, s.since_key)) & (s.until.isNull() | (at(F.col("rank"), F.col("row_key")) < at(s.until, s.until_key))))
        out = rated.alias("a").join(lists.alias("b"), same, "left").select("a.*", "segments")
        chosen = F.when((F.col("size") > 0) & F.col("rank").isNotNull() & F.coalesce(fits, F.lit(False)), 1).otherwise(0)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + chosen).cast("long")
    out = out.withColumn("copies", copies).alias("a").join(plan.alias("b"), same)
    return out.select(F.col("id").alias(id_col), "a.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
