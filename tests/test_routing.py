import random

import pytest

from streamlanes.operators import routing
from streamlanes.operators.ordering import position, running_sums
from pyspark.sql import functions as F

SCHEMA = "channel long, pos long, time_ms long"


def stream(spark, rng, lanes=3):
    rows = []
    for c in range(lanes):
        t = 0
        for p in range(rng.randint(1, 12)):
            t += rng.randint(0, 4)
            rows.append((c, p, t))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_sequential_mux_matches_sorting(spark):
    for seed in range(4):
        rows, df = stream(spark, random.Random(seed))
        want = {r[:2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1] // 3, r[0], r[1])))}
        assert {(r.channel, r.pos): r.seq for r in routing.sequential_mux(df, 3).collect()} == want


def test_merge_and_running_sums_cross_parts(spark):
    rows, df = stream(spark, random.Random(7))
    want = {r[:2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0], r[1])))}
    got = position(df, "seq", order=["time_ms", "channel", "pos"])
    assert {(r.channel, r.pos): r.seq for r in got.collect()} == want
    total = running_sums(df, {"s": F.col("pos"), "n": F.lit(1)}, keys=["channel"], order=["time_ms", "pos"])
    assert all(r.s == r.pos * (r.pos + 1) // 2 and r.n == r.pos + 1 for r in total.collect())


def test_sync_prefix_holds_what_later_elements_may_precede(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 9), (1, 0, 4), (1, 1, 6)], SCHEMA)
    assert sorted(r.time_ms for r in routing.sync_prefix(df).collect()) == [1, 4, 6]
    assert routing.sync_prefix(df, lanes=[0, 1, 2]).count() == 0


def test_falling_times_are_an_error(spark):
    bad = spark.createDataFrame([(0, 0, 5), (0, 1, 4)], SCHEMA)
    with pytest.raises(Exception, match="times of a lane fall"):
        routing.assert_ordered(bad).collect()


def test_connect():
    assert routing.connect(["a", "b"], ["x"]) == [("a", "x")]
    with pytest.raises(ValueError):
        routing.connect([], ["x"])


def test_running_values_by_parts_and_spans(spark, monkeypatch):
    """Sums, maxima, minima and last values over parts of a few rows and spans of two parts, against a plain loop."""
    import random

    from pyspark.sql import functions as F

    from streamlanes.operators import ordering

    monkeypatch.setattr(ordering, "SPAN", 2)
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, rng.randint(-9, 9)])) for k, n in ((0, 57), (1, 9), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, x long").withColumn(ordering.PART, F.expr("i div 4"))
    kinds = {n: (n, F.col("x")) for n in ("sum", "max", "min", "last")}
    together = {"sum": sum, "max": max, "min": min, "last": lambda v: v[-1]}
    for before in (False, True):
        got = {(r.k, r.i): r for r in ordering.running(df, kinds, keys=["k"], order=["i"], before=before).collect()}
        assert len(got) == len(rows)
        for k, i, _ in rows:
            seen = [x for kk, j, x in rows if kk == k and j < i + (not before) and x is not None]
            assert all(got[k, i][n] == (f(seen) if seen else None) for n, f in together.items()), (k, i)


def test_overlap_sets_have_no_window_over_a_lane(spark):
    import random

    from streamlanes.operators import motifs

    rng = random.Random(2)
    rows = [(c, 0, s, rng.randint(2, 9), float(rng.randint(0, 3))) for c in (0, 1) for s in sorted(rng.sample(range(900), 200))] + [(2, 0, 0, 5000, 1.0), (2, 0, 10, 3, 0.5), (2, 0, 4999, 4, 0.5), (2, 0, 5003, 4, 0.5)]
    df = spark.createDataFrame(rows, "channel long, buffer long, start long, length long, unfitness double")
    got = sorted((r.channel, r.start, r.length, r.unfitness) for r in motifs.merge_overlaps(df).collect())
    assert got == sorted((c, *m) for c in (0, 1, 2) for m in motifs.merged([r[2:] for r in rows if r[0] == c]))
    plan = motifs.overlap_sets(df)._jdf.queryExecution().optimizedPlan().toString()
    assert all("__part" in line or "__span" in line for line in plan.splitlines() if "windowspecdefinition" in line)
