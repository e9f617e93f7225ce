import json
import logging
import random

import pytest
from pyspark.sql import functions as F

from streamlanes.functions import numeric as num
from streamlanes.operators import langmodel, metrics, report
from streamlanes.plans.graph import Builder, Registry, Spec, chain_order, lane_numbers, typed
from streamlanes.sources import lanes
from streamlanes.streaming import control


def test_idle_timeouts_match_a_state_machine(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([1, 2, 5, 20])
        rows.append((0, i, t, rng.choices(["NA", "MOTIF_BEGIN", "MID_MOTIF"], [0.8, 0.1, 0.1])[0]))
    want, since, idle = [], None, True
    for _, pos, t, label in rows:
        if label == "NA":
            since = t if since is None else since
            if t - since >= 12 and not idle:
                want.append(pos)
                idle = True
        else:
            since = None
            idle = idle and label != "MOTIF_BEGIN"
    df = spark.createDataFrame(rows, "channel long, pos long, time_ms long, label string")
    got = sorted(r.pos for r in langmodel.idle_timeouts(df, 1, 12).collect())
    assert got == want


def test_predictions_use_only_what_came_before(spark):
    words = "a b a b a c a b".split()
    df = spark.createDataFrame([(0, i, w, " ".join(words[max(0, i - 1) : i])) for i, w in enumerate(words)], "session long, seq long, word string, state string")
    got = [r.predicted for r in langmodel.predictions(df).orderBy("seq").collect()]
    assert got == [None, None, None, "b", "a", "b", None, "b"]


def test_states_and_predictions_over_parts(spark, monkeypatch):
    """Sessions, counts and histories that cross the edges of small parts, against a plain loop."""
    from streamlanes.operators import ordering

    monkeypatch.setattr(ordering, "STRETCH", 7)
    rng = random.Random(5)
    words = [rng.choice("aab") for _ in range(120)]
    session = [i // 50 for i in range(120)]
    df = spark.createDataFrame([(i, 0, i, w, i, s) for i, (w, s) in enumerate(zip(words, session, strict=True))], "time_ms long, channel long, pos long, word string, seq long, session long")
    states = langmodel.with_states(df, 3)
    counts, want = {}, []
    for i, w in enumerate(words):
        state = " ".join(words[max(session[i] * 50, i - 3) : i])
        seen = counts.setdefault(state, {})
        want.append((state, min(seen, key=lambda x: (-seen[x], x)) if seen else None))
        seen[w] = seen.get(w, 0) + 1
    assert [(r.state, r.predicted) for r in langmodel.predictions(states).orderBy("seq").collect()] == want
    last = langmodel.model_sizes(states).orderBy("seq").collect()[-1]
    assert (last.n_states, last.n_transitions) == (len(counts), sum(map(len, counts.values())))


def test_vocabulary_and_closing():
    langmodel.check_vocabulary({0: ["NA", "MOTIF_BEGIN", "idle"], 1: ["NA", "idle", "x"]}, [0])
    with pytest.raises(ValueError):
        langmodel.check_vocabulary({0: ["NA", "idle"]}, [0])
    rates = langmodel.finish_model({("idle", "a"): 1, ("a", "b"): 1}, "b")
    assert rates["entropy_rate"] == pytest.approx(0) and rates["perplexity_rate"] == pytest.approx(1)
    assert langmodel.finish_model({}, "idle") == {}


def test_point_and_event_scores(spark):
    truth = ["NA"] * 4 + ["A"] * 4 + ["NA"] * 4 + ["A"] * 4
    found = ["NA"] * 5 + ["MOTIF_BEGIN", "MID_MOTIF", "MID_MOTIF"] + ["NA"] * 4 + ["MOTIF_BEGIN"] * 2 + ["MID_MOTIF"] * 2
    df = spark.createDataFrame([(0, i, i, a, b) for i, (a, b) in enumerate(zip(truth, found, strict=True))], "channel long, pos long, time_ms long, label string, detected string")
    p = metrics.point_f1(df).first()
    assert (p.tp, p.fp, p.tn, p.fn) == (7, 0, 8, 1) and p.pos_precision == 1 and p.pos_recall == 7 / 8
    segments = [(r.first, r.last, r.label, r.closed) for r in metrics.event_segments(df, "detected", "MOTIF_BEGIN").orderBy("first").collect()]
    assert segments == [(0, 4, "NA", True), (5, 7, "MOTIF_BEGIN", True), (8, 11, "NA", True), (12, 12, "MOTIF_BEGIN", True), (13, 15, "MOTIF_BEGIN", False)]
    e = metrics.event_f1(df).first()
    assert e.pos_precision == pytest.approx(6 / 7) and e.pos_recall == pytest.approx(6 / 7)
    assert e.neg_precision == pytest.approx((8 / 9 + 1) / 2)


def test_lossless_casts_and_durations(spark):
    df = spark.createDataFrame([(1, 2.0, 3_600_000 * 101 + 61_007)], "a long, b double, ms long")
    r = df.select(num.lossless_cast(F.col("a"), "boolean").alias("x"), num.lossless_cast(F.col("b"), "int").alias("y"), num.duration_text(F.col("ms")).alias("z")).first()
    assert (r.x, r.y, r.z) == (True, 2, "101:01:01:007")
    assert spark.sql(f"SELECT {2**53} AS v").select(num.lossless_cast(F.col("v"), "double").alias("x")).first().x == 2.0**53
    with pytest.raises(Exception, match="does not fit"):
        spark.sql(f"SELECT {2**53 + 1} AS v").select(num.lossless_cast(F.col("v"), "double")).collect()
    assert num.total_of([1, 2.5]) == 3.5 and num.indices(2, 5) == [2, 3, 4] and num.same_sets({1}, {1})
    with pytest.raises(Exception, match="does not fit"):
        spark.sql("SELECT CAST('1.000000000000000001' AS DECIMAL(38,18)) AS v").select(num.lossless_cast(F.col("v"), "double")).collect()
    assert spark.sql("SELECT CAST('1.5' AS DECIMAL(38,18)) AS v").select(num.lossless_cast(F.col("v"), "double").alias("x")).first().x == 1.5
    for value, to in ((2.5, "int"), (2.0, "boolean"), (1e12, "int")):
        with pytest.raises(Exception, match="does not fit"):
            spark.createDataFrame([(value,)], "v double").select(num.lossless_cast(F.col("v"), to)).collect()
    with pytest.raises(Exception, match="mean of nothing"):
        spark.sql("SELECT array() AS v").select(num.mean(F.col("v").cast("array<double>"))).collect()
    assert num.is_partition([{1}, {2, 3}], {1, 2, 3}) and not num.is_partition([{1}, {1, 2}], {1, 2})


def test_pull_source_in_batch_and_as_a_stream(spark, tmp_path):
    class Counter(lanes.PullSource):  # inside, so that it is sent to the workers as it is
        chunk = 7

        @classmethod
        def name(cls):
            return "test_counter"

        def pull(self, start, most):
            return [(k % 2, k // 2, k, "NA", float(k), None) for k in range(start, start + most)]

    class Greedy(Counter):
        def pull(self, start, most):
            return [()] * (most + 1)

    spark.dataSource.register(Counter)
    assert sorted(r.time_ms for r in spark.read.format("test_counter").option("rows", 25).load().collect()) == list(range(25))
    seen = []
    stream = spark.readStream.format("test_counter").option("chunk", 5).load()
    query = control.push_to(stream, lambda df, _: seen.extend(r.time_ms for r in df.collect()), str(tmp_path / "ck")).start()
    for _ in range(200):
        if len(seen) >= 10 or not query.isActive:
            break
        query.awaitTermination(0.3)
    query.stop()
    assert seen[:10] == list(range(10))
    with pytest.raises(ValueError):
        Greedy({}).checked(0, 3)


def test_synthetic_lanes_are_seeded_and_whole(spark):
    a, b = (sorted(map(tuple, lanes.synthetic_lanes(spark, 200).collect()), key=str) for _ in range(2))
    assert a == b and len(a) == 800
    assert all((r[4] is None) != (r[5] is None) for r in a)


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Runtime / ms, DataNumber, Error\n60000, 30, 0.5\n120000, 90, 0.25\n")
    df = lanes.read_report_csv(spark, str(tmp_path / "r.csv"), ["Runtime / ms", "DataNumber"], lambda d: d.withColumn("rate", report.throughput(F.col("DataNumber"), F.col("`Runtime / ms`"))))
    assert [r.rate for r in df.orderBy("DataNumber").collect()] == [30, 45]
    (tmp_path / "m.json").write_text(json.dumps({"states": {"a": ["x", "y"], "b": {"z": 1}, "c": []}, "k": {"v": [1, 2]}}))
    assert lanes.count_transitions(spark, str(tmp_path / "m.json")).first()[0] == 3
    assert [r.value for r in lanes.read_json_path(spark, str(tmp_path / "m.json"), ["k", "v"]).collect()] == ["1", "2"]
    for n in ("run_1", "run_2", "other"):
        (tmp_path / n).mkdir()
    assert lanes.experiments(spark, str(tmp_path), "^run_") == ["run_1", "run_2"]
    (tmp_path / "port").write_text("6311\nx")
    assert lanes.int_from_file(str(tmp_path / "port")) == 6311
    log = logging.getLogger("levels")
    control.log_by_level(log, str(tmp_path / "logs"))
    log.debug("d"), log.info("i"), log.error("e")
    assert [(tmp_path / "logs" / f"{n}.log").read_text().strip() for n in ("debug", "info", "warn")] == ["d", "i", "e"]


def test_report_helpers():
    assert report.merged_options({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"x": 3}}) == {"a": {"x": 3, "y": 2}, "b": 1}
    assert report.ticks(0.0, 7.0) == [float(k) for k in range(8)]
    assert report.ticks(1.0, 1.0) == [1.0]


SPEC = {
    "objects": {"k": {"type": "number", "args": {"n": 2}}},
    "nodes": {"src": {"type": "range", "args": {"n": {"ref": "k"}}}, "double": {"type": "times", "args": {"by": 2}}, "join": {"type": "sum"}},
    "edges": {"src": ["double", "join"], "double": ["join"]},
    "chain": ["src", "double", "join"],
}


def test_specs_are_checked_and_folded():
    registry = Registry()
    registry.add("number", lambda n: n)
    registry.add("range", lambda n: lambda: list(range(n)))
    registry.add("times", lambda by: lambda xs: [x * by for x in xs])
    registry.add("sum", lambda: lambda *xs: sum(map(sum, xs)))
    assert Builder(Spec.parse(json.dumps(SPEC)), registry).run() == 3
    for change in ({"edges": {"src": ["double"], "double": ["src"]}}, {"chain": []}, {"objects": {"src": {"type": "number"}}}, {"objects": {"k": {"type": "number", "args": {"n": {"ref": "none"}}}}}):
        with pytest.raises(ValueError):
            Spec.parse(json.dumps(SPEC | change))
    with pytest.raises(KeyError):
        registry.get("os.system")
    assert typed({"a": "12"}, "a", int) == 12 and typed({"a": "true"}, "a", bool) is True
    with pytest.raises(ValueError):
        chain_order(["a", "b", "c"], {"a": ["b"]})


def test_lanes_are_numbered_depth_first():
    edges = {"demux": ["junction"], "junction": ["detectors", "lm"], "detectors": ["f1"], "f1": ["lm"]}
    width = {"demux": 4, "junction": 4, "detectors": 2, "f1": 2, "lm": 4}
    got = lane_numbers(edges, "demux", width)
    assert got[("f1", 0)] == ("lm", 0) and got[("f1", 1)] == ("lm", 1) and got[("junction", 2)] == ("lm", 2) and got[("junction", 3)] == ("lm", 3)


def test_junctions_composites_and_open_chains():
    from streamlanes.plans.graph import Application, Junction, composite

    j = Junction()
    with pytest.raises(ValueError, match="nothing fetches"):
        j(1)
    second = j.second()
    with pytest.raises(ValueError, match="has not run"):
        second()
    with pytest.raises(ValueError, match="fetched already"):
        j.second()
    assert j([1]) == [1] == second()
    calls = []
    assert composite(lambda x: x + 1, lambda x: x * 2, lambda: calls.append(1))(3) == 8 and calls == [1]
    registry = Registry()
    registry.add("source", lambda: lambda: [1, 2])
    registry.add("double", lambda: lambda xs: [2 * x for x in xs])
    registry.add("sum", lambda: sum)
    registry.add("junction", Junction)
    registry.add("second", lambda of: of.second())
    spec = {
        "nodes": {"s": {"type": "source"}, "d": {"type": "double"}, "j": {"type": "junction"}, "t": {"type": "sum"}, "r": {"type": "second", "args": {"of": {"ref": "j"}}}, "u": {"type": "double"}},
        "chains": {"b": {"chain": ["s", "d", "j", "t"], "edges": {"s": ["d"], "d": ["j"], "j": ["t"]}}, "a": {"chain": ["r", "u"], "edges": {"r": ["u"]}}},
    }
    assert Application(json.dumps(spec), registry).run() == {"b": 6, "a": [4, 8]}
    with pytest.raises(ValueError, match="two chains"):
        Application(json.dumps(spec | {"chains": spec["chains"] | {"c": spec["chains"]["a"]}}), registry)
    part = Builder(Spec({}, spec["nodes"], {"d": ["t"]}, ["d", "t"]), registry)
    assert part.run([5, 6]) == 22  # open: what enters is given


def test_streamed_event_scores_are_those_of_the_batch(spark):
    from streamlanes.streaming.scores import EventScores

    rng = random.Random(2)
    rows, want_state = [], 0
    for c in (0, 1):
        truth, found = "NA", "NA"
        for i in range(400):
            truth = rng.choice(["NA", "A", "B"]) if rng.random() < 0.1 else truth
            found = rng.choice(["NA", "MOTIF_BEGIN"]) if rng.random() < 0.12 else "MID_MOTIF" if found != "NA" else "NA"
            rows.append((c, i, i, truth, found))
    df = spark.createDataFrame(rows, "channel long, pos long, time_ms long, label string, detected string")
    want = sorted((r.channel, r.final_at, r.side, r.first, r.is_none, round(r.f1, 9)) for r in metrics.best_f1_events(df).collect())
    got = []
    for c in (0, 1):
        s = EventScores()
        for _, pos, _, truth, found in (r for r in rows if r[0] == c):
            t = EventScores()
            t.restore(s.state())  # as after each micro-batch
            s = t
            got += [(c, pos, side, first, none, round(f1, 9)) for side, first, none, f1 in s.feed(truth, found)]
            want_state = max(want_state, len(s.ended["detected"]) + len(s.ended["true"]))
    assert sorted(got) == want and len(want) > 50 and want_state < 20


def test_event_scores_on_a_stream(spark, tmp_path):
    from streamlanes.streaming.scores import score_stream

    rows = [(0, i, i, "A" if i % 20 < 8 else "NA", "MOTIF_BEGIN" if i % 20 == 1 else "MID_MOTIF" if 1 < i % 20 < 9 else "NA") for i in range(200)]
    df = spark.createDataFrame(rows, "channel long, pos long, time_ms long, label string, detected string")
    for part, (a, b) in enumerate(((0, 90), (90, 200))):
        df.where(f"pos >= {a} AND pos < {b}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = score_stream(stream).writeStream.format("memory").queryName("event_scores").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted((r.side, r.first, r.pos, round(r.f1, 9)) for r in spark.table("event_scores").collect())
    assert got == sorted((r.side, r.first, r.final_at, round(r.f1, 9)) for r in metrics.best_f1_events(df).collect())


def test_a_merge_gives_up_what_waits_too_long():
    from streamlanes.streaming.merge import OrderedMerge

    m = OrderedMerge(2)
    assert m.feed([(0, 0, 5, "a", 1.0), (0, 1, 7, "b", 1.0)]) == []
    assert m.drop_oldest() and [h[2] for h in m.held] == [7]
    assert [r[2] for r in m.feed([(1, 0, 9, "c", 1.0)])] == []
    assert [r[2] for r in m.feed([(0, 2, 10, "d", 1.0), (1, 1, 12, "e", 1.0)])] == [7, 9]
    assert [h[2] for h in m.held] == [10, 12] and m.drop_oldest() and not m.drop_oldest()


def test_configured_lanes_keep_their_limits(spark):
    df = lanes.configured_lanes(spark, 4).cache()
    again = lanes.configured_lanes(spark, 4)
    assert df.exceptAll(again).count() == 0
    rows = df.where("channel = 0").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows))) and all(1 <= b.time_ms - a.time_ms <= 30 for a, b in zip(rows, rows[1:]))
    starts = [r.pos for r in rows if r.label == "MOTIF_BEGIN"]
    assert len(starts) == 8 and all(rows[s + k].label == "MID_MOTIF" for s in starts for k in range(1, 100))
    gaps = [b - a - 100 for a, b in zip(starts, starts[1:])]
    assert all(50 <= g <= 100 for g in gaps[::2]) and all(510 <= g <= 1100 for g in gaps[1::2])
    assert df.where("(value_num IS NULL) = (value_str IS NULL)").count() == 0
    assert df.where("channel = 2 AND label <> 'NA'").count() == 8


def test_streamed_lanes_equal_their_batch_form(spark, tmp_path):
    """Three micro-batches of two sequences, the query started anew for each, against six sequences at once."""
    small = {"gap": (30, 10, 20, 40), "padding": (5, 2, 3, 9), "inside": (6, 2, 4, 9), "motif": (12, 0, 12, 12)}
    for _ in range(3):
        made = lanes.streamed_lanes(spark, 2, distributions=small)
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got, want = (sorted(map(tuple, d.collect()), key=lambda r: r[:2]) for d in (spark.read.schema(lanes.SCHEMA).parquet(f"{tmp_path}/out"), lanes.configured_lanes(spark, 6, distributions=small)))
    assert len(got) > 4 * 6 * 50 and got == want
    assert {k[0] for k in got} == {0, 1, 2, 3} and all(r[4] is None for r in got if r[0] >= 2)


def test_table_functions_in_sql(spark):
    from streamlanes.functions.tabular import register_functions

    register_functions(spark)
    spark.createDataFrame([(3, 2), (9, 1)], "s long, n long").createOrReplaceTempView("found_motifs")
    got = spark.sql("SELECT pos, label FROM found_motifs, LATERAL expand_motif(s, n) ORDER BY pos").collect()
    assert [tuple(r) for r in got] == [(3, "MOTIF_BEGIN"), (4, "MID_MOTIF"), (9, "MOTIF_BEGIN")]
