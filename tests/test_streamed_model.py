"""The sequence model on a stream against the batch operators, also after it was killed between two writes."""

import random

import pytest
from pyspark.sql import functions as F

from streamlanes.operators import langmodel
from streamlanes.streaming import model
from streamlanes.streaming.model import StreamedModel, run_model

SCHEMA = "time_ms long, channel long, pos long, label string"
OPTIONS = {"numeric": 1, "timeout_ms": 12, "history": 4, "last": 7}


def elements(n, seed=3):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 2, 5, 20])
        channel = rng.choice([0, 1, 2])
        label = rng.choices(["NA", "MOTIF_BEGIN", "MID_MOTIF"] if channel == 0 else ["NA", "a", "b"], [0.6, 0.25, 0.15])[0]
        rows.append((t, channel, i, label))
    return sorted(rows)


def batch_rows(spark, rows):
    stream = spark.createDataFrame(rows, SCHEMA)
    states = langmodel.with_states(langmodel.sessions(stream, 1, 12), 4)
    counted = langmodel.rolling_errors(langmodel.predictions(states), 1, 7).join(langmodel.model_sizes(states), "seq")
    return shown(counted)


def shown(df):
    return sorted(tuple(r) for r in df.select("seq", "time_ms", "channel", "word", "session", "state", F.coalesce("predicted", F.lit("-")), F.round("error", 6), F.coalesce(F.round("char_error", 6), F.lit(-1.0)), "n_states", "n_transitions").collect())


def test_micro_batches_give_what_one_batch_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(model, "TOGETHER", 2)  # counts are put together in between
    rows = elements(260)
    want = batch_rows(spark, rows)
    cuts = [0, 40, 41, 130, 200, 260]
    kill = {(3, "line"), (2, "tail"), (4, "counts")}
    write = StreamedModel._write

    def killed(self, df, name, batch_id):
        if (batch_id, name) in kill:
            kill.discard((batch_id, name))
            raise RuntimeError("killed")
        return write(self, df, name, batch_id)

    monkeypatch.setattr(StreamedModel, "_write", killed)
    starts = 0
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(3):  # restarted until it has taken what is there
            starts += 1
            query = run_model(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "model"), **OPTIONS).trigger(availableNow=True).start()
            try:
                assert query.awaitTermination(180)
                break
            except Exception as e:
                assert "killed" in str(e)
    assert not kill and starts == len(cuts) - 1 + 3
    streamed = StreamedModel(spark, str(tmp_path / "model"), **OPTIONS)
    assert shown(streamed.results()) == want and len(want) > 60
    states = langmodel.with_states(langmodel.sessions(spark.createDataFrame(rows, SCHEMA), 1, 12), 4)
    assert sorted(map(tuple, streamed.counts().collect())) == sorted(map(tuple, langmodel.transition_counts(states).collect()))


def test_batches_without_words_or_rows_and_late_elements(spark, tmp_path):
    streamed = StreamedModel(spark, str(tmp_path / "model"), **OPTIONS)
    quiet = [(t, 1, t, "NA") for t in range(100, 140)]
    batches = [[], [(1, 1, 0, "NA")], [(5, 1, 1, "a"), (6, 2, 2, "b")], [], quiet[:20], quiet[20:], [(150, 1, 200, "a")]]
    for k, rows in enumerate(batches):
        streamed(spark.createDataFrame(rows, SCHEMA), k)
    assert shown(streamed.results()) == batch_rows(spark, [x for b in batches for x in b])
    with pytest.raises(ValueError, match="before those seen"):
        streamed(spark.createDataFrame([(3, 0, 0, "NA")], SCHEMA), len(batches))


def test_states_are_counted_and_ordered_by_their_keys(spark, tmp_path, monkeypatch):
    written = []

    def noted(df):
        written.append(df.columns)
        return staged(df)

    staged = langmodel.staged
    monkeypatch.setattr(langmodel, "staged", noted)
    monkeypatch.setattr(model, "staged", noted)
    rows = elements(120)
    streamed = StreamedModel(spark, str(tmp_path / "model"), **OPTIONS)
    for k in range(2):
        written.clear()
        streamed(spark.createDataFrame(rows[60 * k : 60 * k + 60], SCHEMA), k)
        assert sum("state" in columns for columns in written) == 1  # once, before anything is counted
    written.clear()
    states = langmodel.with_states(langmodel.sessions(spark.createDataFrame(rows, SCHEMA), 1, 12), 4)
    langmodel.predictions(states)
    langmodel.model_sizes(states)
    assert sum("state" in columns for columns in written) == 1
    assert shown(streamed.results()) == batch_rows(spark, rows)


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_both_sinks_hold_each_row_once_after_a_kill_between_them(spark, tmp_path, monkeypatch, form):
    from streamlanes.streaming.control import FanOut, fan_out

    kill, write = {(0, "second"), (1, "first")}, FanOut._write

    def killed(self, df, name, batch_id):
        if (batch_id, name) in kill:
            kill.discard((batch_id, name))
            raise RuntimeError("killed")
        return write(self, df, name, batch_id)

    monkeypatch.setattr(FanOut, "_write", killed)
    outputs = {"first": lambda df: df, "second": lambda df: df.where("v % 2 = 0").withColumn("v", F.col("v") * 10)}
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).withColumnRenamed("id", "v").write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            try:
                query = fan_out(spark.readStream.schema("v long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), outputs, form).trigger(availableNow=True).start()
                assert query.awaitTermination(120)
                break
            except Exception as e:
                assert "killed" in str(e)
    assert not kill
    held = FanOut(spark, str(tmp_path / "out"), outputs, form)
    assert sorted(r.v for r in held.read("first", "v long").collect()) == list(range(30))
    assert sorted(r.v for r in held.read("second", "v long").collect()) == [10 * v for v in range(0, 30, 2)]
