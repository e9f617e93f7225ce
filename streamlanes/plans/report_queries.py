"""Queries over report files, sources and the application's spec, and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import langmodel, profile, report, reports
from ..operators.ordering import PART, in_parts
from ..operators.staging import shared_path, staged
from ..sources import lanes
from ..streaming.control import FanOut, fan_out
from ..streaming.model import StreamedModel, run_model
from . import registry as r
from .application import SPEC, operators
from .graph import Application

CLOCK = "printf('%02d:%02d:%02d:%03d', {0} // 3600000, {0} % 3600000 // 60000, {0} % 60000 // 1000, {0} % 1000)"
TIMES = f"""time_ms - start AS "Runtime / ms", {CLOCK.format('(time_ms - start)')} AS "Runtime HH:mm:ss:SSS", time_ms AS "Timestamp / ms", {CLOCK.format('time_ms')} AS "Timestamp HH:mm:ss:SSS\""""
ERRORS = r.WORDS + f""", flags AS (SELECT *, CASE WHEN guess IS NULL OR guess <> word THEN 1 ELSE 0 END AS wrong, channel >= 2 OR coalesce(CAST(split_part(guess, ':', 1) AS BIGINT), -1) >= 2 AS is_char FROM predicted),
chars AS (SELECT seq, sum(wrong) OVER w AS cw, count(*) OVER w AS cn FROM flags WHERE is_char WINDOW w AS (ORDER BY seq ROWS BETWEEN {r.ERRORS - 1} PRECEDING AND CURRENT ROW)),
firsts AS (SELECT seq, row_number() OVER (PARTITION BY state ORDER BY seq) = 1 AS s, row_number() OVER (PARTITION BY state, word ORDER BY seq) = 1 AS t FROM states),
counts AS (SELECT f.seq, f.time_ms, (SELECT min(time_ms) FROM labelled) AS start, sum(f.wrong) OVER w AS wn, count(*) OVER w AS n,
  coalesce(last_value(c.cw IGNORE NULLS) OVER a, 0) AS cw, coalesce(last_value(c.cn IGNORE NULLS) OVER a, 0) AS cn, sum(CASE WHEN f.is_char THEN 1 ELSE 0 END) OVER a - CASE WHEN f.is_char THEN 1 ELSE 0 END AS earlier,
  sum(CASE WHEN x.s THEN 1 ELSE 0 END) OVER a AS n_states, sum(CASE WHEN x.t THEN 1 ELSE 0 END) OVER a AS n_moves
  FROM flags f LEFT JOIN chars c USING (seq) JOIN firsts x USING (seq)
  WINDOW w AS (ORDER BY f.seq ROWS BETWEEN {r.ERRORS - 1} PRECEDING AND CURRENT ROW), a AS (ORDER BY f.seq ROWS UNBOUNDED PRECEDING))"""


def _predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    stream = lanes.labelled_lanes(spark, sf_dir)
    states = langmodel.with_states(langmodel.sessions(stream, r.NUMERIC, r.IDLE_MS), r.HISTORY)
    return langmodel.predictions(states), reports.start_of(stream)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


@r.query(ERRORS + f""" SELECT {TIMES}, seq + 1 AS "DataNumber", CAST(n - wn AS DOUBLE) AS "#Correct", CAST(wn AS DOUBLE) AS "#Incorrect", round(wn / n, 6) AS "Error", CAST(earlier + 1 AS BIGINT) AS "CharacterDataNumber",
CAST(cn - cw AS DOUBLE) AS "#CharCorrect", CAST(cw AS DOUBLE) AS "#CharIncorrect", CASE WHEN cw = 0 THEN 0.0 ELSE round(cw / cn, 6) END AS "CharacterError", CAST(n_states AS INTEGER) AS "NumLMStates", CAST(n_moves AS INTEGER) AS "NumLMTransitions" FROM counts""")
def lm_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted, start = _predicted(spark, sf_dir)
    return _rounded(reports.error_report(predicted, start, r.NUMERIC, r.ERRORS))


@r.query(ERRORS + """ SELECT (time_ms - start) / 1000.0 AS seconds, seq + 1 AS number, round(CASE WHEN time_ms = start THEN NULL ELSE (seq + 1) * 60000.0 / (time_ms - start) END, 3) AS per_minute FROM counts""")
def lm_error_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error report as a file, of which two columns are read back and turned into a throughput."""
    predicted, start = _predicted(spark, sf_dir)
    path = shared_path(spark, f"report-{uuid.uuid4().hex}")
    reports.write_report(reports.error_report(predicted, start, r.NUMERIC, r.ERRORS), path)
    ms, number = F.col("`Runtime / ms`"), F.col("DataNumber").cast("long")
    rate = F.round(report.throughput(number, ms), 3).alias("per_minute")
    return lanes.read_report_csv(spark, path, ["Runtime / ms", "DataNumber"], lambda df: report.sorted_by(df, ["DataNumber"]).select((ms / 1000.0).alias("seconds"), number.alias("number"), rate))


@r.query(r.WORDS + " SELECT count(*) AS n_transitions FROM (SELECT DISTINCT state, word FROM states)")
def model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model as JSON files, whose transitions are counted as the evaluator does."""
    states = langmodel.with_states(langmodel.sessions(lanes.labelled_lanes(spark, sf_dir), r.NUMERIC, r.IDLE_MS), r.HISTORY)
    path = shared_path(spark, f"model-{uuid.uuid4().hex}")
    reports.dump_model(langmodel.transition_counts(states), path)
    return lanes.count_transitions(spark, path, lines=True)


_SCORES = ("PrecisionPositives = TP / (TP + FP)", "RecallPositives = TP / (TP + FN)", "F1Positives = Harm_Mean(PrecisionPositives, RecallPositives)", "PrecisionNegatives = TN / (TN + FN)",
           "RecallNegatives = TN / (TN + FP)", "F1Negatives = Harm_Mean(PrecisionNegatives, RecallNegatives)", "F1 = Harm_Mean(F1Positives, F1Negatives)")
_SHORT = ("pos_precision", "pos_recall", "pos_f1", "neg_precision", "neg_recall", "neg_f1", "overall_f1")


def _scored(source: str, extra: str, names) -> str:
    shown = ", ".join(f'round({a}, 6) AS "{b}"' for a, b in zip(_SHORT, names, strict=True))
    return f"SELECT {TIMES}, {extra}, {shown} FROM (SELECT *, {r.SCORES} FROM (SELECT *, {r._F1.format('p')}, {r._F1.format('n')} FROM ({source})))"


_PART = lambda a, b: f"CASE WHEN {a} = 0 THEN 0.0 ELSE {a} / ({a} + {b}) END"


@r.query(r.OUTCOMES + """, t AS (SELECT time_ms, (SELECT min(time_ms) FROM points) AS start, row_number() OVER w - 1 AS k, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(c) OVER w AS tn, sum(d) OVER w AS fn
  FROM o WINDOW w AS (ORDER BY time_ms, channel, pos ROWS UNBOUNDED PRECEDING)) """ + _scored(f"SELECT *, {_PART('tp', 'fp')} AS pp, {_PART('tp', 'fn')} AS pr, {_PART('tn', 'fn')} AS np, {_PART('tn', 'fp')} AS nr FROM t", 'k AS "DataNumber"', _SCORES))
def point_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = r._points(spark, sf_dir)
    return _rounded(reports.point_report(points, reports.start_of(points)))


FINAL = r.EVENTS + """, d AS (SELECT * FROM (SELECT *, event < max(event) OVER (PARTITION BY channel) AS closed FROM d_all) WHERE closed), t AS (SELECT * FROM (SELECT *, event < max(event) OVER (PARTITION BY channel) AS closed FROM t_all) WHERE closed),
f AS (SELECT d.channel, d.first AS df, d.last AS dl, t.first AS tf, t.last AS tl, CASE WHEN (d.label = 'NA') = (t.label = 'NA') THEN 2.0 * (least(d.last, t.last) - greatest(d.first, t.first) + 1) / (d.last - d.first + 1 + t.last - t.first + 1) ELSE 0.0 END AS f
  FROM d JOIN t ON d.channel = t.channel AND d.first <= t.last AND t.first <= d.last),
done AS (
  SELECT 'd' AS side, d.channel, d.label = 'NA' AS quiet, coalesce(max(f), 0.0) AS f, greatest(d.last, coalesce(max(tl), d.last)) + 1 AS pos FROM d LEFT JOIN f ON f.channel = d.channel AND f.df = d.first
    WHERE d.last <= (SELECT max(last) FROM t WHERE t.channel = d.channel) GROUP BY d.channel, d.first, d.last, d.label
  UNION ALL SELECT 't', t.channel, t.label = 'NA', coalesce(max(f), 0.0), greatest(t.last, coalesce(max(dl), t.last)) + 1 FROM t LEFT JOIN f ON f.channel = t.channel AND f.tf = t.first
    WHERE t.last <= (SELECT max(last) FROM d WHERE d.channel = t.channel) GROUP BY t.channel, t.first, t.last, t.label
),
timed AS (SELECT time_ms, channel, pos, side, quiet, f FROM done JOIN points USING (channel, pos)),
moments AS (SELECT time_ms, channel, pos, """ + ", ".join(f"count(CASE WHEN side = '{s}' AND {q} THEN 1 END) AS n_{s}{k}, coalesce(sum(CASE WHEN side = '{s}' AND {q} THEN f END), 0.0) AS s_{s}{k}" for s in "dt" for k, q in (("p", "NOT quiet"), ("n", "quiet"))) + """ FROM timed GROUP BY ALL),
upto AS (SELECT time_ms, channel, pos, (SELECT min(time_ms) FROM points) AS start, row_number() OVER w - 1 AS k, """ + ", ".join(f"sum({x}_{s}{k}) OVER w AS {x}_{s}{k}" for x in "ns" for s in "dt" for k in "pn") + """
  FROM moments WINDOW w AS (ORDER BY time_ms, channel, pos ROWS UNBOUNDED PRECEDING))"""


@r.query(FINAL + " " + _scored("SELECT *, " + ", ".join(f"CASE WHEN n_{s}{k} = 0 THEN 0.0 ELSE s_{s}{k} / n_{s}{k} END AS {n}" for s, k, n in (("d", "p", "pp"), ("t", "p", "pr"), ("d", "n", "np"), ("t", "n", "nr"))) + " FROM upto", 'k AS "DataNumber"', reports.EVENT_COLUMNS[5:]))
def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = r._points(spark, sf_dir)
    return _rounded(reports.event_report(points, reports.start_of(points)))


@r.query(r.LANES + """ SELECT event_id AS "Data ID:", CAST(0 AS BIGINT) AS "Source transmitter ID:", channel AS "DemuxTransmitterTask index:", channel + 100 AS "Transceiver ID:", channel AS "MuxReceiverTask index:", CAST(999 AS BIGINT) AS "Target receiver ID:" FROM lanes""")
def provenance_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, f"provenance-{uuid.uuid4().hex}")
    reports.write_report(reports.provenance_report(r.provenance_map(spark, sf_dir)), path)
    return lanes.read_report_csv(spark, path).select(*[F.col(f"`{c}`").cast("long").alias(c) for c in reports.PROVENANCE_COLUMNS])


@r.query(r._taps_sql(r.PATTERN).replace("round(y, 4)", "round(0.5 * y + 2.0, 4)"))
def scaled_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.tap_filter(lanes.event_lanes(spark, sf_dir), r.PATTERN, 0.5, 2.0).select("channel", "pos", *r.r4("y"))


def _smoothed_sql(taps) -> str:
    raw = r._profile_ctes([r.M]).replace("round(least(", "(least(").replace(", 6) AS d", ") AS d")
    dot = " + ".join(f"lead(d, {k}) OVER w * CAST({float(t)!r} AS DOUBLE)" for k, t in enumerate(taps))
    return raw + f" SELECT channel, m, i, round(y, 4) AS d, n - {len(taps) - 1} AS n FROM (SELECT *, {dot} AS y FROM prof WINDOW w AS (PARTITION BY channel, m ORDER BY i)) WHERE y IS NOT NULL"


@r.query(_smoothed_sql(num.gauss_kernel(3 * r.M, r.M / 2)))
def smoothed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.profiles(lanes.event_lanes(spark, sf_dir), [r.M], mode="GAUSS", digits=9)
    return found.select("channel", "m", "i", F.round("d", 4).alias("d"), "n")


@r.query(r.LANES + f""", g AS (SELECT channel * 1000000 + pos // 24 AS grp, list(value ORDER BY pos) AS v, count(*) AS n FROM lanes GROUP BY channel, pos // 24),
lens AS (SELECT grp, v, n, m FROM g, (SELECT unnest([8, 12, 40]) AS m) WHERE m <= n - 1
  UNION ALL SELECT grp, v, n, n - 1 FROM g WHERE n - 1 >= 2 AND n <= 40 AND n NOT IN (9, 13)),
wins AS (SELECT grp, n, m, i, v[i + 1 : i + m] AS w FROM (SELECT *, unnest(range(0, n - m + 1)) AS i FROM lens)),
stats AS (SELECT *, list_avg(w) AS mu, list_var_pop(w) AS s2 FROM wins),
best AS (SELECT a.grp, a.m, a.i, a.n, min(1 - (list_dot_product(a.w, b.w) / a.m - a.mu * b.mu) / sqrt(CASE WHEN a.s2 <= 0 THEN 1e-4 ELSE a.s2 END * CASE WHEN b.s2 <= 0 THEN 1e-4 ELSE b.s2 END)) AS d
  FROM stats a JOIN stats b ON a.grp = b.grp AND a.m = b.m AND a.i <> b.i GROUP BY ALL)
SELECT grp AS channel, m, i, round(least(2.0, greatest(0.0, d)), 4) AS d, n - m + 1 AS n FROM best""")
def length_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of lanes of 24 elements at lengths of which the longest does not fit: it falls back to the longest that does."""
    short = lanes.event_lanes(spark, sf_dir).select((F.col("channel") * 1_000_000 + F.expr("pos div 24")).alias("channel"), (F.col("pos") % 24).alias("pos"), "value")
    found = profile.profiles(short, [8, 12, 40], zone_factor=0.0, digits=9)
    return found.select("channel", "m", "i", F.round("d", 4).alias("d"), "n")


@r.query("SELECT CAST(7 AS BIGINT) AS source_id, CAST(i % 5 AS BIGINT) AS channel, CAST(i AS BIGINT) AS data_id FROM range(1000) t(i)")
def counter_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pull source that is polled lane by lane: it reads no table."""
    spark.dataSource.register(lanes.CounterSource)
    return spark.read.format("lanes_counter").option("rows", 1000).option("source", 7).option("lanes", 5).load()


@r.query("SELECT user_id, round_even(value, 1) AS value FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT user_id, round_even(value * 2, 1) FROM events WHERE event_type NOT IN ('click', 'view')")
def concatenated_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id", "value")
    some = F.col("event_type").isin("click", "view")
    both = report.concatenated([e.where(some).select("user_id", "value"), e.where(~some).select("user_id", (F.col("value") * 2).alias("value"))])
    return report.sorted_by(both, ["user_id", "value"]).select("user_id", report.rounded(F.col("value"), 1).alias("value"))


#: Back-off: suffixes of up to so many words, and what each word counts more.
LONGEST, SMOOTHING = 6, 0.5


@r.query(r.WORDS + f""", parts AS (SELECT *, CASE WHEN state = '' THEN [] ELSE string_split(state, ' ') END AS ws FROM states),
cuts AS (SELECT seq, session, word, k, array_to_string(ws[len(ws) - k + 1:], ' ') AS suffix FROM (SELECT *, unnest(range(0, least(len(ws), {LONGEST}) + 1)) AS k FROM parts)),
idx AS (SELECT k, suffix, word, count(*) AS n FROM cuts WHERE session % 2 = 0 GROUP BY ALL), totals AS (SELECT k, suffix, sum(n) AS total FROM idx GROUP BY ALL),
vocabulary AS (SELECT count(DISTINCT word) AS size FROM states WHERE session % 2 = 0),
best AS (SELECT seq, word, max(k) AS k, arg_max(suffix, k) AS suffix, arg_max(total, k) AS total FROM (SELECT c.*, t.total FROM cuts c JOIN totals t USING (k, suffix) WHERE c.session % 2 = 1) GROUP BY seq, word)
SELECT b.seq, b.word, CAST(b.k AS INTEGER) AS k, CAST(coalesce(i.n, 0) AS BIGINT) AS n, CAST(b.total AS BIGINT) AS total, round((coalesce(i.n, 0) + {SMOOTHING}) / (b.total + {SMOOTHING} * (SELECT size FROM vocabulary)), 6) AS p
FROM best b LEFT JOIN idx i ON i.k = b.k AND i.suffix = b.suffix AND i.word = b.word""")
def smoothed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every second session by a model of the others: their states are new and back off to known suffixes."""
    states = staged(langmodel.with_states(langmodel.sessions(lanes.labelled_lanes(spark, sf_dir), r.NUMERIC, r.IDLE_MS), r.HISTORY))
    seen = states.where("session % 2 = 0")
    index = langmodel.suffix_index(seen, LONGEST)
    found = langmodel.smoothed_lookup(states.where("session % 2 = 1").select("seq", "state", "word"), index, smoothing=SMOOTHING, n_words=seen.select("word").distinct().count(), longest=LONGEST)
    return found.select("seq", "word", "k", "n", "total", F.round("p", 6).alias("p"))


@r.query(r.WORDS.replace("WITH kinds", "WITH RECURSIVE kinds", 1) + """, ends AS (SELECT session, arg_max(word, seq) AS word FROM sess GROUP BY session), idles AS (SELECT count(*) AS n FROM fired),
pairs AS (SELECT coalesce(lag(word) OVER (PARTITION BY session ORDER BY seq), 'idle') AS state, word FROM sess UNION ALL SELECT word, 'idle' FROM ends WHERE session < (SELECT n FROM idles)),
open_moves AS (SELECT state, word, count(*) AS n FROM pairs GROUP BY ALL),
ahead(node) AS (SELECT 'idle' UNION SELECT m.word FROM ahead a JOIN open_moves m ON m.state = a.node),
behind(node) AS (SELECT 'idle' UNION SELECT m.state FROM behind a JOIN open_moves m ON m.word = a.node),
nodes AS (SELECT state AS node FROM open_moves UNION SELECT word FROM open_moves UNION SELECT 'idle'),
apart AS (SELECT count(*) AS n FROM nodes WHERE node NOT IN (SELECT node FROM ahead) OR node NOT IN (SELECT node FROM behind)),
closing AS (SELECT arg_max(word, session) AS state, 'idle' AS word, 1 AS n FROM ends HAVING max(session) >= (SELECT n FROM idles) AND (SELECT n FROM apart) > 0),
moves AS (SELECT state, word, sum(n) AS n FROM (SELECT * FROM open_moves UNION ALL SELECT * FROM closing) GROUP BY ALL),
shares AS (SELECT state, word, n / sum(n) OVER (PARTITION BY state) AS p FROM moves),
walk(step, node, weight) AS (SELECT 0, node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) FROM nodes
  UNION ALL SELECT step + 1, node, sum(weight) FROM (SELECT w.step, w.node, w.weight / 2 AS weight FROM walk w UNION ALL SELECT w.step, s.word, w.weight * s.p / 2 FROM walk w JOIN shares s ON s.state = w.node) WHERE step < 200 GROUP BY step, node),
own AS (SELECT state, 1 - max(p) AS error, -sum(p * log2(p)) AS bits FROM shares GROUP BY state)
SELECT (SELECT count(*) FROM nodes) AS n_states, (SELECT state FROM closing) AS closed, round(sum(weight * error), 6) AS min_error, round(sum(weight * bits), 6) AS entropy_rate, round(pow(2, sum(weight * bits)), 6) AS perplexity_rate
FROM walk JOIN own ON own.state = walk.node WHERE step = 200""")
def finished_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-1 model of all words, closed by a move to idle where it must be, and its rates."""
    stream = lanes.labelled_lanes(spark, sf_dir)
    events, idles = staged(langmodel.sessions(stream, r.NUMERIC, r.IDLE_MS)), staged(langmodel.idle_timeouts(stream, r.NUMERIC, r.IDLE_MS))
    moves = staged(langmodel.order_one_moves(events, idles))
    current = langmodel.current_state(events, idles)
    finished = staged(langmodel.finish_moves(moves, current))
    closed = None if finished.agg(F.sum("n")).first()[0] == moves.agg(F.sum("n")).first()[0] else current
    return langmodel.model_rates(finished).select("n_states", F.lit(closed).cast("string").alias("closed"), *_six("min_error", "entropy_rate", "perplexity_rate"))


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@r.query(r.ORACLES["junction_fanout"])
def streamed_junction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The junction on a stream of two micro-batches: sums of each output's batches, put together from what both sinks hold."""
    rows = lanes.labelled_lanes(spark, sf_dir).select("channel", "pos", "value", "label")
    folder, schema = shared_path(spark, f"junction-{uuid.uuid4().hex}"), "channel long, pos long, value double, label string"
    values = lambda df: df.where("channel < 2").groupBy("channel").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    labels = lambda df: df.groupBy("channel").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") != "NA", 1)).cast("double").alias("total"))
    outputs = {"values": values, "labels": labels}
    for k in range(2):
        rows.where(F.expr(f"pos div 1000 % 2 = {k}")).select(*[F.col(c).cast(t) for c, t in (x.split() for x in schema.split(", "))]).write.mode("append").parquet(f"{folder}/in")
        fan_out(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", outputs).trigger(availableNow=True).start().awaitTermination()
    held = FanOut(spark, f"{folder}/out", outputs)
    sums = lambda name, total: held.read(name).groupBy("channel").agg(F.sum("n").alias("n"), total.alias("total")).select(F.lit(name).alias("output"), "channel", "n", "total")
    return sums("values", F.round(F.sum("total"), 4)).unionByName(sums("labels", F.sum("total")))


@r.query(ERRORS + """ SELECT seq, CAST(session AS BIGINT) AS session, word, guess AS predicted, round(wn / n, 4) AS error, CASE WHEN cn > 0 THEN round(cw / cn, 4) END AS char_error, CAST(n_states AS BIGINT) AS n_states, CAST(n_moves AS BIGINT) AS n_transitions
FROM counts JOIN predicted USING (seq)""")
def streamed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence model on a stream of four micro-batches, the query stopped and started again between them."""
    rows = in_parts(lanes.labelled_lanes(spark, sf_dir).select(*langmodel.MERGED, "label"), langmodel.MERGED)
    folder, schema = shared_path(spark, f"streamed-{uuid.uuid4().hex}"), "time_ms long, channel long, pos long, label string"
    parts = (rows.agg(F.max(PART)).first()[0] or 0) + 1
    for k in range(4):
        rows.where(F.expr(f"{PART} * 4 div {parts} = {k}")).select(*[F.col(c).cast(t) for c, t in (x.split() for x in schema.split(", "))]).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        run_model(stream, f"{folder}/model", numeric=r.NUMERIC, timeout_ms=r.IDLE_MS, history=r.HISTORY, last=r.ERRORS).trigger(availableNow=True).start().awaitTermination()
    found = StreamedModel(spark, f"{folder}/model", numeric=r.NUMERIC, timeout_ms=r.IDLE_MS, history=r.HISTORY, last=r.ERRORS).results()
    return found.select("seq", "session", "word", "predicted", *r.r4("error", "char_error"), "n_states", "n_transitions")


@r.query(r.LANES + " SELECT channel, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT pos) AS places, max(pos) AS last_pos FROM lanes GROUP BY channel")
def streamed_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events beside the elements that a synthetic stream, stopped and started again between micro-batches, has at their places.

    The stream is as long as the longest lane, so each event meets one element, if places have no gap and none is twice.
    """
    events = staged(lanes.event_lanes(spark, sf_dir).select("channel", "pos", "value"))
    longest, channels = events.agg(F.max("pos"), F.max("channel")).first()
    least = sum(lanes.DISTRIBUTIONS[k][2] for k in ("gap", "motif", "inside", "motif", "padding"))
    batches, folder = 3, shared_path(spark, f"synthetic-{uuid.uuid4().hex}")
    per_batch = -(-((longest or 0) + 1) // (batches * int(least)))
    for _ in range(batches):
        made = lanes.streamed_lanes(spark, per_batch, numeric=2, words=max(0, (channels or 0) - 1))
        made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    met = events.join(spark.read.schema(lanes.SCHEMA).parquet(f"{folder}/out").select("channel", "pos", F.col("label").alias("made")), ["channel", "pos"])
    return met.groupBy("channel").agg(F.count("made").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("pos").alias("places"), F.max("pos").alias("last_pos"))


# The application's oracle puts the other queries' parts together: motifs found, labels and words merged, errors and scores.
_FOUND = r._candidate_ctes().replace("states AS (", "opened AS (").replace("FROM states WHERE", "FROM opened WHERE") + """,
seen AS (SELECT l.*, CASE WHEN l.pos % 48 = 16 THEN 'MOTIF_BEGIN' WHEN l.pos % 48 BETWEEN 17 AND 31 THEN 'MID_MOTIF' ELSE 'NA' END AS truth,
  CASE WHEN b.start IS NULL THEN 'NA' WHEN l.pos = b.buffer * 10000 + b.start THEN 'MOTIF_BEGIN' ELSE 'MID_MOTIF' END AS detected
  FROM lanes l LEFT JOIN best b ON l.channel = b.channel AND l.pos BETWEEN b.buffer * 10000 + b.start AND b.buffer * 10000 + b.start + b.length - 1),
labelled AS (SELECT channel, pos, time_ms, event_id, value, event_type, CASE WHEN channel < 2 THEN detected WHEN value > 150.0 THEN event_type ELSE 'NA' END AS label FROM seen),
points AS (SELECT channel, pos, time_ms, truth AS label, detected FROM seen WHERE channel < 2)"""
_EVENT_CTES, _EVENT_SELECT = r.ORACLES["event_f1"][len(r.POINTS) :].rsplit("\nSELECT round(", 1)
_ERROR_CTES, _ERROR_SELECT = r.ORACLES["rolling_error"][len(r.LABELLED) :].rsplit("\nSELECT f.seq", 1)


@r.query(_FOUND + _ERROR_CTES + _EVENT_CTES + f"""
SELECT 'errors' AS sink, x.seq AS n, x.error AS a, x.char_error AS b FROM (SELECT f.seq{_ERROR_SELECT}) x
UNION ALL SELECT 'scores', 0, y.pos_f1, y.neg_f1 FROM (SELECT round({_EVENT_SELECT}) y""")
def application_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application's JSON spec, run as it stands: the outputs of both its chains."""
    out = Application(SPEC, operators(spark, sf_dir)).run()
    errors = out["errors"].select(F.lit("errors").alias("sink"), F.col("seq").alias("n"), F.round("error", 4).alias("a"), F.round("char_error", 4).alias("b"))
    return errors.unionByName(out["scores"].select(F.lit("scores").alias("sink"), F.lit(0).cast("long").alias("n"), F.round("pos_f1", 4).alias("a"), F.round("neg_f1", 4).alias("b")))
