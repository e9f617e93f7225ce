"""Queries of the streaming-analytics operators over the events table, and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import langmodel, metrics, motifs, profile, report, routing
from ..operators.detector import detect_by_parts
from ..operators.staging import shared_path, staged
from ..sources import lanes

FLAGSHIP = "motif_labels"
QUERIES: dict = {}
ORACLES: dict = {}

NUMERIC, IDLE_MS, HISTORY, ERRORS = 2, 600_000, 100, 100
LENGTHS, LO, HI = (12, 16, 20), 0.08, 0.16
CHUNK, M = 100, 16

LANES = """WITH kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS channel FROM (SELECT DISTINCT event_type FROM events)),
lanes AS (SELECT CAST(k.channel AS BIGINT) AS channel, row_number() OVER (PARTITION BY k.channel ORDER BY e.ts, e.event_id) - 1 AS pos,
  epoch_us(e.ts) // 1000 AS time_ms, e.event_id, e.value, e.event_type FROM events e JOIN kinds k USING (event_type))"""
LABELLED = LANES + """,
labelled AS (SELECT *, CASE WHEN channel < 2 THEN CASE WHEN pos % 48 = 16 THEN 'MOTIF_BEGIN' WHEN pos % 48 BETWEEN 17 AND 31 THEN 'MID_MOTIF' ELSE 'NA' END
  ELSE CASE WHEN value > 150.0 THEN event_type ELSE 'NA' END END AS label FROM lanes)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r4(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


@query(LANES + " SELECT channel, count(*) AS n, min(time_ms) AS first_ms, max(time_ms) AS last_ms, round(sum(value), 4) AS total FROM lanes GROUP BY channel")
def demux_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = lanes.event_lanes(spark, sf_dir)
    sums = [F.count("*").alias("n"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"), F.round(F.sum("value"), 4).alias("total")]
    return routing.each_lane(stream, sums)


@query("SELECT event_id, CAST(event_id % 5 AS BIGINT) AS channel FROM events")
def round_robin_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.round_robin(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), "event_id", 5)


@query(LANES + f" SELECT event_id, channel, pos, row_number() OVER (ORDER BY pos // {CHUNK}, channel, pos) - 1 AS seq FROM lanes")
def mux_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.sequential_mux(lanes.event_lanes(spark, sf_dir), CHUNK).select("event_id", "channel", "pos", "seq")


@query(LANES + " SELECT event_id, channel, pos, row_number() OVER (ORDER BY time_ms, channel, pos) - 1 AS seq FROM lanes")
def mux_time_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.time_merge(lanes.event_lanes(spark, sf_dir)).select("event_id", "channel", "pos", "seq")


@query(LANES + " SELECT event_id, channel, time_ms FROM lanes WHERE time_ms <= (SELECT min(m) FROM (SELECT max(time_ms) AS m FROM lanes GROUP BY channel))")
def mux_sync_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.sync_prefix(lanes.event_lanes(spark, sf_dir)).select("event_id", "channel", "time_ms")


@query(LABELLED + """ SELECT 'values' AS output, channel, count(*) AS n, round(sum(value), 4) AS total FROM labelled WHERE channel < 2 GROUP BY channel
UNION ALL SELECT 'labels', channel, count(*), CAST(count(CASE WHEN label <> 'NA' THEN 1 END) AS DOUBLE) FROM labelled GROUP BY channel""")
def junction_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = routing.tee(lanes.labelled_lanes(spark, sf_dir))
    values = a.where("channel < 2").groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    labels = b.groupBy("channel").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") != "NA", 1)).cast("double").alias("total"))
    return values.select(F.lit("values").alias("output"), "*").unionByName(labels.select(F.lit("labels").alias("output"), "*"))


@query(LANES + " SELECT event_id AS data_id, CAST(0 AS BIGINT) AS source_id, channel AS demux_index, channel + 100 AS transceiver_id, channel AS mux_index, CAST(999 AS BIGINT) AS target_id FROM lanes")
def provenance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = routing.with_provenance(routing.with_provenance(lanes.event_lanes(spark, sf_dir), 0, "source_id"), 999, "target_id")
    return out.select(F.col("event_id").alias("data_id"), "source_id", F.col("channel").alias("demux_index"), (F.col("channel") + 100).alias("transceiver_id"), F.col("channel").alias("mux_index"), "target_id")


@query(LANES + f""" SELECT channel, pos, round(mean, 6) AS mean, round(var + 1e-9, 4) AS var FROM (SELECT channel, pos, avg(value) OVER w AS mean, var_pop(value) OVER w AS var, count(*) OVER w AS k
FROM lanes WINDOW w AS (PARTITION BY channel ORDER BY pos ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING)) WHERE k = {M}""")
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rolling_stats(lanes.event_lanes(spark, sf_dir), M).select("channel", "pos", F.round("mean", 6).alias("mean"), F.round(F.col("var") + 1e-9, 4).alias("var"))


def _taps_sql(taps) -> str:
    dot = " + ".join(f"lead(value, {k}) OVER w * CAST({float(t)!r} AS DOUBLE)" for k, t in enumerate(taps))
    return LANES + f" SELECT channel, pos, round(y, 4) AS y FROM (SELECT channel, pos, {dot} AS y FROM lanes WINDOW w AS (PARTITION BY channel ORDER BY pos)) WHERE y IS NOT NULL"


def _taps(spark: SparkSession, sf_dir: str, taps) -> DataFrame:
    return profile.tap_filter(lanes.event_lanes(spark, sf_dir), taps).select("channel", "pos", *r4("y"))


PATTERN, GAUSS, LOG = (1.0, -2.0, 3.0, -1.0), num.gauss_kernel(7, 1.5), num.log_kernel(7, 1.5)[0]


@query(_taps_sql(PATTERN))
def sliding_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taps(spark, sf_dir, PATTERN)


@query(_taps_sql(GAUSS))
def gauss_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taps(spark, sf_dir, GAUSS)


@query(_taps_sql(LOG))
def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taps(spark, sf_dir, LOG)


@query(LANES + """, g AS (SELECT channel, pos // 20 AS grp, list(value ORDER BY pos) AS v FROM lanes GROUP BY channel, pos // 20)
SELECT channel, grp, round(list_avg(v), 4) AS mean, CASE WHEN len(v) > 1 THEN round(list_var_samp(v) + 1e-9, 4) END AS variance, coalesce(abs(v[1] - v[2]) <= 1e-4, false) AS close,
  CASE WHEN len(v) > 1 THEN round(least(v[1], v[2]), 4) END AS low, CASE WHEN len(v) > 1 THEN round(greatest(v[1], v[2]), 4) END AS high FROM g""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lanes.event_lanes(spark, sf_dir).groupBy("channel", F.expr("pos div 20").alias("grp")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))
    v = F.transform("v", lambda x: x["value"])
    g = g.select("channel", "grp", v.alias("v"))
    one, two, several = F.slice("v", 1, 1), F.slice("v", 2, 1), F.size("v") > 1
    if_several = lambda c: F.when(several, F.round(c, 4))
    return g.select("channel", "grp", F.round(num.mean(F.col("v")), 4).alias("mean"), if_several(num.variance(F.col("v")) + 1e-9).alias("variance"), F.coalesce(num.within_limits(F.get("v", F.lit(0)), F.get("v", F.lit(1))), F.lit(False)).alias("close"),
                    if_several(num.pairwise_min(one, two)[0]).alias("low"), if_several(num.pairwise_max(one, two)[0]).alias("high"))


@query("SELECT event_id, CAST(event_id AS INTEGER) AS as_int, (event_id % 2) = 1 AS as_flag, CAST(event_id AS DOUBLE) AS as_double FROM events")
def lossless_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return e.select("event_id", num.lossless_cast(F.col("event_id"), "int").alias("as_int"), num.lossless_cast(F.col("event_id") % 2, "boolean").alias("as_flag"), num.lossless_cast(F.col("event_id"), "double").alias("as_double"))


@query("""SELECT event_id, printf('%02d:%02d:%02d:%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS duration
FROM (SELECT event_id, event_id * 7654321 AS ms FROM events)""")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return e.select("event_id", num.duration_text(F.col("event_id") * 7654321).alias("duration"))


def _profile_ctes(lengths) -> str:
    parts = [f""", w{m} AS (SELECT * FROM (SELECT channel, buffer, i, list(value) OVER w AS v, avg(value) OVER w AS mu, var_pop(value) OVER w AS s2 FROM buffers
  WINDOW w AS (PARTITION BY channel, buffer ORDER BY i ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)) WHERE len(v) = {m}),
p{m} AS (SELECT a.channel, a.buffer, CAST({m} AS BIGINT) AS m, a.i, round(least(2.0, greatest(0.0, min(1 - (list_dot_product(a.v, b.v) / {m} - a.mu * b.mu) / sqrt(
  CASE WHEN a.s2 <= 0 THEN 1e-4 ELSE a.s2 END * CASE WHEN b.s2 <= 0 THEN 1e-4 ELSE b.s2 END)))), 6) AS d
  FROM w{m} a JOIN w{m} b ON a.channel = b.channel AND a.buffer = b.buffer AND abs(a.i - b.i) > {m} GROUP BY ALL)""" for m in lengths]
    union = " UNION ALL ".join(f"SELECT * FROM p{m}" for m in lengths)
    return LANES + ", buffers AS (SELECT channel, CAST(0 AS BIGINT) AS buffer, pos AS i, value FROM lanes)" + "".join(parts) + f"""
, prof AS (SELECT *, count(*) OVER (PARTITION BY channel, buffer, m) AS n FROM ({union}))"""


def _candidate_ctes() -> str:
    return _profile_ctes(LENGTHS) + f"""
, marked AS (SELECT *, lead(d) OVER w AS after FROM prof WINDOW w AS (PARTITION BY channel, buffer, m ORDER BY i)),
states AS (SELECT *, coalesce(last_value(CASE WHEN d <= {LO} THEN 1 WHEN d > {HI} THEN 0 END IGNORE NULLS) OVER (PARTITION BY channel, buffer, m ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS state
  FROM marked WHERE i BETWEEN 1 AND n - 2),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY channel, buffer, m ORDER BY i) AS run FROM states WHERE state = 1),
cand AS (SELECT channel, buffer, arg_min(i, (d, i)) AS start, m AS length, arg_max(after, i) AS unfitness FROM runs GROUP BY channel, buffer, m, run),
deduped AS (SELECT channel, buffer, start, length, unfitness FROM (SELECT *, row_number() OVER (PARTITION BY channel, buffer, start ORDER BY length) AS k FROM cand) WHERE k = 1),
reach AS (SELECT *, max(start + length - 1) OVER (PARTITION BY channel, buffer ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM deduped),
sets AS (SELECT *, sum(CASE WHEN r IS NULL OR start > r THEN 1 ELSE 0 END) OVER (PARTITION BY channel, buffer ORDER BY start ROWS UNBOUNDED PRECEDING) AS grp FROM reach),
best AS (SELECT channel, buffer, start, length, unfitness FROM (SELECT *, row_number() OVER (PARTITION BY channel, buffer, grp ORDER BY unfitness, length DESC, start) AS k FROM sets) WHERE k = 1)"""


@query(_profile_ctes([M]) + " SELECT channel, buffer, m, i, d, n FROM prof")
def matrix_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profiles(lanes.event_lanes(spark, sf_dir), [M])


@query(LANES + f""", p AS (SELECT DISTINCT channel FROM lanes), s AS (SELECT unnest(range(0, 5)) AS k) SELECT DISTINCT channel, CAST(round(10 + 90 * k / 4.0) AS BIGINT) AS m FROM p, s""")
def length_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    ladder = F.explode(F.array(*[F.lit(m).cast("long") for m in profile.window_lengths(10, 100, 5)]))
    return lanes.event_lanes(spark, sf_dir).select("channel").distinct().select("channel", ladder.alias("m"))


def _candidates(spark: SparkSession, sf_dir: str, stream: DataFrame | None = None) -> DataFrame:
    return motifs.hysteresis(profile.profiles(lanes.event_lanes(spark, sf_dir) if stream is None else stream, LENGTHS, between=(LO, HI)), LO, HI)


@query(_candidate_ctes() + " SELECT channel, buffer, start, length, round(unfitness, 6) AS unfitness FROM cand")
def hysteresis_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).withColumn("unfitness", F.round("unfitness", 6))


@query(_candidate_ctes() + " SELECT channel, buffer, start, length, round(unfitness, 6) AS unfitness FROM deduped")
def candidate_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.shortest_by_start(_candidates(spark, sf_dir)).withColumn("unfitness", F.round("unfitness", 6))


@query(_candidate_ctes() + " SELECT channel, buffer, start, length, round(unfitness, 6) AS unfitness FROM best")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.merge_overlaps(motifs.shortest_by_start(_candidates(spark, sf_dir))).withColumn("unfitness", F.round("unfitness", 6))


@query(_candidate_ctes() + """ SELECT l.channel, l.pos, CASE WHEN b.start IS NULL THEN 'NA' WHEN l.pos = b.buffer * 10000 + b.start THEN 'MOTIF_BEGIN' ELSE 'MID_MOTIF' END AS detected
FROM lanes l LEFT JOIN best b ON l.channel = b.channel AND l.pos BETWEEN b.buffer * 10000 + b.start AND b.buffer * 10000 + b.start + b.length - 1""")
def motif_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = staged(lanes.event_lanes(spark, sf_dir).select("channel", "pos", "value"))
    found = motifs.merge_overlaps(motifs.shortest_by_start(_candidates(spark, sf_dir, stream)))
    return motifs.motif_labels(stream, found, profile.BUFFER)


@query()
def buffered_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_by_parts(lanes.labelled_lanes(spark, sf_dir), size=500, purge=0.2, lengths=LENGTHS, lo=LO, hi=HI)


WORDS = LABELLED + """,
merged AS (SELECT *, CASE WHEN channel < 2 THEN label = 'MOTIF_BEGIN' ELSE label <> 'NA' END AS is_word, channel || ':' || label AS word FROM labelled),
counted AS (SELECT *, sum(CASE WHEN label <> 'NA' THEN 1 ELSE 0 END) OVER w AS run, sum(CASE WHEN is_word THEN 1 ELSE 0 END) OVER w AS words FROM merged
  WINDOW w AS (ORDER BY time_ms, channel, pos ROWS UNBOUNDED PRECEDING)),
late AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY time_ms, channel, pos) AS k FROM (SELECT *, time_ms - min(time_ms) OVER (PARTITION BY run) AS waited FROM counted WHERE label = 'NA') WHERE waited >= """ + str(IDLE_MS) + """),
fired AS (SELECT * FROM (SELECT *, coalesce(lag(words) OVER (ORDER BY time_ms, channel, pos), 0) AS before FROM late WHERE k = 1) WHERE words > before),
word_rows AS (SELECT time_ms, channel, pos, word, row_number() OVER (ORDER BY time_ms, channel, pos) - 1 AS seq FROM merged WHERE is_word),
sess AS (SELECT w.*, (SELECT count(*) FROM fired f WHERE (f.time_ms, f.channel, f.pos) < (w.time_ms, w.channel, w.pos)) AS session FROM word_rows w),
states AS (SELECT *, coalesce(string_agg(word, ' ') OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN """ + str(HISTORY) + """ PRECEDING AND 1 PRECEDING), '') AS state FROM sess),
running AS (SELECT *, row_number() OVER (PARTITION BY state, word ORDER BY seq) AS c, dense_rank() OVER (PARTITION BY state ORDER BY word DESC) AS r FROM states),
predicted AS (SELECT *, max({'c': c, 'r': r, 'w': word}) OVER (PARTITION BY state ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).w AS guess FROM running)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.with_states(langmodel.sessions(lanes.labelled_lanes(spark, sf_dir), NUMERIC, IDLE_MS), HISTORY)


@query(WORDS + " SELECT time_ms, channel, pos, word FROM word_rows")
def word_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.word_events(lanes.labelled_lanes(spark, sf_dir), NUMERIC).select("time_ms", "channel", "pos", "word")


@query(WORDS + " SELECT time_ms, channel, pos FROM fired")
def idle_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.idle_timeouts(lanes.labelled_lanes(spark, sf_dir), NUMERIC, IDLE_MS)


@query(WORDS + " SELECT state, word, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY state), 4) AS p FROM states GROUP BY state, word")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.probabilities(langmodel.transition_counts(_states(spark, sf_dir))).select("state", "word", "n", *r4("p"))


@query(WORDS + " SELECT seq, CAST(session AS BIGINT) AS session, state, word, guess AS predicted FROM predicted")
def next_word_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.predictions(_states(spark, sf_dir)).select("seq", "session", "state", "word", "predicted")


@query(WORDS + f""", flags AS (SELECT *, CASE WHEN guess IS NULL OR guess <> word THEN 1 ELSE 0 END AS wrong, channel >= 2 OR coalesce(CAST(split_part(guess, ':', 1) AS BIGINT), -1) >= 2 AS is_char FROM predicted),
chars AS (SELECT seq, avg(wrong) OVER (ORDER BY seq ROWS BETWEEN {ERRORS - 1} PRECEDING AND CURRENT ROW) AS ce FROM flags WHERE is_char)
SELECT f.seq, round(avg(f.wrong) OVER (ORDER BY f.seq ROWS BETWEEN {ERRORS - 1} PRECEDING AND CURRENT ROW), 4) AS error,
  round(last_value(c.ce IGNORE NULLS) OVER (ORDER BY f.seq ROWS UNBOUNDED PRECEDING), 4) AS char_error FROM flags f LEFT JOIN chars c USING (seq)""")
def rolling_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.rolling_errors(langmodel.predictions(_states(spark, sf_dir)), NUMERIC, ERRORS).select("seq", *r4("error", "char_error"))


@query(WORDS + """, firsts AS (SELECT seq, row_number() OVER (PARTITION BY state ORDER BY seq) = 1 AS s, row_number() OVER (PARTITION BY state, word ORDER BY seq) = 1 AS t FROM states)
SELECT seq, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_states, CAST(sum(CASE WHEN t THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_transitions FROM firsts WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def model_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.model_sizes(_states(spark, sf_dir))


#: A detection to score: the true label of the numeric lanes three elements late, and of every seventh motif nothing.
POINTS = LABELLED + """,
points AS (SELECT channel, pos, time_ms, label, CASE WHEN (pos - 3) // 48 % 7 = 0 THEN 'NA' ELSE coalesce(lag(label, 3) OVER (PARTITION BY channel ORDER BY pos), 'NA') END AS detected FROM labelled WHERE channel < 2)"""
SCORES = """pp AS pos_precision, pr AS pos_recall, np AS neg_precision, nr AS neg_recall, pf AS pos_f1, nf AS neg_f1, CASE WHEN pf = 0 OR nf = 0 THEN 0.0 ELSE 2 * pf * nf / (pf + nf) END AS overall_f1"""
ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in ("pos_precision", "pos_recall", "neg_precision", "neg_recall", "pos_f1", "neg_f1", "overall_f1"))
MEASURES = ("pos_precision", "pos_recall", "neg_precision", "neg_recall", "pos_f1", "neg_f1", "overall_f1")
_F1 = "CASE WHEN {0}p = 0 OR {0}r = 0 THEN 0.0 ELSE 2 * {0}p * {0}r / ({0}p + {0}r) END AS {0}f"


def _point_sql(source: str, keys: str) -> str:
    part = lambda a, b: f"CASE WHEN {a} = 0 THEN 0.0 ELSE {a} / ({a} + {b}) END"
    return f"""SELECT {keys}, tp, fp, tn, fn, {ROUNDED} FROM (SELECT *, {SCORES} FROM (SELECT *, {_F1.format('p')}, {_F1.format('n')} FROM (SELECT *,
{part('tp', 'fp')} AS pp, {part('tp', 'fn')} AS pr, {part('tn', 'fn')} AS np, {part('tn', 'fp')} AS nr FROM {source})))"""


OUTCOMES = POINTS + """, o AS (SELECT *, CASE WHEN detected <> 'NA' AND label <> 'NA' THEN 1 ELSE 0 END AS a, CASE WHEN detected <> 'NA' AND label = 'NA' THEN 1 ELSE 0 END AS b,
  CASE WHEN detected = 'NA' AND label = 'NA' THEN 1 ELSE 0 END AS c, CASE WHEN detected = 'NA' AND label <> 'NA' THEN 1 ELSE 0 END AS d FROM points)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lanes.labelled_lanes(spark, sf_dir).where("channel < 2").select("channel", "pos", "time_ms", "label")
    late = rows.select("channel", (F.col("pos") + 3).alias("pos"), F.col("label").alias("late"))
    skip = F.expr("(pos - 3) div 48 % 7 = 0 AND pos >= 3") | (F.col("pos") < 3)
    return rows.join(late, ["channel", "pos"], "left").select("channel", "pos", "time_ms", "label", F.when(skip, "NA").otherwise(F.coalesce("late", F.lit("NA"))).alias("detected"))


@query(OUTCOMES + ", t AS (SELECT channel, CAST(sum(a) AS BIGINT) AS tp, CAST(sum(b) AS BIGINT) AS fp, CAST(sum(c) AS BIGINT) AS tn, CAST(sum(d) AS BIGINT) AS fn FROM o GROUP BY channel) " + _point_sql("t", "channel"))
def point_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.point_f1(_points(spark, sf_dir)).select("channel", "tp", "fp", "tn", "fn", *r4(*MEASURES))


@query(OUTCOMES + ", t AS (SELECT channel, pos, " + ", ".join(f"CAST(sum({x}) OVER w AS BIGINT) AS {n}" for x, n in zip("abcd", ("tp", "fp", "tn", "fn"), strict=True)) + " FROM o WINDOW w AS (PARTITION BY channel ORDER BY pos ROWS UNBOUNDED PRECEDING)) " + _point_sql("t", "channel, pos"))
def point_f1_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.running_point_f1(_points(spark, sf_dir)).select("channel", "pos", "tp", "fp", "tn", "fn", *r4(*MEASURES))


EVENTS = POINTS + """,
dm AS (SELECT *, lag(detected) OVER w AS before FROM points WINDOW w AS (PARTITION BY channel ORDER BY pos)),
dn AS (SELECT *, sum(CASE WHEN before IS NULL OR detected = 'MOTIF_BEGIN' OR (detected <> 'NA') <> (before <> 'NA') THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY pos ROWS UNBOUNDED PRECEDING) AS event FROM dm),
d_all AS (SELECT channel, event, min(pos) AS first, max(pos) AS last, CASE WHEN min(detected) = 'NA' THEN 'NA' ELSE 'MOTIF_BEGIN' END AS label FROM dn GROUP BY channel, event),
tm AS (SELECT *, label <> 'NA' AS yes, lag(label <> 'NA') OVER w AS before FROM points WINDOW w AS (PARTITION BY channel ORDER BY pos)),
tn AS (SELECT *, sum(CASE WHEN before IS NULL OR yes <> before THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY pos ROWS UNBOUNDED PRECEDING) AS event FROM tm),
t_all AS (SELECT channel, event, min(pos) AS first, max(pos) AS last, CASE WHEN bool_or(yes) THEN 'MOTIF_BEGIN' ELSE 'NA' END AS label FROM tn GROUP BY channel, event)"""


@query(EVENTS + """ SELECT 'detected' AS side, channel, first, last, label, event < max(event) OVER (PARTITION BY channel) AS closed FROM d_all
UNION ALL SELECT 'true', channel, first, last, label, event < max(event) OVER (PARTITION BY channel) FROM t_all""")
def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).withColumn("truth", F.when(F.col("label") == motifs.INSIDE, motifs.BEGIN).otherwise(F.col("label")))
    d = metrics.event_segments(points, "detected", motifs.BEGIN)
    return d.select(F.lit("detected").alias("side"), "*").unionByName(metrics.event_segments(points, "truth").select(F.lit("true").alias("side"), "*"))


@query(EVENTS + f""", d AS (SELECT * FROM (SELECT *, event < max(event) OVER (PARTITION BY channel) AS closed FROM d_all) WHERE closed), t AS (SELECT * FROM (SELECT *, event < max(event) OVER (PARTITION BY channel) AS closed FROM t_all) WHERE closed),
dok AS (SELECT d.* FROM d JOIN (SELECT channel, max(last) AS m FROM t GROUP BY channel) x ON d.channel = x.channel AND d.last <= x.m),
tok AS (SELECT t.* FROM t JOIN (SELECT channel, max(last) AS m FROM d GROUP BY channel) x ON t.channel = x.channel AND t.last <= x.m),
pairs AS (SELECT d.channel, d.first AS df, t.first AS tf, CASE WHEN (d.label = 'NA') = (t.label = 'NA') THEN 2.0 * (least(d.last, t.last) - greatest(d.first, t.first) + 1) / (d.last - d.first + 1 + t.last - t.first + 1) ELSE 0.0 END AS f
  FROM d JOIN t ON d.channel = t.channel AND d.first <= t.last AND t.first <= d.last),
db AS (SELECT dok.label = 'NA' AS none, coalesce(max(f), 0.0) AS f FROM dok LEFT JOIN pairs p ON p.channel = dok.channel AND p.df = dok.first GROUP BY dok.channel, dok.first, dok.label),
tb AS (SELECT tok.label = 'NA' AS none, coalesce(max(f), 0.0) AS f FROM tok LEFT JOIN pairs p ON p.channel = tok.channel AND p.tf = tok.first GROUP BY tok.channel, tok.first, tok.label)
SELECT {ROUNDED} FROM (SELECT *, {SCORES} FROM (SELECT *, {_F1.format('p')}, {_F1.format('n')} FROM (SELECT
(SELECT coalesce(avg(f), 0.0) FROM db WHERE NOT none) AS pp, (SELECT coalesce(avg(f), 0.0) FROM tb WHERE NOT none) AS pr, (SELECT coalesce(avg(f), 0.0) FROM db WHERE none) AS np, (SELECT coalesce(avg(f), 0.0) FROM tb WHERE none) AS nr)))""")
def event_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_f1(_points(spark, sf_dir)).select(*r4(*MEASURES))


@query(WORDS + " SELECT seq, round((seq + 1) * 60000.0 / (time_ms - (SELECT min(time_ms) FROM labelled) + 1), 4) AS per_minute FROM word_rows")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = lanes.labelled_lanes(spark, sf_dir)
    first = stream.agg(F.min("time_ms")).first()[0] or 0
    words = langmodel.position(langmodel.word_events(stream, NUMERIC), "seq")
    return words.select("seq", F.round(report.throughput(F.col("seq") + 1, F.col("time_ms") - first + 1), 4).alias("per_minute"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.first_by(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT 'value' AS axis, min(value) AS low, max(value) AS high FROM events UNION ALL SELECT 'user_id', CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM events")
def axis_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("value"), F.col("user_id").cast("double").alias("user_id"))
    return report.axis_range(e, ["value", "user_id"])


@query("""SELECT event_type, series, count(*) AS n, round(avg(y), 4) AS mean FROM (SELECT event_type, 'value' AS series, value AS y FROM events UNION ALL SELECT event_type, 'user', CAST(user_id AS DOUBLE) FROM events) GROUP BY event_type, series""")
def unpivot_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value", F.col("user_id").cast("double").alias("user"))
    return report.grouped(report.unpivot(e, ["event_type"], ["value", "user"]), ["event_type", "series"], [F.count("*").alias("n"), F.round(F.avg("y"), 4).alias("mean")])


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY user_id")
def drop_empty_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("y"))
    return report.grouped(report.drop_empty(e, ["user_id"], "y"), ["user_id"], [F.count("*").alias("n")])


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, f"props-{uuid.uuid4().hex}")
    spark.read.parquet(f"{sf_dir}/events.parquet").select("props").write.text(path)
    found = lanes.read_json_path(spark, path, ["k"], lines=True)
    return found.select(F.col("value").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))

