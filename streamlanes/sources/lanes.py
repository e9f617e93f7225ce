"""Sources: tables as lanes of one long stream, pull sources, CSV and JSON scans, experiment folders."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordering import PART, position, running_sums

#: The stream's shape: one row an element, exactly one payload not null; "missing" is the label NA, never a null.
SCHEMA = "channel long, pos long, time_ms long, label string, value_num double, value_str string"


def event_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, pos, time_ms, event_id, value, event_type) of the events table: a lane for each type, in its order of time.

    Lanes are numbered by the order of their types. Few types, so their table is small; positions come from
    ``ordering``, so no task sorts a lane.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    names = events.select("event_type").distinct().withColumn("channel", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))
    rows = events.join(names, "event_type").withColumn("time_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    # Times in ms may tie within a lane where full times do not.
    rows = rows.withColumn("time_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return position(rows, "pos", keys=["channel"], order=["time_ms", "time_us", "event_id"]).select("channel", "pos", "time_ms", "event_id", "value", "event_type")


def labelled_lanes(spark: SparkSession, sf_dir: str, *, begin: str = "MOTIF_BEGIN", inside: str = "MID_MOTIF", none: str = "NA", numeric: int = 2, word_above: float = 150.0) -> DataFrame:
    """``event_lanes`` with labels, as no true ones exist: in numeric lanes rows 16 to 31 of every 48 are a motif; in the others a value over ``word_above`` is a word."""
    at = F.col("pos") % 48
    motif = F.when(at == 16, begin).when((at > 16) & (at < 32), inside).otherwise(none)
    word = F.when(F.col("value") > word_above, F.col("event_type")).otherwise(none)
    return event_lanes(spark, sf_dir).withColumn("label", F.when(F.col("channel") < numeric, motif).otherwise(word))


def round_robin(df: DataFrame, seq: str, lanes: int) -> DataFrame:
    """``df`` with the lane that a cyclic poll of ``lanes`` channels gives each element."""
    return df.withColumn("channel", F.pmod(F.col(seq), F.lit(lanes)).cast("long"))


def validated(df: DataFrame, lanes: int, *, payload: Sequence[str] = ("value",)) -> DataFrame:
    """``df``, failing on a lane out of range or a null payload, as elements must not be null."""
    bad = (F.col("channel") < 0) | (F.col("channel") >= lanes)
    for c in payload:
        bad = bad | F.col(c).isNull()
    return df.withColumn("channel", F.when(bad, F.raise_error(F.lit("lane out of range or null payload"))).otherwise(F.col("channel")))


class PullSource(DataSource):
    """A source that is polled: subclass it, name it, and give ``pull(start, most)`` that returns up to ``most`` rows from ``start``.

    None or no rows mean no data yet; more than ``most`` rows are an error. Reading is bounded by the option ``rows`` in
    batch; as a stream each micro-batch takes up to ``chunk`` rows, and the offset is the number of rows taken.
    """

    chunk = 100

    @classmethod
    def name(cls) -> str:
        return "lanes_pull"

    def schema(self) -> str:
        return SCHEMA

    def pull(self, start: int, most: int) -> list[tuple] | None:
        raise NotImplementedError

    def checked(self, start: int, most: int) -> list[tuple]:
        rows = list(self.pull(start, most) or [])
        if len(rows) > most:
            raise ValueError(f"a chunk of {len(rows)} rows; at most {most} were asked for")
        return rows

    def reader(self, schema) -> DataSourceReader:
        return _PullReader(self, int(self.options.get("rows", 1000)), int(self.options.get("partitions", 4)))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _PullStream(self, int(self.options.get("chunk", self.chunk)))


class CounterSource(PullSource):
    """A demo source: elements (source_id, channel, data_id) that count up, dealt to ``lanes`` channels in turn. Options: source, lanes."""

    @classmethod
    def name(cls) -> str:
        return "lanes_counter"

    def schema(self) -> str:
        return "source_id long, channel long, data_id long"

    def pull(self, start: int, most: int) -> list[tuple]:
        source, n = int(self.options.get("source", 0)), int(self.options.get("lanes", 5))
        return [(source, k % n, k) for k in range(start, start + most)]


class _PullReader(DataSourceReader):
    def __init__(self, source: PullSource, rows: int, parts: int):
        self.source, self.rows, self.parts = source, rows, parts

    def partitions(self):
        step = -(-self.rows // self.parts)
        return [InputPartition((s, min(s + step, self.rows))) for s in range(0, self.rows, step)]

    def read(self, partition) -> Iterator[tuple]:
        at, end = partition.value
        while at < end:
            got = self.source.checked(at, min(self.source.chunk, end - at))
            if not got:
                return
            yield from got
            at += len(got)


class _PullStream(SimpleDataSourceStreamReader):
    def __init__(self, source: PullSource, chunk: int):
        self.source, self.chunk = source, chunk

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": 0}

    def read(self, start: dict):
        got = self.source.checked(start["rows"], self.chunk)
        return iter(got), {"rows": start["rows"] + len(got)}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return iter(self.source.checked(start["rows"], end["rows"] - start["rows"]))


def synthetic_lanes(spark: SparkSession, rows: int, *, numeric: int = 2, words: int = 2, seed: int = 234545, gap: int = 60, motif: int = 32) -> DataFrame:
    """A seeded synthetic stream in the shape of SCHEMA: noise with a repeated pattern in numeric lanes, words in the others."""
    lanes = numeric + words
    at = F.col("pos") % (gap + motif)
    inside = at >= gap
    wave = F.sin((at - gap) * 0.4) * 3 + F.sin((at - gap) * 0.17) * 2
    base = spark.range(rows * lanes).select(F.pmod("id", F.lit(lanes)).alias("channel"), F.expr(f"id div {lanes}").alias("pos"))
    noise = (F.pmod(F.xxhash64(F.lit(seed), "channel", "pos"), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 0.2
    is_num = F.col("channel") < numeric
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(seed + 1), "channel", F.expr(f"pos div {gap + motif}")), F.lit(10)).cast("string"))
    label = F.when(is_num, F.when(at == gap, "MOTIF_BEGIN").when(inside, "MID_MOTIF").otherwise("NA")).otherwise(F.when(at == gap, word).otherwise("NA"))
    return base.select(
        "channel", "pos", (F.col("pos") * 10 * lanes + F.col("channel")).alias("time_ms"), label.alias("label"),
        F.when(is_num, F.when(inside, wave).otherwise(0.0) + noise).alias("value_num"), F.when(~is_num, label).alias("value_str"),
    )


# Mean, deviation, least and most of the lengths, delays and noise of configured lanes.
DISTRIBUTIONS = {"gap": (750, 125, 500, 1000), "padding": (55, 22.5, 10, 100), "inside": (75, 12.5, 50, 100), "motif": (100, 0, 100, 100), "delay": (10, 1, 1, 30), "noise": (0.1, 0.03, 0.0, 1.0)}


def _elements(base: DataFrame, *, numeric: int, repeats: int, vocabulary: int, seed: int, distributions: dict | None) -> DataFrame:
    """(channel, sequence, part, at, delay, label, value_num, value_str): the elements of sequences (channel, sequence), drawn from their own place alone."""
    told = DISTRIBUTIONS | (distributions or {})

    def draw(name: str, *keys: str):
        mean, sd, least, most = told[name]
        u, v = ((F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.lit(k), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40) for k in (1, 2))
        return F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), mean + sd * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)))

    parts = [F.struct(F.lit(0).alias("part"), F.lit("gap").alias("kind"), draw("gap", "channel", "sequence").alias("length"))]
    for k in range(repeats):
        parts.append(F.struct(F.lit(2 * k + 1).alias("part"), F.lit("motif").alias("kind"), draw("motif", "channel", "sequence").alias("length")))
        last = k == repeats - 1
        parts.append(F.struct(F.lit(2 * k + 2).alias("part"), F.lit("gap").alias("kind"), draw("padding" if last else "inside", "channel", "sequence").alias("length")))
    cut = base.select("channel", "sequence", F.explode(F.array(*parts)).alias("p")).select("channel", "sequence", "p.part", "p.kind", F.round("p.length").cast("long").alias("length"))
    rows = cut.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    place = ("channel", "sequence", "part", "at")
    inside, is_num = F.col("kind") == "motif", F.col("channel") < numeric
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(seed + 1), "channel", "sequence"), F.lit(vocabulary)).cast("string"))
    label = F.when(is_num & inside, F.when(F.col("at") == 0, "MOTIF_BEGIN").otherwise("MID_MOTIF")).when(~is_num & inside & (F.col("at") == 0), word).otherwise("NA")
    centred = (F.pmod(F.xxhash64(F.lit(seed + 2), *place), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 2
    wave = F.when(inside, F.sin(F.col("at") * 0.4) * 3 + F.sin(F.col("at") * 0.17) * 2).otherwise(0.0)
    return rows.select(
        *place, F.round(draw("delay", *place)).cast("long").alias("delay"), label.alias("label"),
        F.when(is_num, wave + centred * draw("noise", "channel", "sequence", "part")).alias("value_num"), F.when(~is_num, label).alias("value_str"),
    )


def configured_lanes(spark: SparkSession, sequences: int, *, numeric: int = 2, words: int = 2, repeats: int = 2, vocabulary: int = 10, seed: int = 234545, distributions: dict | None = None) -> DataFrame:
    """A seeded synthetic stream in the shape of SCHEMA, of ``sequences`` sequences a lane, with drawn lengths and delays.

    A sequence is a gap, then ``repeats`` motifs with a stretch between them, then padding; each length is a normal draw
    within its limits, and so are the delay before each element and the noise of each motif. Places and times are running
    sums by parts, so no task makes a lane.
    """
    n = numeric + words
    base = spark.range(sequences * n).select(F.pmod("id", F.lit(n)).alias("channel"), F.expr(f"id div {n}").alias("sequence"))
    rows = _elements(base, numeric=numeric, repeats=repeats, vocabulary=vocabulary, seed=seed, distributions=distributions)
    rows = running_sums(rows, {"ends": F.lit(1), "time_ms": F.col("delay")}, keys=["channel"], order=["sequence", "part", "at"]).drop(PART)
    return rows.select("channel", (F.col("ends") - 1).cast("long").alias("pos"), F.col("time_ms").cast("long").alias("time_ms"), "label", "value_num", "value_str")


def streamed_lanes(spark: SparkSession, per_batch: int, *, numeric: int = 2, words: int = 2, repeats: int = 2, vocabulary: int = 10, seed: int = 234545, distributions: dict | None = None) -> DataFrame:
    """``configured_lanes`` as an endless stream: each micro-batch holds the next ``per_batch`` sequences of every lane.

    Every lane is an input partition of its own, and elements are drawn where it is read. A lane's state is two numbers,
    how many elements it had and the time of the last, so a query goes on after a restart where it stopped.
    """
    n = numeric + words
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch * n).option("numPartitions", n).load()
    base = rate.select(F.pmod("value", F.lit(n)).alias("channel"), F.expr(f"value div {n}").alias("sequence"))
    rows = _elements(base, numeric=numeric, repeats=repeats, vocabulary=vocabulary, seed=seed, distributions=distributions)
    return rows.groupBy("channel").applyInPandasWithState(_placed, SCHEMA, "pos long, time_ms long", "append", GroupStateTimeout.NoTimeout)


def _placed(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Places and times of a lane's next elements, from those that its state holds on."""
    pos, time_ms = state.get if state.exists else (0, 0)
    rows = pd.concat(list(chunks)).sort_values(["sequence", "part", "at"])
    rows["pos"] = range(pos, pos + len(rows))
    rows["time_ms"] = time_ms + rows["delay"].cumsum()
    state.update((pos + len(rows), int(rows["time_ms"].iloc[-1])))
    yield rows[["channel", "pos", "time_ms", "label", "value_num", "value_str"]]


def read_report_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, selector: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A CSV with ", " between fields: header names without blanks, optionally some columns, optionally a selector over them."""
    df = spark.read.csv(path, header=True, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    return selector(df) if selector else df


def read_json_path(spark: SparkSession, path: str, keys: Sequence[str], *, lines: bool = False) -> DataFrame:
    """(value) at a key path of JSON files, or of each of their ``lines``: the value as text, one row for each element of a list."""
    found = spark.read.text(path, wholetext=not lines).select(F.get_json_object("value", "$" + "".join(f"['{k}']" for k in keys)).alias("value"))
    as_list = F.from_json("value", "array<string>")
    return found.select(F.explode(F.when(F.startswith("value", F.lit("[")), as_list).otherwise(F.array("value"))).alias("value"))


def count_transitions(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """(n_transitions) of model files, or of each of their ``lines``: entries of all members of the map ``states``."""
    states = F.from_json(F.get_json_object("value", "$.states"), "map<string,string>")
    rows = spark.read.text(path, wholetext=not lines).select(F.explode_outer(states).alias("state", "body"))
    size = F.coalesce(F.size(F.from_json("body", "array<string>")), F.size(F.json_object_keys("body")))
    return rows.agg(F.coalesce(F.sum(F.when(F.col("body").isNotNull(), size)), F.lit(0)).cast("long").alias("n_transitions"))


def experiments(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Names of subfolders of ``root`` that match ``pattern``, sorted; on any storage that Spark reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(f.getPath().getName() for f in found if f.isDirectory() and re.search(pattern, f.getPath().getName()))


def int_from_file(path: str) -> int:
    """The first line of a file as an integer."""
    with open(path, encoding="utf-8") as f:
        return int(f.readline().strip())


def write_report_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header; the folder is replaced."""
    df.write.mode("overwrite").csv(path, header=True)
