"""The sequence model on a stream: every micro-batch goes through the batch operators by parts, joined to carried summaries.

What one micro-batch leaves to the next is small or spread: a line of numbers (the open run of quiet elements, sessions,
words and states so far), the last words of the open session, the outcomes of the last predictions, and counts by state
and word as a table. All of it is written under the batch's number, the line of numbers last: a batch whose line is
missing is done again from what the one before left, and what it wrote is written anew.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.langmodel import KEY, MERGED, _rolling, char_errors, keyed, likeliest, sizes, transition_counts, with_outcomes, with_states
from ..operators.motifs import BEGIN, NONE
from ..operators.ordering import PART, in_parts, running_sums
from ..operators.staging import staged
from .control import push_to

#: Batches whose counts are tables of their own before all counts are put together.
TOGETHER = 32

LINE = (
    "runs long, words long, since long, candidate boolean, candidate_words long, sessions long, chars long, n_states long, n_transitions long, "
    "last_time long, last_channel long, last_pos long"
)
NOTHING = {"runs": 0, "words": 0, "since": None, "candidate": False, "candidate_words": 0, "sessions": 0, "chars": 0, "n_states": 0, "n_transitions": 0, "last_time": None, "last_channel": None, "last_pos": None}
TAIL = "seq long, session long, word string"
OUTCOMES = "seq long, wrong long, char long, char_no long"
COUNTS = "state string, word string, n long"


class StreamedModel:
    """Takes micro-batches of a merged stream (time_ms, channel, pos, label), in its order, and writes a row for each word event.

    ``results`` has (time_ms, channel, pos, word, seq, session, state, predicted, error, char_error, n_states,
    n_transitions), the same as the batch operators give for the whole stream. A batch with an element that belongs
    before one seen already is an error.
    """

    def __init__(self, spark: SparkSession, folder: str, *, numeric: int, timeout_ms: int, history: int = 100, last: int = 100, begin: str = BEGIN, none: str = NONE):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.numeric, self.timeout_ms, self.history, self.last, self.begin, self.none = numeric, timeout_ms, history, last, begin, none

    # What is kept ------------------------------------------------------------------------------------------------

    def _at(self, name: str, batch_id: int) -> str:
        return f"{self.folder}/{name}/batch={batch_id}"

    def _write(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._at(name, batch_id))
        return self.spark.read.schema(df.schema).parquet(self._at(name, batch_id))

    def _batches(self, name: str) -> list[int]:
        """Numbers of the batches that have written ``name``."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(p.getName().partition("=")[2]) for p in found if fs.exists(p.suffix("/_SUCCESS")))

    def _before(self, batch_id: int) -> tuple[dict, int]:
        """The line of numbers that the batch before has left, and its number; -1 if there is none."""
        done = [b for b in self._batches("line") if b < batch_id]
        if not done:
            return dict(NOTHING), -1
        return self.spark.read.schema(LINE).parquet(self._at("line", done[-1])).first().asDict(), done[-1]

    def _kept(self, name: str, schema: str, batch_id: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._at(name, batch_id)) if batch_id >= 0 else self.spark.createDataFrame([], schema)

    def counts(self, batch_id: int | None = None) -> DataFrame:
        """(state, word, n) after the batches up to ``batch_id``, or all that are done."""
        done = self._batches("line")
        return self._counted(batch_id if batch_id is not None else (done[-1] if done else -1)).groupBy("state", "word").agg(F.sum("n").alias("n"))

    def _counted(self, upto: int) -> DataFrame:
        """What the batches up to ``upto`` have counted, not put together."""
        bases = [b for b in self._batches("base") if b <= upto]
        first = bases[-1] if bases else -1
        own = [b for b in self._batches("counts") if first < b <= upto]
        paths = [self._at("base", first)] * bool(bases) + [self._at("counts", b) for b in own]
        if not paths:
            return self.spark.createDataFrame([], COUNTS)
        return self.spark.read.schema(COUNTS).parquet(*paths)

    def results(self) -> DataFrame:
        """The rows of all batches that are done."""
        paths = [self._at("rows", b) for b in self._batches("line")]
        return self.spark.read.parquet(*paths)

    # One batch ---------------------------------------------------------------------------------------------------

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        line, before = self._before(batch_id)
        rows = in_parts(batch.select(*MERGED, "label"), MERGED)
        ends = rows.agg(F.min(F.struct(*MERGED)).alias("first"), F.max(F.struct(*MERGED)).alias("last")).first()
        if ends["last"] is None:
            if before >= 0:
                self._carry_on(before, batch_id, line)
            return
        if line["last_time"] is not None and tuple(ends["first"]) <= (line["last_time"], line["last_channel"], line["last_pos"]):
            raise ValueError("the batch has elements that belong before those seen already")
        first = line["words"]
        events, line = self._events(rows, line | dict(zip(("last_time", "last_channel", "last_pos"), ends["last"], strict=True)))
        tail = self._kept("tail", TAIL, before)
        own = with_states(events.unionByName(tail, allowMissingColumns=True), self.history).where(F.col("seq") >= first)
        # Predictions and sizes go by the states' keys; the states themselves move for the rows and the table of counts only.
        states = staged(keyed(own))
        earlier = keyed(self._counted(before)).join(states.select(*KEY).distinct(), list(KEY), "left_semi")
        earlier = staged(earlier.groupBy(*KEY, "word").agg(F.sum("n").alias("n")))
        outcomes = with_outcomes(staged(likeliest(states, earlier)), self.numeric, line["chars"])
        both = outcomes.select("seq", "wrong", "char", "char_no").unionByName(self._kept("outcomes", OUTCOMES, before))
        errors = _rolling(both, "seq", self.last, "").select("seq", "error")
        out = outcomes.drop("word").join(errors, "seq").join(char_errors(both, self.last).select("char_no", "char_error"), "char_no", "left").join(sizes(states, earlier), "seq")
        shown = states.join(out, "seq").select(
            *MERGED, "word", "seq", "session", "state", "predicted", "error", "char_error",
            (F.col("n_states") + line["n_states"]).alias("n_states"), (F.col("n_transitions") + line["n_transitions"]).alias("n_transitions"),
        )
        done = self._write(shown, "rows", batch_id)
        self._write(transition_counts(states), "counts", batch_id)
        if batch_id % TOGETHER == TOGETHER - 1:
            self._write(self.counts(batch_id), "base", batch_id)
        top = done.agg(F.max("n_states").alias("n_states"), F.max("n_transitions").alias("n_transitions")).first()
        chars = both.agg(F.max("char_no")).first()[0] or line["chars"]
        words = line["words"]
        recent = events.select("seq", "session", "word").unionByName(tail)
        self._write(recent.where((F.col("seq") >= words - self.history) & (F.col("session") == line["sessions"])), "tail", batch_id)
        self._write(both.where((F.col("seq") > words - self.last) | ((F.col("char") == 1) & (F.col("char_no") > chars - self.last))), "outcomes", batch_id)
        line |= {"chars": chars} | {n: top[n] if top[n] is not None else line[n] for n in ("n_states", "n_transitions")}
        self._write_line(line, batch_id)

    def _write_line(self, line: Mapping, batch_id: int) -> None:
        self._write(self.spark.createDataFrame([Row(**line)], LINE), "line", batch_id)

    def _carry_on(self, before: int, batch_id: int, line: Mapping) -> None:
        """A batch without rows leaves what the one before has left."""
        self._write(self._kept("tail", TAIL, before), "tail", batch_id)
        self._write(self._kept("outcomes", OUTCOMES, before), "outcomes", batch_id)
        self._write(self.spark.read.parquet(self._at("rows", before)).limit(0), "rows", batch_id)
        self._write_line(line, batch_id)

    def _events(self, rows: DataFrame, line: dict) -> tuple[DataFrame, dict]:
        """Word events (time_ms, channel, pos, word, seq, session) of a batch in parts, staged, and the line of numbers after it."""
        quiet = F.col("label") == self.none
        is_word = F.when(F.col("channel") < self.numeric, F.col("label") == self.begin).otherwise(~quiet)
        rows = running_sums(rows, {"run": ~quiet, "words": is_word})
        rows = staged(rows.withColumn("run", F.col("run") + line["runs"]).withColumn("words", F.col("words") + line["words"]).withColumn("is_word", is_word))
        open_run = F.col("run") == line["runs"]
        first = rows.where(quiet).groupBy("run").agg(F.min("time_ms").alias("since"))
        first = staged(first.withColumn("since", F.when(open_run, F.coalesce(F.lit(line["since"]).cast("long"), "since")).otherwise(F.col("since"))))
        late = rows.where(quiet).join(first, "run").where(F.col("time_ms") - F.col("since") >= self.timeout_ms)
        candidate = late.groupBy("run").agg(F.min(F.struct(*MERGED, "words", PART)).alias("c")).where(~open_run | F.lit(not line["candidate"]))
        candidate = staged(candidate.select("run", "c.*"))
        fired = candidate.where(F.col("words") > line["candidate_words"]).groupBy("words").agg(F.min(F.struct(*MERGED, PART)).alias("c")).select("c.*")
        words = rows.where("is_word").select(*MERGED, PART, F.concat_ws(":", F.col("channel").cast("string"), F.col("label")).alias("word"))
        both = running_sums(words.unionByName(fired.withColumn("word", F.lit(None).cast("string"))), {"session": F.col("word").isNull(), "seq": F.col("word").isNotNull()})
        both = staged(both.withColumn("session", F.col("session") + line["sessions"]).withColumn("seq", F.col("seq") + line["words"] - 1).drop(PART))
        ends = rows.agg(F.max("run").alias("run"), F.max("words").alias("words")).first()
        last = {r["run"]: r["since"] for r in first.where(F.col("run") == ends["run"]).collect()}
        found = candidate.agg(F.max("run").alias("run"), F.max("words").alias("words")).first()
        same = ends["run"] == line["runs"]
        after = line | {
            "runs": ends["run"], "words": ends["words"], "since": last.get(ends["run"], line["since"] if same else None),
            "candidate": found["run"] == ends["run"] or (same and line["candidate"]), "candidate_words": max(line["candidate_words"], found["words"] or 0),
            "sessions": both.agg(F.max("session")).first()[0] or line["sessions"],
        }
        return both.where("word IS NOT NULL").select(*MERGED, "word", "seq", "session"), after


def run_model(stream: DataFrame, folder: str, **options):
    """A writer that feeds ``stream`` to a ``StreamedModel`` in ``folder``, where its checkpoint is too."""
    return push_to(stream, StreamedModel(stream.sparkSession, folder, **options), f"{folder.rstrip('/')}/checkpoint")
