"""Running streams: sinks, a time limit, graceful and immediate stops, several runs in turn, logs by level."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.staging import staged


def push_to(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str):
    """A writer that hands each micro-batch to ``process``; a failure there fails the query."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)


def discard(df: DataFrame) -> None:
    """Compute everything, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def append_csv(stream: DataFrame, path: str, checkpoint: str):
    """A writer of CSV files with headers, each row once."""
    return stream.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def run_for(query: StreamingQuery, ms: int, *, drain: bool = True) -> bool:
    """Let a query run for ``ms``, then stop it, after it has taken what is there if ``drain``. Whether it had ended itself."""
    ended = bool(query.awaitTermination(ms / 1000))
    if not ended:
        if drain:
            query.processAllAvailable()
        query.stop()
    return ended


def run_in_turn(starts: Iterable[Callable[[], StreamingQuery]], ms: int) -> list[str]:
    """Start, run and stop several queries one after another; their run ids."""
    ids = []
    for start in starts:
        query = start()
        ids.append(str(query.runId))
        run_for(query, ms)
    return ids


def log_by_level(logger: logging.Logger, folder: str) -> None:
    """Below info, info, and warnings or worse go to files of their own."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, fits in (("debug.log", lambda n: n < logging.INFO), ("info.log", lambda n: logging.INFO <= n < logging.WARNING), ("warn.log", lambda n: n >= logging.WARNING)):
        handler = logging.FileHandler(f"{folder}/{name}", encoding="utf-8")
        handler.addFilter(lambda record, fits=fits: fits(record.levelno))
        logger.addHandler(handler)
    logger.setLevel(logging.DEBUG)


class FanOut:
    """Hands each micro-batch to several outputs, each row to each of them once, also when a batch is done again.

    ``outputs`` names what is made of a batch. It is staged once, so that all see the same rows, and every output writes
    below its name and the batch's number: a batch that was killed between two of them writes both anew when it comes
    back. A batch counts when its mark, written last, is there.
    """

    def __init__(self, spark: SparkSession, folder: str, outputs: Mapping[str, Callable[[DataFrame], DataFrame]], form: str = "parquet"):
        self.spark, self.folder, self.outputs, self.form = spark, folder.rstrip("/"), dict(outputs), form

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").format(self.form).option("header", True).save(f"{self.folder}/{name}/batch={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = staged(batch)
        for name, make in self.outputs.items():
            self._write(make(rows), name, batch_id)
        self.spark.createDataFrame([(batch_id,)], "id long").write.mode("overwrite").parquet(f"{self.folder}/done/batch={batch_id}")

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """What ``name`` holds of the batches that count, with their number as ``batch``."""
        reader = self.spark.read.format(self.form).option("header", True)
        rows = (reader.schema(schema) if schema else reader).load(f"{self.folder}/{name}")
        done = self.spark.read.parquet(f"{self.folder}/done").select("batch")
        return rows.join(done, "batch", "left_semi")


def fan_out(stream: DataFrame, folder: str, outputs: Mapping[str, Callable[[DataFrame], DataFrame]], form: str = "parquet"):
    """A writer that feeds ``stream`` to a ``FanOut`` in ``folder``, where its checkpoint is too."""
    return push_to(stream, FanOut(stream.sparkSession, folder, outputs, form), f"{folder.rstrip('/')}/checkpoint")
