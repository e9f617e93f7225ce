"""The buffered detector on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detector import BufferedDetector, searcher

#: A row with this label ends its lane: what is left in the buffer is labelled. Spark has no call at a stream's end.
END = "__END__"


def detect_stream(stream: DataFrame, *, size: int = 10_000, purge: float = 0.1, lengths: Sequence[int] = (100,), lo: float = 0.025, hi: float = 0.075, **options) -> DataFrame:
    """(channel, time_ms, label, detected) of a stream (channel, pos, time_ms, label, value), state kept by lane.

    The state is one buffer and its carried candidates. Rows of a micro-batch are sorted by time and place; a time
    before the buffer's last is an error, as in batch. Output is appended; a restart continues from the checkpoint.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = BufferedDetector(size, purge, searcher(lengths, lo, hi, **options))
        if state.exists:
            detector.restore(state.get[0])
        rows = pd.concat(list(frames)).sort_values(["time_ms", "pos"], kind="stable")
        out: list[tuple[int, str, str]] = []
        for r in rows.itertuples(index=False):
            out += detector.finish() if r.label == END else detector.feed((int(r.time_ms), r.label, float(r.value)))
        state.update((detector.state(),))
        made = pd.DataFrame(out, columns=["time_ms", "label", "detected"])
        made.insert(0, "channel", key[0])
        yield made.astype({"channel": "int64", "time_ms": "int64"})

    return stream.groupBy("channel").applyInPandasWithState(
        run, "channel long, time_ms long, label string, detected string", "detector string", "append", GroupStateTimeout.NoTimeout
    )
