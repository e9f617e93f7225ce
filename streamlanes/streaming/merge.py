"""The ordered merge of lanes on Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .detector import END

MERGED = "channel long, pos long, time_ms long, label string, value double, seq long"


class OrderedMerge:
    """Emits elements by time once every lane has a later one, as until then one of the same time may come in a lower lane."""

    def __init__(self, lanes: int):
        self.last: list[int | None] = [None] * lanes
        self.ended = [False] * lanes
        self.held: list[tuple] = []
        self.seq = 0

    def feed(self, rows: list[tuple]) -> list[tuple]:
        """``rows`` (channel, pos, time_ms, label, value), each lane's in order; what can be emitted, numbered."""
        for r in sorted(rows, key=lambda r: (r[0], r[1])):
            before = self.last[r[0]]
            if before is not None and r[2] < before:
                raise ValueError("times of a lane fall")
            self.last[r[0]] = r[2]
            if r[3] == END:
                self.ended[r[0]] = True
            else:
                self.held.append(r)
        open_lanes = [t for t, done in zip(self.last, self.ended, strict=True) if not done]
        edge = None if any(t is None for t in open_lanes) else min(open_lanes, default=float("inf"))
        self.held.sort(key=lambda r: (r[2], r[0], r[1]))
        n = 0 if edge is None else sum(r[2] < edge for r in self.held)
        out = [(*r, self.seq + i) for i, r in enumerate(self.held[:n])]
        self.held, self.seq = self.held[n:], self.seq + n
        return out

    def drop_oldest(self) -> bool:
        """Give up the oldest element that waits for another lane. Whether some wait still."""
        self.held = self.held[1:]
        return bool(self.held)


def merge_stream(stream: DataFrame, lanes: int, discard_ms: int | None = None) -> DataFrame:
    """A stream (channel, pos, time_ms, label, value) of ``lanes`` lanes in one order of time, with ``seq``.

    A lane that ended (a row labelled END) holds nothing back; a lane that has not begun holds back everything. One
    order is one key, so this is one task: feed it word events, which are few, not raw elements. Falling times are an
    error. The state is what waits, kept in the checkpoint. With ``discard_ms``, elements that wait for a silent lane so
    long by the clock are given up, the oldest first, one at each trigger, until the lanes go on or nothing waits.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        merge = OrderedMerge(lanes)
        if state.exists:
            merge.last, merge.ended, held, merge.seq = json.loads(state.get[0])
            merge.held = [tuple(r) for r in held]
        out: list[tuple] = []
        wait = discard_ms
        if state.hasTimedOut:
            wait = 1 if merge.drop_oldest() else None
        else:
            rows = pd.concat(list(frames))[["channel", "pos", "time_ms", "label", "value"]].astype(object)
            out = merge.feed([tuple(r) for r in rows.itertuples(index=False)])
        state.update((json.dumps([merge.last, merge.ended, merge.held, merge.seq]),))
        if discard_ms is not None and wait and merge.held:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["channel", "pos", "time_ms", "label", "value", "seq"]).astype({c: "int64" for c in ("channel", "pos", "time_ms", "seq")} | {"value": "float64"})

    return stream.withColumn("merge_key", F.lit(0)).groupBy("merge_key").applyInPandasWithState(run, MERGED, "merge string", "append", GroupStateTimeout.NoTimeout if discard_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
