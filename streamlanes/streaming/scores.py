"""Event scores on Structured Streaming: each event's F1 as soon as it is final, and no event kept longer than that."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.motifs import BEGIN, INSIDE, NONE

SCORED = "channel long, time_ms long, pos long, side string, first long, is_none boolean, f1 double"


class EventScores:
    """One lane's events, detected and true, by the rules of the batch scores.

    An event ends where the next one starts. Once both of two overlapping events have ended, each knows the other; once
    the other side's ended events cover an event's end it is final, leaves, and is forgotten: nothing to come can overlap it.
    """

    def __init__(self, begin: str = BEGIN, inside: str = INSIDE, none: str = NONE):
        self.begin, self.inside, self.none = begin, inside, none
        self.pos = 0
        self.before: dict[str, str | None] = {"detected": None, "true": None}
        self.open: dict[str, list] = {}  # first, label
        self.ended: dict[str, list[list]] = {"detected": [], "true": []}  # first, last, label, best so far
        self.covered = {"detected": -1, "true": -1}

    def feed(self, truth: str, detected: str) -> list[tuple[str, int, bool, float]]:
        """(side, first, is none, F1) of the events that this element makes final."""
        kinds = {"detected": self.none if detected == self.none else self.begin, "true": self.begin if truth == self.inside else truth}
        starts = {
            "detected": self.before["detected"] is None or detected == self.begin or (detected == self.none) != (self.before["detected"] == self.none),
            "true": self.before["true"] is None or kinds["true"] != self.before["true"],
        }
        for side, other in (("detected", "true"), ("true", "detected")):
            if starts[side] and side in self.open:
                first, label = self.open[side]
                event = [first, self.pos - 1, label, 0.0]
                for o in self.ended[other]:
                    shared = min(event[1], o[1]) - max(first, o[0]) + 1
                    if shared > 0 and (label == self.none) == (o[2] == self.none):
                        f1 = 2.0 * shared / ((event[1] - first + 1) + (o[1] - o[0] + 1))
                        event[3], o[3] = max(event[3], f1), max(o[3], f1)
                self.ended[side].append(event)
                self.covered[side] = event[1]
            if starts[side]:
                self.open[side] = [self.pos, kinds[side]]
            self.before[side] = detected if side == "detected" else kinds["true"]
        self.pos += 1
        out = []
        for side, other in (("detected", "true"), ("true", "detected")):
            out += [(side, e[0], e[2] == self.none, e[3]) for e in self.ended[side] if e[1] <= self.covered[other]]
        for side, other in (("detected", "true"), ("true", "detected")):
            self.ended[side] = [e for e in self.ended[side] if e[1] > self.covered[other]]
        return out

    def state(self) -> str:
        return json.dumps([self.pos, self.before, self.open, self.ended, self.covered])

    def restore(self, state: str) -> None:
        self.pos, self.before, self.open, self.ended, self.covered = json.loads(state)


def score_stream(stream: DataFrame) -> DataFrame:
    """(channel, time_ms, pos, side, first, is_none, f1) of a stream (channel, pos, time_ms, label, detected), state kept by lane.

    Rows of a micro-batch are sorted by time and place. ``time_ms`` and ``pos`` are those of the element that made the
    event final; averages over them are a running aggregation.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scores = EventScores()
        if state.exists:
            scores.restore(state.get[0])
        out: list[tuple] = []
        for r in pd.concat(list(frames)).sort_values(["time_ms", "pos"], kind="stable").itertuples(index=False):
            out += [(key[0], int(r.time_ms), scores.pos - 1, *e) for e in scores.feed(r.label, r.detected)]
        state.update((scores.state(),))
        names = [c.split()[0] for c in SCORED.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"channel": "int64", "time_ms": "int64", "pos": "int64", "side": "object", "first": "int64", "is_none": "bool", "f1": "float64"})

    return stream.groupBy("channel").applyInPandasWithState(run, SCORED, "scores string", "append", GroupStateTimeout.NoTimeout)
