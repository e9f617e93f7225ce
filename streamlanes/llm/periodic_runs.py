"""Periodic runs of words: what no repeated k-gram covers is masked, the rest is searched by Main and Lorentz (1984)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_S29, _S33 = np.uint64(29), np.uint64(33)

#: Bytes of text that are searched together; a longer text is searched alone.
TOGETHER = 1 << 22


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts`` one after another, and where each text's begin, with the end. Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values, offsets = lists.values, lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(values), 0)
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return values.filter(some), upto[offsets]


def repeated_cover(ids: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their text holds twice or more. Grams are compared by 64-bit hashes: equal hashes of different grams cover more, never less."""
    n = len(ids)
    covered = np.zeros(n + 1, np.int64)
    if n >= k:
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        key = text[: n - k + 1].astype(np.uint64) * _MIX[2]
        words = ids.astype(np.uint64) + np.uint64(1)
        for j in range(k):
            key = (key ^ (key >> _S29)) * _MIX[0] + words[j : n - k + 1 + j]
        key = (key ^ (key >> _S33)) * _MIX[1]
        inside = text[: n - k + 1] == text[k - 1 :]
        order = np.sort(key[inside])
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            first = np.flatnonzero(inside & (twice[at] == key))
            np.add.at(covered, first, 1)
            np.add.at(covered, first + k, -1)
    return np.cumsum(covered[:-1]) > 0


class Names:
    """Names of the substrings of length 2^j of a sequence (Karp, Miller, Rosenberg 1972): equal names, equal substrings."""

    def __init__(self, y: np.ndarray, longest: int):
        n = len(y)
        level = np.unique(y, return_inverse=True)[1].astype(np.int64)
        self.levels, size = [level.astype(np.int32)], 1
        while 2 * size <= longest:
            second = np.zeros(n, np.int64)
            second[: n - size] = level[size:] + 1
            distinct, level = np.unique(level * (n + 2) + second, return_inverse=True)
            if len(distinct) == n:  # nothing so long is there twice
                break
            self.levels.append(level.astype(np.int32))
            size *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the sequence agrees from ``a`` and from ``b`` on (a < b)."""
        a, b, n = a.copy(), b.copy(), len(self.levels[0])
        start = a.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            name = self.levels[j]
            same = (name[np.minimum(a, n - 1)] == name[np.minimum(b, n - 1)]) & (b < n)
            a += same * (1 << j)
            b += same * (1 << j)
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far it agrees from ``a`` and from ``b`` back, these included (a < b)."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            name, back = self.levels[j], (1 << j) - 1
            same = (name[np.maximum(a - back, 0)] == name[np.maximum(b - back, 0)]) & (a >= back)
            a -= same * (1 << j)
            b -= same * (1 << j)
        return start - a


def _counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number of ``sizes`` its place, and 1, 2, ... up to it."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(1, len(of) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def main_lorentz(y: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> np.ndarray:
    """Runs (start, end, period) of ``least`` or more, by start and end, in the segments [lo, hi) of ``y``.

    Segments must be apart, with elements between them that are nowhere twice. Each segment is cut in the middle: a run
    over the cut agrees with itself one period on, to the right or to the left of the cut, and how far it does on both
    sides tells the run. Then the halves are cut, all segments of a level together.
    """
    found = [np.empty((0, 3), np.int64)]
    if not len(lo):
        return found[0]
    names = Names(y, int((hi - lo).max()))
    near = names.levels[min(1 if least > 4 else 0, len(names.levels) - 1)]
    step = 2 if near is not names.levels[0] else 1
    n = len(y)
    while len(lo):
        mid = (lo + hi) // 2
        for left in (False, True):
            sizes = np.minimum((mid - lo) if left else (hi - mid - 1), (hi - lo) // 2)
            of, q = _counted(np.maximum(sizes, 0))
            b = mid[of] if left else mid[of] + q
            a = b - q
            # Of the agreement that a run needs, half lies on one side of the cut: two elements at least.
            some = (near[a] == near[np.minimum(b, n - 1)]) | ((near[np.maximum(a - step, 0)] == near[np.maximum(b - step, 0)]) & (a >= step))
            a, b, q = a[some], b[some], q[some]
            ahead, behind = names.forward(a, b), np.zeros(len(a), np.int64)
            inner = a > 0
            behind[inner] = names.backward(a[inner] - 1, b[inner] - 1)
            run = ahead + behind >= np.maximum(q, least - q)
            found.append(np.stack([(a - behind)[run], (b + ahead)[run], q[run]], axis=1))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        lo, hi = lo[hi - lo >= least], hi[hi - lo >= least]
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # Periods of one stretch are multiples of its smallest, since it holds each of them twice.
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    return every[first]


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = 12) -> np.ndarray:
    """Runs (text, start, length, period) of the texts whose words are ``ids``, cut at ``starts``, by text, start and period.

    A run of period q has ``least`` or more words and 2 q or more, so what agrees with itself q words on is
    max(least - q, q) words long, (least + 1) // 2 at least: every word of a run is in a k-gram of that length that the
    text holds twice. What no such gram covers is in no run and ends the segments in which runs are looked for.
    """
    covered = repeated_cover(ids, starts, (least + 1) // 2)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    edge = np.ones(len(ids) + 1, bool)
    edge[1:-1] = (covered[1:] != covered[:-1]) | (text[1:] != text[:-1])
    bounds = np.flatnonzero(edge)
    lo, hi = bounds[:-1], bounds[1:]
    use = covered[lo] & (hi - lo >= least) if len(lo) else np.empty(0, bool)
    lo, hi = lo[use], hi[use]
    if not len(lo):
        return np.empty((0, 4), np.int64)
    # Segments side by side, each behind an element of its own.
    of, nth = _counted(hi - lo)
    begin = np.cumsum(hi - lo + 1) - (hi - lo)
    y = -np.arange(1, int((hi - lo + 1).sum()) + 1)
    y[begin[of] + nth - 1] = ids[lo[of] + nth - 1]
    runs = main_lorentz(y, begin, begin + (hi - lo), least)
    segment = np.searchsorted(begin, runs[:, 0], "right") - 1
    at = runs[:, 0] - begin[segment] + lo[segment]
    out = np.stack([text[at], at - starts[text[at]], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
_DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _search(ids: pa.Array, texts: pa.Array, least: int) -> pa.RecordBatch:
    words, starts = split_words(texts)
    numbers = words.dictionary_encode().indices.to_numpy()
    runs = runs_of(numbers, starts, least)
    drop = np.zeros(len(words) + 1, np.int64)
    first = starts[runs[:, 0]] + runs[:, 1]
    np.add.at(drop, first + runs[:, 3], 1)
    np.add.at(drop, first + runs[:, 2], -1)
    keep = np.cumsum(drop[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(keep)])
    kept = pa.ListArray.from_arrays(pa.array(upto[starts], pa.int32()), words.filter(pa.array(keep)))
    listed = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(RUN))
    cuts = pa.array(np.searchsorted(runs[:, 0], np.arange(len(starts))), pa.int32())
    columns = [ids, pa.array(np.diff(starts), pa.int64()), pa.ListArray.from_arrays(cuts, listed), pc.binary_join(kept, " ")]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, RUNS.types, strict=True)], schema=RUNS)


def _searcher(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            upto, at = np.cumsum(sizes, dtype=np.int64), 0
            while at < batch.num_rows:
                before = upto[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(upto, before + TOGETHER, "right")))
                part = batch.slice(at, end - at)
                yield _search(part.column(0), part.column(1), least)
                at = end

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every text.

    Words are stretches without blanks (``[^\\x20\\x09-\\x0D]+``), numbered from 0. A run is a longest stretch of words in
    which words ``period`` apart are equal, ``period`` being the smallest such number, of ``least`` words or more and
    twice its period or more. ``runs`` has each one's start, length and period, by start, then period. ``collapsed`` has
    the words that no run repeats, joined by one blank: of each run the first ``period`` words stay, unless another run
    repeats them.

    One pass without a shuffle. Texts are searched in groups of ``TOGETHER`` bytes, a longer one alone and whole: what
    repeated k-grams cover takes about 4 bytes for each doubling of its length a word, the rest a few dozen bytes. A
    text of n covered words takes n log n steps of numpy.

    Null and blank texts have no words, no runs and collapse to an empty text. Ids are carried as they are: null ones and
    repeated rows each have a row. Where runs tie nothing is chosen: all are returned. Other columns are not read, and an
    empty table gives an empty table.
    """
    if least < 2:
        raise ValueError("a run has two words or more")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_searcher(least), _DDL)
