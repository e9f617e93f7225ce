"""Documents into sequences of a fixed length: dominance reduction by Martello and Toth (1990), then best fit.

Lengths are whole numbers up to the capacity, so a corpus of any size is a histogram of at most ``capacity`` counts. The
plan is made for that histogram; what it says of the nth piece of a length is looked up by every piece on its own.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .periodic_runs import split_words

CAPACITY = 4096
#: Bytes of text that are encoded together; a longer text is encoded alone.
TOGETHER = 1 << 22


# The plan ------------------------------------------------------------------------------------------------------------

@dataclass
class Group:
    """``count`` sequences of the same content: (length, how many) in the order of places."""

    count: int
    content: list[tuple[int, int]]


def _largest_pair(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two pieces (larger, smaller) of ``sizes``, rising, with the largest sum within ``room``; of equal sums the one with the largest piece."""
    i = np.arange(len(sizes))
    at = np.searchsorted(sizes, room - sizes, "right") - 1  # the largest that goes with each
    fine = (at > i) | ((at == i) & (counts > 1))
    if not fine.any():
        return None
    total = np.where(fine, sizes + sizes[np.maximum(at, 0)], -1)
    best = int(np.argmax(total))  # the first has the smallest smaller piece, so the largest larger one
    return int(sizes[at[best]]), int(sizes[best])


def dominating(size: int, counts: np.ndarray, capacity: int) -> tuple[int, ...] | None:
    """A set of at most two other pieces that, with one of ``size``, dominates every set that holds this one; None if none is found.

    A set dominates another if each piece of the other can be put, in parts, into the places of its own pieces: then some
    best packing has the set as a sequence. ``counts`` are of all pieces by length, this one included.
    """
    left = counts.copy()
    left[size] -= 1
    room = capacity - size
    sizes = np.flatnonzero(left[: room + 1])
    if not len(sizes):
        return ()  # nothing goes with it
    most = int(sizes[-1])
    if most == room:
        return (most,)  # it fills the sequence
    smallest = np.repeat(sizes[:3], np.minimum(left[sizes[:3]], 3))[:3]
    if len(smallest) < 2 or smallest[:2].sum() > room:
        return (most,)  # only one piece goes with it
    if len(smallest) > 2 and smallest.sum() <= room:
        return None
    a, b = _largest_pair(sizes, left[sizes], room)
    if most >= a + b:
        return (most,)
    if a == most:
        # Pairs whose smaller piece is larger than b have to go into a's place alone.
        above = sizes[sizes > b]
        other = _largest_pair(above, left[above], room)
        if other is None or sum(other) <= a:
            return (a, b)
    return None


def reduce_by_dominance(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[Group], np.ndarray]:
    """Sequences that some best packing holds, and the counts of what is left.

    What dominates for one piece of a length does so for the next as long as its pieces last: taking pieces away leaves
    fewer alternatives. So each step uses up a length, and lengths are gone through until nothing is found any more.
    """
    counts = counts.copy()
    groups: list[Group] = []
    found = True
    while found:
        found = False
        for size in range(capacity, 0, -1):
            while counts[size] and (others := dominating(size, counts, capacity)) is not None:
                content = {s: (size, *others).count(s) for s in sorted((size, *others), reverse=True)}
                times = int(min(counts[s] // k for s, k in content.items()))
                for s, k in content.items():
                    counts[s] -= times * k
                groups.append(Group(times, list(content.items())))
                found = True
    return groups, counts


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Best-fit decreasing for counts of lengths: each piece goes where the least room is left that holds it.

    Sequences of the same content are one group. A piece that fits leaves less room than any other sequence has that
    fits, so the next of its length goes there too: a group takes room // length pieces each, until pieces run out.
    """
    by_room: dict[int, list[Group]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(room: int, group: Group) -> None:
        by_room.setdefault(room, []).append(group)
        rooms[room] = True

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for room in (np.flatnonzero(rooms[size:]) + size).tolist():
            if not left:
                break
            waiting, each = by_room.pop(room), room // size
            rooms[room] = False
            for g in waiting:
                full = min(g.count, left // each)
                rest, left = g.count - full, left - full * each
                if full:
                    put(room - each * size, Group(full, [*g.content, (size, each)]))
                if rest and left:  # fewer than a sequence takes
                    put(room - left * size, Group(1, [*g.content, (size, left)]))
                    rest, left = rest - 1, 0
                if rest:
                    put(room, Group(rest, g.content))
        if left:
            each = capacity // size
            full, rest = divmod(left, each)
            if full:
                put(capacity - each * size, Group(full, [(size, each)]))
            if rest:
                put(capacity - rest * size, Group(1, [(size, rest)]))
    return [g for room in sorted(by_room) for g in by_room[room]]


#: What one group does with a stretch of the pieces of a length, numbered from 0: they are dealt ``each`` to a sequence from ``sequence`` on, at ``offset``.
PLACES = np.dtype([("size", "i8"), ("first", "i8"), ("each", "i8"), ("sequence", "i8"), ("offset", "i8")])


def places(groups: list[Group]) -> np.ndarray:
    """The plan as a table by length and first number."""
    rows, used, sequence = [], {}, 0
    for g in groups:
        offset = 0
        for size, each in g.content:
            rows.append((size, used.get(size, 0), each, sequence, offset))
            used[size] = used.get(size, 0) + g.count * each
            offset += size * each
        sequence += g.count
    return np.sort(np.array(rows, PLACES), order=["size", "first"])


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """All sequences for ``counts`` pieces of each length up to ``capacity``."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return [*fixed, *best_fit(rest, capacity)]


# Encoding ------------------------------------------------------------------------------------------------------------

def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after another."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class WordEncoder:
    """Encodes texts with a file of the tokenizers library, each distinct piece of a word once.

    A tokenizer that lowers case, then cuts a text at white space, between letters and signs and at digits before it
    merges, gives a text the ids of these pieces one after another. So words are lowered and cut where a letter a-z meets
    another sign of ASCII than the apostrophe, and distinct pieces are looked up, or encoded once: those of letters alone
    many at a time, as each ends with the only id that ends a word. Where the file does otherwise, texts are encoded
    whole. What is remembered is forgotten when there are ``cache`` pieces. The tests compare a whole table and random
    mixtures of signs with the library.
    """

    def __init__(self, path: str, cache: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        steps = (told["normalizer"] or {}).get("normalizers") or [told["normalizer"] or {}]
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers") or [told["pre_tokenizer"] or {}]
        split, suffix = cuts[0], told["model"].get("end_of_word_suffix")
        self.by_words = (
            all(s.get("type") in ("NFC", "Lowercase") or (s.get("type"), s.get("pattern"), s.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for s in steps)
            and any(s.get("type") == "Lowercase" for s in steps)
            and split.get("type") == "Split" and split.get("pattern") == {"Regex": WORD_CUTS} and split.get("behavior") == "Removed" and split.get("invert") is True
            and not any(c.get("add_prefix_space") or c.get("use_regex") for c in cuts[1:]) and not (told["truncation"] or told["padding"]) and bool(suffix)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") or len(t["content"].split()) > 1 for t in told["added_tokens"])
        )
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and piece.endswith(suffix)
        self.cache = cache
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], together: int = 5000) -> None:
        plain = [w for w in pieces if w.isalpha() and max(w) <= KNOWN]
        rest = set(pieces).difference(plain)
        flats, lengths, names = [self.flat], [self.length], []
        for s in range(0, len(plain), together):
            part = plain[s : s + together]
            ids = np.array(self._ids([" ".join(part)])[0], np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):  # each has one, so these are theirs
                flats.append(ids)
                lengths.append(np.diff(ends, prepend=0))
                names += part
            else:
                rest.update(part)
        single = list(rest)
        ids = self._ids(single)
        flats.append(np.array([i for own in ids for i in own], np.uint32))
        lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.known.update(zip([*names, *single], range(len(self.length), len(self.length) + len(pieces)), strict=True))
        self.flat, self.length = np.concatenate(flats), np.concatenate(lengths)
        self.begin = np.cumsum(self.length) - self.length

    def _slots(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of distinct ``pieces`` are remembered."""
        if len(self.known) > self.cache:
            self._forget()
        if missing := [w for w in pieces if w not in self.known]:
            self._learn(missing)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin, with the end."""
        if not self.by_words:
            ids = self._ids(pc.fill_null(texts, "").to_pylist())
            return np.array([i for own in ids for i in own], np.uint32), np.cumsum([0, *map(len, ids)])
        words, starts = split_words(texts)
        special = pc.match_substring(words, "<|")  # may be a special token, which is not cut or lowered
        words = pc.if_else(special, words, pc.ascii_lower(words)).dictionary_encode()
        distinct = words.dictionary
        spaced = distinct
        for before, after in ((LETTER, SIGN), (SIGN, LETTER)):
            spaced = pc.replace_substring_regex(spaced, f"({before})({after})", r"\1 \2")
        pieces, cuts = split_words(pc.if_else(pc.match_substring(distinct, "<|"), distinct, spaced))
        pieces = pieces.dictionary_encode()
        slots = self._slots(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        upto = np.concatenate([[0], np.cumsum(self.length[slots])])
        by_word = self.flat[_ranges(self.begin[slots], self.length[slots])]  # of distinct words
        at = words.indices.to_numpy()
        begin, sizes = upto[cuts[at]], upto[cuts[at + 1]] - upto[cuts[at]]
        return by_word[_ranges(begin, sizes)], np.concatenate([[0], np.cumsum(sizes)])[starts]


#: A letter, and a sign that no tokenizer's piece joins to it: all of ASCII's but letters, blanks and the apostrophe.
LETTER, SIGN = "[a-z]", r"[!-&(-@\[-`{-~]"
#: Up to here letters are the same to all versions of Unicode in use.
KNOWN = "\u024f"
#: Fixed value: how the tokenizer's file cuts texts.
WORD_CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """This Python worker's encoder."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _cutter(vocabulary: str, end_id: int, capacity: int, with_ids: bool):
    """Pieces of documents, each with its task and its number among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            upto, at = np.cumsum(sizes, dtype=np.int64), 0
            while at < batch.num_rows:
                before = upto[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(upto, before + TOGETHER, "right")))
                yield pieces_of(batch.slice(at, end - at), part, seen)
                at = end

    def pieces_of(batch: pa.RecordBatch, part: int, seen: np.ndarray) -> pa.RecordBatch:
        ids, starts = _encoder(vocabulary).encode(batch.column(1))
        ends = np.arange(1, len(starts))
        whole = np.insert(ids, starts[1:], end_id).astype("<u4")
        starts = np.concatenate([starts[:1], starts[1:] + ends])
        n = np.diff(starts)
        doc = np.repeat(np.arange(len(n)), -(-n // capacity))
        piece = np.arange(len(doc)) - np.searchsorted(doc, doc)
        first = piece * capacity
        length = np.minimum(capacity, n[doc] - first)
        begin = starts[doc] + first
        # Numbers among pieces of the same length go on from batch to batch.
        order = np.argsort(length, kind="stable")
        nth = np.empty(len(doc), np.int64)
        nth[order] = np.arange(len(doc)) - np.searchsorted(length[order], length[order]) + seen[length[order]]
        seen += np.bincount(length, minlength=len(seen))
        raw = memoryview(whole).cast("B")
        parts = [raw[4 * b : 4 * (b + k)] for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
        columns = [batch.column(0).take(pa.array(doc)), piece.astype(np.int32), first, length, np.fromiter(map(zlib.crc32, parts), np.int64, len(parts)), np.full(len(doc), part, np.int32), nth]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
        if with_ids:
            columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return run


#: More pieces than a length can have.
STRIDE = 1 << 50


def _placer(table: np.ndarray, n_columns: int):
    """Adds sequence_id and offset to rows whose last two columns are a piece's length and its number."""
    key = table["size"] * STRIDE + table["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = (batch.column(n_columns + i).to_numpy() for i in (0, 1))
            row = table[np.searchsorted(key, size * STRIDE + number, "right") - 1] if len(table) else table
            nth = number - row["first"]
            sequence, offset = row["sequence"] + nth // row["each"], row["offset"] + nth % row["each"] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_columns], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:n_columns], "sequence_id", "offset"])

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of every document.

    A document is its text's ids and ``end_id``; one longer than ``capacity`` is cut into pieces of that, the last of
    what remains. Pieces are put into as few sequences of ``capacity`` as can be: sets of up to three pieces that
    dominate every other set with one of them are sequences of some best packing and are fixed; best fit in falling
    order deals the rest. ``offset`` is a piece's place in its sequence, gapless from 0; sequences are numbered from 0
    without gaps. ``ids_crc32`` is that of the piece's ids as little-endian 32-bit integers, ``ids`` are these.

    1. Texts are encoded once, in one pass, into staged pieces; each task numbers its pieces of each length.
    2. Pieces are counted by task and length, then by length: ``capacity`` numbers at most, however large the corpus,
       go to the driver and become the plan.
    3. Counts of the tasks before give each task's pieces their numbers among all of a length. The plan, a table whose
       rows are bounded by lengths too, tells from the length and the number where a piece goes.

    A length that a third of all documents has is spread over the tasks like any other: nothing is ordered or gathered
    by length. No two pieces share a number, since staged tables stay as they are when an executor is lost.

    Null and empty texts are ``end_id`` alone, texts of any length are encoded whole; null ids and repeated rows have
    pieces of their own; equal lengths are dealt in the order of tasks and rows. Other columns are not read. An empty
    table gives an empty table.
    """
    ws = Workspace(docs.sparkSession, "pack")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    pieces = ws.stage(own.mapInArrow(_cutter(vocabulary, end_id, capacity, with_ids), schema), "pieces", batch_rows=1000)
    counts = ws.stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    totals = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        totals[r["length"]] = r["n"]
    table = places(plan(totals, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ws.stage(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    shown = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    numbered = pieces.join(starts, ["part", "length"]).select(*shown, F.col("length").alias("size"), (F.col("before") + F.col("nth")).alias("number"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    placed = numbered.mapInArrow(_placer(table, len(shown)), out)
    return placed.select(*shown[:5], "sequence_id", "offset", *shown[5:])
