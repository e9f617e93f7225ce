"""Token ids in binary files: blocks of ids transposed into byte or bit planes, each compressed with zstandard.

File: magic, the blocks' planes one after another, then a footer (JSON, zstandard), its length as 8 bytes, magic. The
footer is the chunk index: per block the offset, the number of ids and each plane's compressed length; and the table of
documents in the file's order, with the number of ids of each.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .files import open_new, open_old

MAGIC = b"LANEIDS1"
BLOCK = 1 << 16
FILE_IDS = 1 << 26


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The bytes (kind "byte") or bits ("bit") of little-endian 32-bit ids, plane by plane, without the high planes that are all 0."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        rows = octets.T
    else:
        rows = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1)
    used = max((i + 1 for i in range(len(rows)) if rows[i].any()), default=0)
    return [np.ascontiguousarray(r).tobytes() for r in rows[:used]]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """Ids from what ``to_planes`` returned."""
    octets = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for i, p in enumerate(planes):
            octets[:, i] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for i, p in enumerate(planes):
            bits[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(n)


@dataclass
class PlaneWriter:
    """Writes one file; ``add`` takes a document's ids, as bytes of little-endian 32-bit ids."""

    path: str
    kind: str = "byte"
    level: int = 3
    block: int = BLOCK
    n_ids: int = 0
    docs: list[list[int | None]] = field(default_factory=list)

    def __post_init__(self):
        self.out, self.at, self.waiting, self.held, self.chunks = open_new(self.path), len(MAGIC), [], 0, []
        self.zip = zstandard.ZstdCompressor(level=self.level)
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append([doc_id, len(ids) // 4])
        self.n_ids += len(ids) // 4
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            whole = np.frombuffer(b"".join(self.waiting), "<u4")
            full = len(whole) // self.block * self.block
            for s in range(0, full, self.block):
                self._flush(whole[s : s + self.block])
            self.waiting, self.held = [whole[full:].tobytes()], 4 * (len(whole) - full)

    def _flush(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.chunks.append([self.at, len(ids), [len(p) for p in packed]])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if rest := b"".join(self.waiting):
            self._flush(np.frombuffer(rest, "<u4"))
        footer = self.zip.compress(json.dumps({"kind": self.kind, "block": self.block, "chunks": self.chunks, "docs": self.docs}).encode())
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()


class PlaneReader:
    """Reads one file: the footer at once, blocks when they are asked for."""

    def __init__(self, path: str):
        self.file = open_old(path)
        end = self.file.size()
        self.file.seek(end - 16)
        n, magic = struct.unpack("<Q8s", self.file.read(16))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.file.seek(end - 16 - n)
        self.unzip = zstandard.ZstdDecompressor()
        index = json.loads(self.unzip.decompress(self.file.read(n)))
        self.kind, self.chunks, self.docs = index["kind"], index["chunks"], index["docs"]

    def block(self, i: int) -> np.ndarray:
        at, n, lengths = self.chunks[i]
        self.file.seek(at)
        return from_planes([self.unzip.decompress(self.file.read(k)) for k in lengths], n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Every document with its ids, a few blocks in memory at a time."""
        held, i = np.empty(0, "<u4"), 0
        for doc_id, n in self.docs:
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(i))
                have += len(parts[-1])
                i += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:n]
            held = held[n:]

    def close(self) -> None:
        self.file.close()


def _octets(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class CachedEncoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library, each distinct word once.

    Such a tokenizer cuts a text into pieces before it merges bytes, and a single blank between two other characters
    always starts a piece. So a text is cut at blanks, and what lies between is looked up or encoded once. Texts with
    other white space beside a blank are encoded whole, and so is every text if the file cuts texts in another way than
    this one does. Words are remembered in two tables of bounded size: when the younger is full it becomes the older,
    from which words still in use return. The tests compare a whole table and every sign of two planes with the library.
    """

    def __init__(self, path: str, cache: int = 300_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        cuts = told["pre_tokenizer"] or {}
        self.by_words = (cuts.get("type"), cuts.get("use_regex"), cuts.get("add_prefix_space")) == ("ByteLevel", True, False) and not (told["normalizer"] or told["truncation"] or told["padding"])
        self.special = [t["content"] for t in told["added_tokens"]]
        self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids of pieces that start with a blank
        for piece, i in self.tokenizer.get_vocab().items():
            self.blank[i] = piece.startswith("\u0120")
        self.pieces_of = regex.compile(public_tokenizers.PATTERN).findall
        self.cache, self.words, self.older, self.pieces = cache, {}, {}, {}

    def whole(self, text: str) -> bytes:
        return _octets(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [_octets(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_words(self, words: list[str], together: int = 5000) -> list[bytes]:
        """Ids of words behind a blank each. They are encoded as one text and cut where ids start with a blank, as only a word's first does."""
        out: list[bytes] = []
        for s in range(0, len(words), together):
            part = words[s : s + together]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [*(np.flatnonzero(self.blank[ids]) * 4).tolist(), 4 * len(ids)]
            if len(cuts) != len(part) + 1:
                out += self._encode([" " + w for w in part])
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, missing: set[str]) -> None:
        if len(self.words) > self.cache:
            self.older, self.words = self.words, {}
        if len(self.pieces) > self.cache // 4:
            self.pieces = {}
        words, older, plain, ended, rest = self.words, self.older, set(), [], []
        for w in missing:
            if w in older:
                words[w] = older[w]
            elif not w or w[0] in SPACES or w[-1] in SPACES:
                words[w] = None  # white space beside a blank: cutting there would be wrong
            elif w.isalpha() or max(w) > KNOWN:  # as a rule letters behind a blank are one piece; Unicode's versions may differ on the rest
                plain.add(w)
            elif w[:-1].isalpha() and w[-1] in ENDS:  # and a sign behind them is another
                stem = w[:-1]
                ended.append(w)
                if stem in older:
                    words[stem] = older[stem]
                elif stem not in words:
                    plain.add(stem)
            else:
                rest.append((w, self.pieces_of(" " + w)))
        fresh = list(plain)
        words.update(zip(fresh, self._encode_words(fresh), strict=True))
        new = list(({p for _, ps in rest for p in ps} | set(ENDS)).difference(self.pieces))
        self.pieces.update(zip(new, self._encode(new), strict=True))
        for w in ended:
            words[w] = words[w[:-1]] + self.pieces[w[-1]]
        for w, ps in rest:
            words[w] = b"".join([self.pieces[p] for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._encode(texts)
        out = []
        for s in range(0, len(texts), 200):
            cut = [t.split(" ") for t in texts[s : s + 200]]
            missing = set().union(*[ws[1:] for ws in cut]).difference(self.words)
            if len(self.words) > self.cache:
                missing = set().union(*[ws[1:] for ws in cut])
            if missing:
                self._learn(missing)
            for text, ws in zip(texts[s : s + 200], cut, strict=True):
                # The first word has no blank before it; a special token's string is not plain text.
                out.append(self._joined(ws) if ws[0] and ws[0][-1] not in SPACES and not any(t in text for t in self.special) else None)
                if out[-1] is None:
                    out[-1] = self.whole(text)
        return out

    def _joined(self, ws: list[str]) -> bytes | None:
        try:
            return self.whole(ws[0]) + b"".join(map(self.words.__getitem__, islice(ws, 1, None)))
        except TypeError:  # a word that is None
            return None


#: Signs that a word may end in, to skip cutting it by the pattern.
ENDS = ".,!?;:"
#: White space, with what only some versions of Unicode call so.
SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) | frozenset("\u180e\u200b\ufeff")
#: Up to here letters, digits and signs are the same to all versions of Unicode in use.
KNOWN = "\u024f"

_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """This Python worker's encoder."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


FILES = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def _writer(vocabulary: str, folder: str, end_id: int, kind: str, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt, tail = task.partitionId(), task.taskAttemptId(), struct.pack("<I", end_id)
        files: list[PlaneWriter] = []
        open_file: PlaneWriter | None = None
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode(texts), strict=True):
                if open_file is None:
                    open_file = PlaneWriter(f"{folder}/part-{part:06d}-{len(files):04d}-{attempt}.ids", kind)
                    files.append(open_file)
                open_file.add(doc_id, ids + tail)
                if open_file.n_ids >= file_ids:
                    open_file.close()
                    open_file.docs, open_file = len(open_file.docs), None
        if open_file is not None:
            open_file.close()
            open_file.docs = len(open_file.docs)
        pa.default_memory_pool().release_unused()
        columns = [[part] * len(files), range(len(files)), [f.path for f in files], [f.docs for f in files], [f.n_ids for f in files]]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, FILES.types, strict=True)], schema=FILES)

    return run


def write_token_planes(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, kind: str = "byte",
    file_ids: int = FILE_IDS, folder: str | None = None,
) -> DataFrame:
    """Encode every text and write the ids to files in ascending id order; return (path, start, n_docs, n_ids) of each file.

    Rows are dealt by ranges of the id, so each task writes a stretch of the order (null ids first). A file ends with the
    document that fills ``file_ids``; each document ends with ``end_id``. Every attempt of a task writes files of its
    own name, and only those in the returned table, which Spark commits, count: a lost executor leaves stray files but
    no wrong ones. ``start`` counts the ids in all files before; it takes one row a file. Rows that share an id are
    kept, in any order among themselves. A null text is an empty one: its end id alone. Texts of any length are encoded
    whole. An empty table gives no files. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("place", F.monotonically_increasing_id())  # rows that share an id may go to several tasks
        .repartitionByRange(n, "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    )
    files = ws.stage(
        dealt.mapInArrow(_writer(vocabulary, folder or ws.of("files"), end_id, kind, file_ids), "part int, number int, path string, n_docs long, n_ids long"),
        "manifest", batch_rows=1000,
    )
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return ws.stage(files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "start", "n_docs", "n_ids"), "index")


def _reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rows, held = PlaneReader(path), [], 0
                for doc_id, ids in reader.documents():
                    raw = ids.tobytes()
                    rows.append((doc_id, start, len(ids), zlib.crc32(raw), ids.astype(np.int64) if with_ids else None))
                    start += len(ids)
                    held += len(ids) if with_ids else 1
                    if held > 1 << 18:
                        yield _documents(rows, with_ids)
                        rows, held = [], 0
                yield _documents(rows, with_ids)
                reader.close()

    return run


def _documents(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        arrays.append(pa.array(list(cols[4]), pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def read_token_planes(index: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files of ``index``, one task a file or more."""
    n = max(1, min(index.count(), 4 * int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return index.select("path", "start").repartition(n).mapInArrow(_reader(with_ids), schema)
