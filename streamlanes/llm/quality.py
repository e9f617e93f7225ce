"""Quality classifier by attention-based multiple-instance learning (Ilse, Tomczak & Welling 2018)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Bytes of a passage; the last one of a text may be shorter.
PASSAGE = 512

# The classes of bytes whose shares describe a passage.
CLASSES = (b" ", b"\t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!", b"?", b"#$%&*@^~=+<>{}[]|\\/_", b"\"'()-:;`", bytes(range(128, 256)))
OTHER = len(CLASSES)
_CLASS = np.full(256, OTHER, np.uint8)
for _i, _members in enumerate(CLASSES):
    _CLASS[np.frombuffer(_members, np.uint8)] = _i
_BYTE_HASH = np.random.default_rng(3).integers(1, 1 << 62, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Hashed pairs of neighbouring bytes, whose shares say more of a passage's language and style than classes do.
PAIRS = 48
WIDTH = OTHER + 1 + 8 + PAIRS


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of ``texts``, and each text's number of passages (1 for an empty one).

    Shares of byte classes and of hashed pairs of bytes, words by byte, length, shares of words equal to the one before
    them, two and three before, of capitalised words, and of words that end in a symbol or a full stop.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raws])
    n_pass = np.maximum(1, -(-sizes // PASSAGE))
    total = int(n_pass.sum())
    data = np.frombuffer(b"".join(raws), np.uint8)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = np.repeat(np.cumsum(n_pass) - n_pass, sizes)
    inside = np.arange(len(data)) - starts
    of = first + inside // PASSAGE
    kind = _CLASS[data]
    counts = np.bincount(of * (OTHER + 1) + kind, minlength=total * (OTHER + 1)).reshape(total, OTHER + 1).astype(float)
    length = counts.sum(axis=1)
    x = np.zeros((total, WIDTH))
    x[:, : OTHER + 1] = counts / np.maximum(length, 1)[:, None]
    dark = kind > 1
    if dark.any():
        before = np.empty(len(data), bool)
        before[0], before[1:] = False, dark[:-1]
        before &= inside > 0  # a text's first byte starts a word
        begin = np.flatnonzero(dark & ~before)
        after = np.empty(len(data), bool)
        after[-1], after[:-1] = False, (dark & before)[1:]
        end = np.flatnonzero(dark & ~after)
        # A word's hash weighs each byte by its place, so that words of the same letters differ.
        since = np.concatenate([[0], begin])
        place = np.arange(len(data)) - np.repeat(since, np.diff(np.append(since, len(data))))
        powers = np.multiply.accumulate(np.full(int((end - begin).max()) + 2, _ODD, np.uint64))
        weighed = np.where(dark, _BYTE_HASH[data] * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
        sums = np.cumsum(weighed, dtype=np.uint64)
        word = sums[end] - sums[begin] + weighed[begin]
        home, text = of[begin], starts[begin]
        n_words = np.maximum(np.bincount(home, minlength=total), 1)

        def share(flags: np.ndarray) -> np.ndarray:
            return np.bincount(home, weights=flags, minlength=total) / n_words

        c = OTHER + 1
        for lag in (1, 2, 3):
            same = np.zeros(len(word))
            if len(word) > lag:
                same[lag:] = (word[lag:] == word[:-lag]) & (text[lag:] == text[:-lag])
            x[:, c + lag - 1] = share(same)
        x[:, c + 3] = share(kind[begin] == 3)
        for i, k in enumerate((9, 5)):
            x[:, c + 4 + i] = share(kind[end] == k)
        x[:, c + 6] = np.minimum(share(end - begin + 1.0) / 20, 3)
        x[:, c + 7] = np.log1p(length) / 6
        pair = (data[:-1].astype(np.uint32) * 40503 + data[1:].astype(np.uint32) * 2246822519 >> np.uint32(12)) % np.uint32(PAIRS)
        joined = of[:-1] == of[1:]
        at = of[:-1][joined] * PAIRS + pair[joined]
        x[:, c + 8 :] = np.bincount(at, minlength=total * PAIRS).reshape(total, PAIRS) / np.maximum(length, 1)[:, None]
    return x, n_pass


class Attention:
    """Passages x -> h = tanh(x E); weights softmax(w . (tanh(h V) * sigmoid(h U))) within a text; score sigmoid(z . c + b)."""

    def __init__(self, width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        self.mean, self.sd = np.zeros(width), np.ones(width)
        self.p = {"E": draw(width + 1, hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, n_pass: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        x = np.clip((x - self.mean) / self.sd, -8, 8)
        x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        at = np.cumsum(n_pass) - n_pass
        h = np.tanh(x1 @ p["E"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), n_pass))
        a /= np.repeat(np.add.reduceat(a, at), n_pass)
        z = np.add.reduceat(h * a[:, None], at)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -40, 40)))
        return score, (x1, at, h, t, s, a, z)

    def gradient(self, x: np.ndarray, n_pass: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p = self.p
        score, (x1, at, h, t, s, a, z) = self.forward(x, n_pass)
        gap = (score - y) * weight / weight.sum()
        gap_of = np.repeat(gap, n_pass)
        dz = gap_of[:, None] * p["c"]
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, at), n_pass))
        dgate = ds[:, None] * p["w"]
        dt, dsig = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
        dh = dz * a[:, None] + dt @ p["V"].T + dsig @ p["U"].T
        g = {"E": x1.T @ (dh * (1 - h * h)), "V": h.T @ dt, "U": h.T @ dsig, "w": (t * s).T @ ds, "c": z.T @ gap, "b": np.array([gap.sum()])}
        return {k: v + decay * p[k] * (k != "b") for k, v in g.items()}

    def fit(self, x: np.ndarray, n_pass: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Attention:
        """Full-batch Adam; both labels weigh the same. Always the same for the same rows in the same order."""
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-3
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            for k, g in self.gradient(x, n_pass, y, weight, decay).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
        return self


def _encoder():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([encode([t.as_py()])[0].astype(np.float32).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], names=["doc_id", "label", "x"])

    return run


def _scores(model: Attention | None, texts: pa.Array, chars: int = 1 << 19) -> np.ndarray:
    """Scores of texts, encoded together up to ``chars`` characters at a time, whatever their number."""
    scores: list[np.ndarray] = []
    held: list[str | None] = []
    size = 0
    for i, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size > chars or i == len(texts) - 1:
            scores.append(model.forward(*encode(held))[0] if model else np.full(len(held), 0.5))
            held, size = [], 0
    return np.concatenate(scores) if scores else np.empty(0)


def _scorer(model: Attention | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def train_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 3, held: int = 1, sample_rows: int = 4000, sample_bytes: int = 1 << 26, seed: int = 23,
) -> Attention | None:
    """The model, learnt from at most about ``sample_rows`` labelled rows outside the held-out fold, half of each label.

    Rows are drawn by a hash of the id, and taken in that order while their texts come to ``sample_bytes`` at most, half
    for each label, which bounds what the driver holds (a fifth of it in features); each text taken is whole. Only the
    drawn labels are broadcast, so texts are not shuffled. Ids with conflicting labels, null ids and null labels are
    left out; a null or empty text is one passage without characters; repeated rows count as often. None if a label is
    missing among the rows, as with empty tables: then nothing can be learnt. Other columns are not read.
    """
    clean = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    clean = clean.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    counts = {r.label: r["count"] for r in clean.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = clean.where(u * F.when(F.col("label") == 1, counts[1]).otherwise(counts[0]) < sample_rows / 2)
    drawn = drawn.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label").limit(2 * sample_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "doc_id")
    sizes = rows.groupBy("doc_id", "label").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + PASSAGE).alias("bytes")).withColumn("u", u).orderBy("u").collect()
    left, taken = {0: sample_bytes // 2, 1: sample_bytes // 2}, []
    for r in sizes:
        if r.bytes <= left[r.label]:
            left[r.label] -= r.bytes
            taken.append((r.doc_id,))
    if not taken:
        return None
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id long")
    found = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(_encoder(), "doc_id long, label int, x binary").collect()
    found = sorted((r.doc_id, r.label, bytes(r.x)) for r in found)
    if len({k for _, k, _ in found}) < 2:
        return None
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for _, _, x in found]
    return Attention().fit(np.concatenate(bags).astype(float), np.array([len(b) for b in bags]), np.array([k for _, k, _ in found], float))


def score_quality(docs: DataFrame, model: Attention | None, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``: every passage of the whole text is encoded and weighed.

    A null or empty text is one passage without characters. Without a model every score is 0.5. Ids may be null (not
    held out) or repeat; an empty table gives an empty table; other columns are not read. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held_out, "text").mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Attention | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns, whatever their names.

    A null or empty text is scored as one passage without characters; very long texts by all their passages; a score of
    exactly 0.5 is kept, and without a model so is every row. Repeated rows stay or go together; null ids are no matter;
    an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(model, batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array(score >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
