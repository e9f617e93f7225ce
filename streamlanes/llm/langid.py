"""Language identification by unigrams of pieces, all segmentations of a word summed."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

BASE = np.uint64(0x9E3779B97F4A7C15)
BITS = 20
#: Letters after which the forward pass brings its numbers back into range.
RESCALE = 16
#: Longer runs of letters are scored alone, place by place instead of many runs at once; the sum is the same. They are learnt from in stretches of so many letters.
LONG = 256
UNKNOWN = 1e-7
START = "▁"
RUNS = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> list[str]:
    """Runs of letters in lower case; what Python calls alphanumeric but no letter is dropped from them later."""
    return RUNS.findall(text.lower())


class Pieces:
    """Pieces of a public vocabulary, found by rolling hashes over many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.powers = np.array([pow(int(BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        slots = (keys * BASE) >> np.uint64(64 - BITS)
        self.keys, self.ids = [], []  # tables by slot; pieces that share a slot go to further tables
        left = np.arange(len(pieces))
        while len(left):
            k, i = np.zeros(1 << BITS, np.uint64), np.zeros(1 << BITS, np.int32)
            _, first = np.unique(slots[left], return_index=True)
            own = left[first]
            k[slots[own]], i[slots[own]] = keys[own], own + 1
            self.keys.append(k)
            self.ids.append(i)
            left = np.delete(left, first)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """1 + the number of the piece with that hash, 0 where there is none."""
        slots = (h * BASE) >> np.uint64(64 - BITS)
        found = np.zeros(len(h), np.int32)
        for k, i in zip(self.keys, self.ids, strict=True):
            found |= np.where(k[slots] == h, i[slots], 0)
        return found

    def edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, found) over all stretches of words of one length, by end: ``found`` as by ``find``."""
        n = len(words[0])
        codes = np.array([np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) for w in words], np.uint64).reshape(len(words), n)
        prefix = np.zeros((n + 1, len(words)), np.uint64)
        for i in range(n):
            prefix[i + 1] = prefix[i] * BASE + codes[:, i]
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                yield start, end, self.find(prefix[end] - prefix[start] * self.powers[end - start])

    def log_likelihood(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations, for words of one length; ``table`` has a row of 0 and then one for each piece, languages as columns."""
        n, m = len(words[0]), table.shape[1]
        alpha = {0: np.ones((len(words), m))}
        scale = np.zeros((len(words), m))
        for start, end, found in self.edges(words):
            if end not in alpha:
                alpha.pop(end - self.longest - 1, None)
                if end % RESCALE == 0:  # keep numbers in range
                    top = np.where(alpha[end - 1] > 0, alpha[end - 1], 1)
                    scale += np.log(top)
                    for a in alpha.values():
                        a /= top
                alpha[end] = np.zeros((len(words), m))
            some = found > 0
            if some.any():
                alpha[end][some] += alpha[start][some] * table[found[some]]
            if end - start == 1 and not some.all():
                alpha[end][~some] += alpha[start][~some] * UNKNOWN
        return np.log(np.maximum(alpha[n], 1e-300)) + scale

    def long_log_likelihood(self, word: str, table: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
        """What ``log_likelihood`` gives for one word of any length: all its stretches are looked up at once, then one pass runs over its places."""
        n, most, m = len(word), self.longest, table.shape[1]
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        recent, scale = np.zeros((most, m)), np.zeros(m)  # the sums at the last places, the latest first
        recent[0] = 1
        # Hashes of a chunk need the letters before it that a piece may reach back to.
        for s in range(0, n, chunk):
            low, high = max(0, s - most), min(n, s + chunk)
            found = np.zeros((high - s, most), np.int32)
            h = np.zeros(high - low, np.uint64)  # the hash of so many letters that start at each place
            for size in range(1, min(most, high - low) + 1):
                h = h[: high - low - size + 1] * BASE + codes[low + size - 1 : high]
                ends = np.arange(low + size, high + 1)
                own = ends > s
                found[ends[own] - s - 1, size - 1] = self.find(h[own])
            p = table[found]
            p[found[:, 0] == 0, 0] = UNKNOWN
            for i in range(high - s):
                now = (recent * p[i]).sum(axis=0)
                recent[1:] = recent[:-1]
                recent[0] = now
                if (s + i + 1) % RESCALE == 0:
                    top = np.where(now > 0, now, 1)
                    scale += np.log(top)
                    recent /= top
        return np.log(np.maximum(recent[0], 1e-300)) + scale

    def expected(self, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts of words of one length under one language's probabilities ``p`` (row 0 is 0)."""
        edges = [(s, e, f) for s, e, f in self.edges(words)]
        n = len(words[0])
        def step(s: int, e: int, f: np.ndarray) -> np.ndarray:
            return np.where((f == 0) & (e - s == 1), UNKNOWN, p[f])
        alpha, beta = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
        alpha[0] = beta[n] = 1
        for s, e, f in edges:
            alpha[e] += alpha[s] * step(s, e, f)
        for s, e, f in reversed(edges):
            beta[s] += beta[e] * step(s, e, f)
        total, counts = np.maximum(alpha[n], 1e-300), np.zeros(len(p))
        for s, e, f in edges:
            np.add.at(counts, f, weight * alpha[s] * step(s, e, f) * beta[e] / total)
        counts[0] = 0
        return counts


def by_length(words: Iterable[str], most: int = 20_000) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for g in groups.values():
        for i in range(0, len(g), most):
            yield g[i : i + most]


def spm_pieces(path: str) -> list[str]:
    """Pieces of letters in a sentencepiece file, with the mark that starts a word, in lower case as they are."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in found if p.removeprefix(START).isalpha() or p == START})


def marked(run: str) -> str:
    """A run of letters as what is segmented: its letters behind the start mark; empty if it has none."""
    letters = run if run.isalpha() else "".join(c for c in run if c.isalpha())
    return START + letters if letters else ""


def train_pieces(texts: Iterable[tuple[str, str]], vocabulary: Pieces, rounds: int = 2, smooth: float = 200.0) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities by expectation maximisation over (lang, text), smoothed by all languages' mean.

    Every letter is learnt from: of a run longer than ``LONG`` only pieces that lie over a cut between its stretches do
    not count.
    """
    counts: dict[str, Counter] = {}
    for lang, text in texts:
        counts.setdefault(lang, Counter()).update(w[i : i + LONG] for w in map(marked, letters_of(text)) for i in range(0, len(w), LONG))
    langs = sorted(k for k, c in counts.items() if c)
    size = len(vocabulary.pieces) + 1
    start = np.array([0.0] + [10.0 ** (-0.5 * (8 - min(8, len(x)))) for x in vocabulary.pieces])
    learnt = np.zeros((size, len(langs)))
    for j, lang in enumerate(langs):
        p = start / start.sum()
        for _ in range(rounds):
            c = np.zeros(size)
            for words in by_length(counts[lang], 5_000):
                c += vocabulary.expected(words, np.array([counts[lang][w] for w in words], float), p)
            p = (c + 1e-3 * (start > 0)) / (c.sum() + 1e-3 * size)
        learnt[:, j] = c
    if langs:
        shared = learnt.sum(axis=1) + 0.01
        shared[0] = 0
        shared /= shared.sum()
        learnt = (learnt + smooth * shared[:, None]) / (learnt.sum(axis=0) + smooth)
        learnt[0] = 0
    return langs, learnt


class Scorer:
    """Sums words' log-likelihoods of a text; words seen before are looked up in a table of bounded size."""

    def __init__(self, pieces: list[str], table: np.ndarray, cache: int = 400_000):
        self.vocabulary, self.table, self.cache = Pieces(pieces), table, cache
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.values = np.zeros((1024, self.table.shape[1]))

    def learn(self, runs: list[str]) -> None:
        at = len(self.rows)
        if at + len(runs) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros((max(len(self.values), len(runs)), self.values.shape[1]))])
        likely = np.zeros((len(runs), self.values.shape[1]))
        place: dict[str, list[int]] = {}
        for i, w in enumerate(map(marked, runs)):
            if len(w) > LONG:
                likely[i] = self.vocabulary.long_log_likelihood(w, self.table)
            elif w:
                place.setdefault(w, []).append(i)
        for words in by_length(place):
            got = self.vocabulary.log_likelihood(words, self.table)
            for w, v in zip(words, got, strict=True):
                likely[place[w]] = v
        self.values[at : at + len(runs)] = likely
        self.rows.update(zip(runs, range(at, at + len(runs)), strict=True))

    def score(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool]]:
        """For each text its log-likelihoods, and whether it has a letter."""
        cut = [letters_of(t) if t else [] for t in texts]
        if len(self.rows) > self.cache:
            self._clear()
        missing = list({r for rs in cut for r in rs}.difference(self.rows))
        for i in range(0, len(missing), 50_000):
            self.learn(missing[i : i + 50_000])
        out = []
        for runs in cut:
            total = self.values[[self.rows[r] for r in runs]].sum(axis=0) if runs else np.zeros(self.values.shape[1])
            out.append((total, any(map(str.isalpha, runs)) or any(c.isalpha() for r in runs for c in r)))
        return out


_SCORERS: dict[int, Scorer] = {}


def _scorer(pieces: list[str], table: np.ndarray) -> Scorer:
    key = xxhash.xxh3_64_intdigest(table.tobytes())
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(pieces, table)
    return _SCORERS[key]


def _predictor(path: str, langs: list[str], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            lang, score = [], []
            for s in range(0, batch.num_rows, 500):
                texts = batch.column(2).slice(s, 500).to_pylist()
                if langs and scorer is None:
                    scorer = _scorer(spm_pieces(path), table)
                for total, some in scorer.score(texts) if langs else [(None, False)] * len(texts):
                    best = int(np.argmax(total)) if some else -1
                    lang.append(langs[best] if some else "und")
                    score.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()) if some else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_language(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    folds: int = 5, held: int = 0, sample_rows: int = 250, sample_bytes: int = 1 << 24, seed: int = 11,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of ``docs``.

    For every language, piece probabilities over the pieces of ``vocabulary`` (a sentencepiece file) are learnt from
    about ``sample_rows`` rows with that label, drawn by a hash of the id among rows outside the held-out fold; fewer
    where they would come to more than about ``sample_bytes``, and never from a text that is longer by itself. A text
    is its runs of letters in lower case; each run's probability sums all its segmentations by a forward pass over the
    whole run, a text's multiplies its runs'. The likeliest language, all held equally likely before,
    is predicted; ``score`` is its probability. Every text is read whole.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if no labelled row can be
    learnt from. Ids may be null (never learnt from, held_out false) or repeat; equal scores go to the first language
    by name. An empty table gives an empty table; other columns are not read. No shuffle in prediction.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(False))
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    length = F.octet_length("text")
    usable = usable.where(length <= sample_bytes)
    share = F.least(F.lit(float(sample_rows)) / F.count("*"), F.lit(float(sample_bytes)) / F.greatest(F.sum(length), F.lit(1)))
    sizes = usable.groupBy("lang").agg(share.alias("share"))  # one row a language
    drawn = (
        usable.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
        .join(F.broadcast(sizes), "lang").where("u < share").select("lang", "text")
    )
    pieces = spm_pieces(vocabulary)
    langs, table = train_pieces(((r.lang, r.text) for r in drawn.toLocalIterator()), Pieces(pieces))
    return rows.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(_predictor(vocabulary, langs, table), "doc_id long, held_out boolean, lang_pred string, score double")
