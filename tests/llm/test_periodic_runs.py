"""Periodic runs against a brute-force version, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np

from streamlanes.llm.periodic_runs import periodic_runs, repeated_cover, runs_of
from streamlanes.llm.registry import QUERIES


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w, least=12):
    """Every period in turn: longest stretches in which words so far apart agree, without those a smaller period explains."""
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_match_every_period_in_turn():
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        alphabet = "abcdefghij"[: rng.choice((1, 2, 2, 3, 5, 10))]
        w = rng.choices(alphabet, k=rng.randint(0, 90))
        if rng.random() < 0.5 and w:  # a repeated piece, broken here and there
            piece = rng.choices(alphabet, k=rng.randint(1, 20))
            w += piece * rng.randint(1, 6) + piece[: rng.randrange(len(piece))]
            w[rng.randrange(len(w))] = rng.choice(alphabet + "z")
        texts.append(w)
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts += [list(fib[-1]), list(thue), ["a"] * 700, list("ab" * 300) + list("ba" * 200)]
    for least in (12, 2, 3, 5, 7):
        ids = np.array([ord(x) for w in texts for x in w])
        starts = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        got = {}
        for t, s, n, q in runs_of(ids, starts, least).tolist():
            got.setdefault(t, []).append((s, n, q))
        for t, w in enumerate(texts):
            assert got.get(t, []) == plain_runs(w, least), (least, t)
        shared = repeated_cover(ids, starts, (least + 1) // 2)
        for t, rs in got.items():
            assert all(shared[starts[t] + s : starts[t] + s + n].all() for s, n, _ in rs)


def test_odd_rows(spark):
    schema = "doc_id long, text string, runs int, collapsed string, TEXT_ string"
    long = " ".join(f"w{i}" for i in range(200_000)) + " x y" * 50_000
    rows = [(1, None), (2, ""), (3, " \t\x0b "), (None, "a " * 12), (4, "a " * 11), (5, "A a " * 6), (5, "A a " * 6), (6, long), (7, "é b " * 20), (8, "\x1c " * 12)]
    df = spark.createDataFrame([(i, t, 1, "c", "d") for i, t in rows], schema)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=str)
    want = sorted(((i, len(w := plain_words(t)), rs := [(200_000, 100_000, 2)] if i == 6 else plain_runs(w), plain_collapse(w, rs)) for i, t in rows), key=str)
    assert got == want
    assert periodic_runs(df.where("false")).count() == 0


def plain_query(doc_id, text):
    w = plain_words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs_fast(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(plain_collapse(w, runs)))


def plain_runs_fast(w, least=12):
    """``plain_runs`` of long texts, a period at a time by numpy."""
    ids = np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if w else np.empty(0, int)
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        at, end = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        for i, j in zip(at.tolist(), end.tolist(), strict=True):
            if j - i >= max(q, least - q):
                found.setdefault((i, j + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op13_masked_runs"](spark, sf).collect()}
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert tuple(got[d.doc_id][c] for c in columns) == plain_query(d.doc_id, d.text), d.doc_id
    assert sum(r.n_runs > 0 for r in got.values()) > 50
