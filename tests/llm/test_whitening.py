"""Whitening against numpy with exact whole numbers."""

import math

import numpy as np
import pytest

from streamlanes.llm.registry import QUERIES
from streamlanes.llm.whitening import whiten


def plain(vectors, k=8):
    """(n, exact deviations, centred rows, covariance) by Python's whole numbers."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    centred = np.array([[(n * c - t) / n for c, t in zip(r, s, strict=True)] for r in x])
    return n, deviation, centred, centred.T @ centred / n


def check(got, vectors, k=8):
    n, deviation, centred, v = plain(vectors)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    white = np.array([r.whitened for r in got])
    want = centred @ axes / np.sqrt(values)
    signs = np.sign((white * want).sum(axis=0))
    assert np.allclose(white, want * signs, atol=1e-7) and white.shape[1] == min(k, len(v))
    assert [int(r.deviation) for r in got] == deviation and {r.n for r in got} == {n}
    assert np.allclose(got[0].explained, values / np.trace(v), rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error <= 1e-6
    c = white - white.mean(axis=0)
    assert abs(got[0].identity_error - np.abs(c.T @ c / n - np.eye(white.shape[1])).max()) < 1e-9


def test_matches_numpy(spark):
    rng = np.random.default_rng(1)
    for d, rows in ((16, 400), (3, 50), (130, 300)):
        x = (rng.standard_normal((rows, d)) @ rng.standard_normal((d, d)) * 0.3 + rng.standard_normal(d)).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist(), "n", 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, x string, deviation double").repartition(3)
        check(whiten(df).orderBy("vec_id").collect(), x)


def test_numbers_beyond_64_bits_stay_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 4)) * np.array([1e9, 2e9, 3e8, 1e9])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    check(whiten(df).orderBy("vec_id").collect(), x)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<double>"
    good = [[0.1, 0.2], [0.3, -0.1], [0.5, 0.4], [0.5, 0.4]]
    odd = [None, [], [0.1, None], [float("nan"), 1.0], [float("inf"), 1.0], [1e300, 1.0], [1.0, 2.0, 3.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(odd)] + [(None, [0.9, 0.9]), (3, [0.5, 0.4])]
    got = whiten(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["0", "1", "2", "3", "3", "None"] and {r.n for r in got} == {6}
    check(sorted(got, key=lambda r: [0, 1, 2, 3, None].index(r.vec_id)), [*good, [0.5, 0.4], [0.9, 0.9]])
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same] == [(0, [], [], None)] * 2
    flat = whiten(spark.createDataFrame([(i, [float(i), float(2 * i), 0.0]) for i in range(9)], schema)).collect()
    assert {len(r.whitened) for r in flat} == {1} and flat[0].explained[0] == pytest.approx(1)  # two axes without variance
    for empty in ([], [(1, None)]):
        assert whiten(spark.createDataFrame(empty, schema)).count() == 0


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_svd_whitening"](spark, sf).collect()
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    assert len(got) == 8 * len(rows) and {r.component for r in got} == set(range(1, 9))
    n, deviation, centred, v = plain([r.embedding for r in rows])
    exact = dict(zip([r.vec_id for r in rows], deviation, strict=True))
    assert all(r.deviation == exact[r.vec_id] and r.n == n for r in got)
    values = np.linalg.eigvalsh(v)[::-1]
    assert all(abs(r.explained / (values[r.component - 1] / np.trace(v)) - 1) < 1e-9 and r.identity_error < 1e-6 for r in got)
