import numpy as np
import pytest

from streamlanes.functions import numeric as num
from streamlanes.operators import motifs, ordering, profile
from streamlanes.operators.detector import BufferedDetector, detect, searcher
from streamlanes.streaming.detector import END, detect_stream


def naive_profile(x, m, factor=1.0):
    n, zone = len(x) - m + 1, int(factor * m)
    z = []
    for i in range(n):
        w = np.array(x[i : i + m])
        v = w.var()
        z.append((w - w.mean()) / np.sqrt(v if v > 0 else 1e-4))
    return np.array([np.clip(min(1 - z[i] @ z[j] / m for j in range(n) if abs(i - j) > zone), 0, 2) for i in range(n)])


def planted(n=400, m=32, at=(60, 250), seed=1):
    rng = np.random.default_rng(seed)
    x, shape = rng.standard_normal(n).cumsum() * 0.2, np.sin(np.arange(m) * 0.7) * 5 + np.arange(m) * 0.3
    for a in at:
        x[a : a + m] = shape + rng.standard_normal(m) * 0.01
    return x


def test_profile_matches_its_definition_and_finds_what_is_planted():
    x = planted()
    d = profile.matrix_profile(x, 32)
    assert np.allclose(d, naive_profile(x, 32), atol=1e-9)
    assert {int(i) for i in np.argsort(d)[:2]} <= {59, 60, 61, 249, 250, 251}
    assert (profile.matrix_profile([1.0] * 40, 8) == 1).all()  # flat: the variance floor, no correlation
    assert profile.matrix_profile([1.0, 2.0], 2).tolist() == [0.0]
    with pytest.raises(ValueError):
        profile.matrix_profile(range(10), 5)


def test_filters_and_lengths():
    d = np.random.default_rng(0).random(50)
    assert len(profile.filtered(d, "GAUSS", 5)) == 50 - 15 + 1
    flat = profile.filtered(np.ones(50), "NORM_LOG", 5)
    assert flat.shape == (36,) and np.ptp(flat) < 1e-9
    assert abs(num.gauss_kernel(9, 2).sum() - 1) < 1e-12
    assert profile.window_lengths(10, 100, 5) == [10, 33, 55, 78, 100]
    assert profile.window_lengths(10, 11, 1) == [11]
    assert list(profile.usable_lengths(30, [10, 20, 40, 50])) == [10, 20, 29]
    assert list(profile.usable_lengths(21, [10, 20, 40])) == [10, 20]


@pytest.mark.parametrize("stretch", [10_000, 37])
def test_tables_and_arrays_agree(spark, monkeypatch, stretch):
    monkeypatch.setattr(ordering, "STRETCH", stretch)
    rows = [(c, p, float(v)) for c, seed in ((0, 1), (1, 5)) for p, v in enumerate(planted(seed=seed))]
    df = spark.createDataFrame(rows, "channel long, pos long, value double")
    for lo, hi in ((0.05, 0.2), (0.3, 0.5)):
        found = motifs.merge_overlaps(motifs.shortest_by_start(motifs.hysteresis(profile.profiles(df, [24, 32]), lo, hi)))
        got = sorted((r.channel, r.start, r.length, round(r.unfitness, 6)) for r in found.collect())
        want = sorted((c, s, n, round(u, 6)) for c, seed in ((0, 1), (1, 5)) for s, n, u in motifs.find_motifs(planted(seed=seed), [24, 32], lo, hi))
        assert got == want and want
        labels = [r.detected for r in motifs.motif_labels(df, found, profile.BUFFER).where("channel = 0").orderBy("pos").collect()]
        assert labels == motifs.expand([w[1:] for w in want if w[0] == 0], 400)


def test_smoothed_profiles_of_tables_are_those_of_arrays(spark):
    x = planted(n=900)
    df = spark.createDataFrame([(0, p, float(v)) for p, v in enumerate(x)], "channel long, pos long, value double")
    for mode in ("GAUSS", "NORM_LOG"):
        want = profile.filtered(profile.matrix_profile(x, 16), mode, 16)
        got = profile.profiles(df, [16], mode=mode, buffer=250, digits=9).orderBy("i").collect()
        assert [r.i for r in got] == list(range(len(want))) and {r.n for r in got} == {len(want)}
        assert np.allclose([r.d for r in got], want, atol=1e-6)


def test_segments_exclude_ends_and_take_the_exit_value():
    d = np.array([0.0, 0.01, 0.02, 0.05, 0.5, 0.01, 0.0])
    assert motifs.segments(d, 4, 0.025, 0.075) == [(1, 4, 0.5), (5, 4, 0.0)]
    assert motifs.segments(d, 4, 0.025, 0.075, "min") == [(1, 4, 0.01), (5, 4, 0.01)]
    assert motifs.segments(np.array([0.0]), 4, 0.1, 0.2) == []


def test_overlaps_are_transitive_and_ties_go_to_the_longest_then_leftmost():
    assert motifs.merged([(0, 5, 0.3), (4, 5, 0.2), (8, 5, 0.2), (20, 3, 0.1)]) == [(4, 5, 0.2), (20, 3, 0.1)]
    assert motifs.merged([(0, 5, 0.2), (4, 9, 0.2)]) == [(4, 9, 0.2)]
    with pytest.raises(ValueError):
        motifs.expand([(0, 5, 0.0), (3, 2, 0.0)], 10)


def test_detector_at_the_buffers_edges():
    calls = []

    def search(values):
        calls.append(len(values))
        return [(2, 4, 0.1), (8, 2, 0.1)]

    for n, want in ((9, 0), (10, 0), (11, 1), (30, 4)):
        calls.clear()
        d = BufferedDetector(10, 0.2, search)
        out = [r for t in range(n) for r in d.feed((t, "NA", 0.0))]
        out += d.finish()
        assert [r[0] for r in out] == list(range(n)) and len(calls) >= want
        if n <= 10:
            assert {r[2] for r in out} == {"NA"}
    with pytest.raises(ValueError):
        BufferedDetector(10, 0.0, search)


def test_detector_carries_a_motif_over_the_edge():
    d = BufferedDetector(10, 0.3, lambda values: [(2, 4, 0.1)])
    out = [r for t in range(11) for r in d.feed((t, "NA", 0.0))]
    assert [r[2] for r in out] == ["NA", "NA", "MOTIF_BEGIN", "MID_MOTIF", "MID_MOTIF", "MID_MOTIF"]
    with pytest.raises(ValueError):
        d.feed((3, "NA", 0.0))


def test_batch_and_stream_give_the_same(spark, tmp_path):
    rows = [(c, p, p * 10, "NA", float(v)) for c in (0, 1) for p, v in enumerate(planted(seed=c + 1))]
    schema = "channel long, pos long, time_ms long, label string, value double"
    df = spark.createDataFrame(rows, schema)
    options = {"size": 150, "purge": 0.3, "lengths": (24, 32), "lo": 0.05, "hi": 0.2}
    batch = sorted(tuple(r) for r in detect(df, **options).collect())
    d = BufferedDetector(150, 0.3, searcher((24, 32), 0.05, 0.2))
    one = [r for x in rows if x[0] == 0 for r in d.feed((x[2], x[3], x[4]))] + d.finish()
    assert [r[1:] for r in batch if r[0] == 0] == one
    for k in range(4):
        part = spark.createDataFrame([r for r in rows if r[1] // 100 == k] + ([(c, 400, 4000, END, 0.0) for c in (0, 1)] if k == 3 else []), schema)
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = detect_stream(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch


def test_profiles_of_long_lanes_are_whole(spark):
    x = planted()
    df = spark.createDataFrame([(0, p, float(v)) for p, v in enumerate(x)], "channel long, pos long, value double")
    got = sorted((r.m, r.buffer, r.i, r.d, r.n) for r in profile.profiles(df, [24, 32], buffer=150).collect())
    want = [(m, 0, i, d, 401 - m) for m in (24, 32) for i, d in enumerate(naive_profile(x, m))]
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]  # those over the edges too
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-6)
    smooth = sorted((r.i, r.d) for r in profile.profiles(df, [24], mode="GAUSS", buffer=150).collect())
    assert np.allclose([d for _, d in smooth], profile.filtered(naive_profile(x, 24), "GAUSS", 24), atol=1e-6)


def direct_profile(x, m):
    """By products of centred and scaled windows."""
    mean, var = profile.rolling(x, m)
    z = (np.lib.stride_tricks.sliding_window_view(x, m) - mean[:, None]) / np.sqrt(m * var)[:, None]
    c, i = z @ z.T, np.arange(len(z))
    c[np.abs(i[:, None] - i[None, :]) <= m] = -np.inf
    return np.clip(1 - c.max(axis=1), 0, 2)


def test_recurrence_keeps_its_digits_and_its_time(monkeypatch):
    import time

    rng = np.random.default_rng(3)
    x = rng.standard_normal(6000).cumsum() * 3 + 40
    x[700:900], x[2000:2100] = 5.0, x[4000:4100]
    took = {}
    for restart in (2048, 10**9):
        monkeypatch.setattr(profile, "RESTART", restart)
        for m in (16, 256):
            took[m] = []
            for _ in range(3):
                began = time.process_time()
                d = profile.matrix_profile(x, m)
                took[m].append(time.process_time() - began)
            assert np.abs(d - direct_profile(x, m)).max() < 1e-9
    assert min(took[256]) < 1.5 * min(took[16])  # sixteen times the window


def test_blocks_meet_as_in_one_series():
    rng = np.random.default_rng(4)
    x = rng.standard_normal(700).cumsum()
    for m, size in ((8, 300), (40, 220), (20, 350)):
        n, zone = 700 - m + 1, m
        top = np.full(n, -np.inf)
        cuts = range(0, 700, size)
        sides = [profile.Windows(x[c : c + size + m - 1], m) for c in cuts]
        for i, a in enumerate(sides):
            for j in range(i, len(sides)):
                ta, tb = profile.closest(a, sides[j], (j - i) * size, zone)
                for k, t in ((i, ta), (j, tb)):
                    top[k * size : k * size + len(t)] = np.maximum(top[k * size : k * size + len(t)], t)
        assert np.allclose(np.clip(1 - top, 0, 2), direct_profile(x, m), atol=1e-9)


def test_many_taps_have_a_plan_of_constant_size(spark):
    rng = np.random.default_rng(5)
    values = {c: rng.standard_normal(n) * 50 + 20 for c, n in ((0, 3000), (1, 25_000), (2, 100))}
    df = spark.createDataFrame([(c, p, float(v)) for c, vs in values.items() for p, v in enumerate(vs)], "channel long, pos long, value double")
    sizes = []
    for k in (7, 300):
        taps = num.gauss_kernel(k, k / 6)
        out = profile.tap_filter(df, taps, 0.5, 2.0)
        sizes.append(len(out._jdf.queryExecution().executedPlan().toString().splitlines()))
        got = {c: [r.y for r in out.where(f"channel = {c}").orderBy("pos").collect()] for c in values}
        for c, vs in values.items():
            want = 0.5 * np.correlate(vs, taps, "valid") + 2.0 if k <= len(vs) else []
            assert len(got[c]) == len(want) and np.allclose(got[c], want, atol=1e-9)
    assert sizes[0] == sizes[1]
    x, taps = rng.standard_normal(5000) + 1000, rng.standard_normal(333)
    assert np.abs(num.sliding_dot(x, taps) - np.correlate(x, taps, "valid")).max() < 1e-9
    assert len(num.sliding_dot([1.0], [1.0] * 80)) == 0 and len(num.sliding_dot(np.ones(80), np.ones(80))) == 1


def test_parts_of_a_lane_fold_as_the_whole_lane_does(spark, monkeypatch):
    from streamlanes.operators import detector

    rng = np.random.default_rng(7)
    shape = np.sin(np.arange(24) * 0.9) * 4
    lanes = {}
    for c, n in ((0, 1500), (1, 1501), (2, 149), (3, 150), (4, 700)):
        x = rng.standard_normal(n).cumsum() * 0.2
        for a in range(30, n - 30, 37 + 11 * c):
            x[a : a + 24] += shape
        lanes[c] = x
    rows = [(c, p, p * 10 + c, "NA", float(v)) for c, x in lanes.items() for p, v in enumerate(x)]
    df = spark.createDataFrame(rows, "channel long, pos long, time_ms long, label string, value double")
    rounds, folder = [], detector._folder

    def counted(*args):
        rounds.append(1)
        return folder(*args)

    monkeypatch.setattr(detector, "_folder", counted)
    options = {"size": 150, "purge": 0.3, "lengths": (24, 32), "lo": 0.05, "hi": 0.2}
    want = sorted(tuple(r) for r in detect(df, **options).collect())
    for span in (150, 400):
        rounds.clear()
        assert sorted(tuple(r) for r in detector.detect_by_parts(df, span=span, **options).collect()) == want
        assert 1 <= len(rounds) <= 6  # of ten parts
    assert sum(r[3] == "MOTIF_BEGIN" for r in want) > 20
    assert detector.detect_by_parts(df.where("false"), **options).count() == 0
