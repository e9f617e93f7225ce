import random

import pytest

from streamlanes.streaming.detector import END
from streamlanes.streaming.merge import OrderedMerge, merge_stream


def lanes(seed, n=3):
    rng, rows = random.Random(seed), []
    for c in range(n):
        t = 0
        for p in range(rng.randint(3, 20)):
            t += rng.randint(0, 3)
            rows.append((c, p, t, "NA", float(p)))
    return rows


def test_prefix_and_flush():
    for seed in range(20):
        rows = lanes(seed)
        want = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
        m = OrderedMerge(3)
        out = [x for k in range(0, 20, 4) for x in m.feed([r for r in rows if k <= r[1] < k + 4])]
        edge = min(max(r[2] for r in rows if r[0] == c) for c in range(3))
        emitted = [r[:5] for r in out]
        assert emitted == [r for r in want if r[2] < edge]  # not more, whatever came when
        out += m.feed([(c, 99, 1000, END, 0.0) for c in range(3)])
        assert [r[5] for r in out] == list(range(len(rows))) and [r[:5] for r in out] == want


def test_a_lane_that_has_not_begun_holds_back_and_falling_times_fail():
    m = OrderedMerge(2)
    assert m.feed([(0, 0, 5, "NA", 0.0)]) == []
    with pytest.raises(ValueError):
        m.feed([(0, 1, 4, "NA", 0.0)])


def test_as_a_stream(spark, tmp_path):
    rows, schema = lanes(3), "channel long, pos long, time_ms long, label string, value double"
    for k in range(3):
        part = [r for r in rows if k * 7 <= r[1] < k * 7 + 7]
        part += [(c, 99, 1000, END, 0.0) for c in range(3)] if k == 2 else []
        spark.createDataFrame(part or [(0, 98, 999, END, 0.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    query = merge_stream(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = [tuple(r)[:5] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == sorted(rows, key=lambda r: (r[2], r[0], r[1]))
