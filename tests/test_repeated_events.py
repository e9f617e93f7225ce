"""The queries that search for motifs, over events that repeat: no pair of blocks is searched, and SQL agrees."""

import duckdb
import pytest
from pyspark.sql import functions as F

from streamlanes.operators import motifs, profile
from streamlanes.plans import registry

SOURCE = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repeated")
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + 1000000 * k AS event_id, ts + to_days(CAST(30 * k AS INTEGER)) AS ts) FROM '{SOURCE}', range(3) t(k)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["motif_labels", "candidate_dedupe", "candidate_merge", "hysteresis_candidates", "matrix_profile"])
def test_repeated_events_are_not_searched_and_agree_with_sql(spark, repeated, monkeypatch, name):
    def refuse(*args):
        def run(table):
            raise AssertionError("a pair of blocks was searched")

        return run

    monkeypatch.setattr(profile, "_pair_profiler", refuse)
    got = registry.QUERIES[name](spark, repeated)
    sql = registry.ORACLES[name].replace("FROM events", f"FROM '{repeated}/events.parquet'")
    want = duckdb.sql(sql)
    plain = lambda rows: sorted(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_only_open_points_are_numbered_by_their_segments(spark, monkeypatch):
    written = []

    def noted(df):
        written.append(staged(df))
        return written[-1]

    staged = motifs.staged
    monkeypatch.setattr(motifs, "staged", noted)
    monkeypatch.setattr("streamlanes.operators.ordering.STRETCH", 5)  # segments and gaps go over edges of parts
    d = [0.0, 0.05, 0.1, 0.3, *[0.3] * 12, 0.02, *[0.12] * 7, 0.01, 0.4, 0.1, 0.0, 0.05]
    rows = spark.createDataFrame([(0, 0, 12, i, v, len(d)) for i, v in enumerate(d)], "channel long, buffer long, m long, i long, d double, n long")
    found = motifs.hysteresis(rows, 0.08, 0.16)
    assert sorted(map(tuple, found.select("start", "unfitness").collect())) == [(1, 0.3), (24, 0.4), (27, 0.05)]
    assert written[1].count() == 12 and written[1].agg(F.sum(F.col("opens").cast("int"))).first()[0] == 3
