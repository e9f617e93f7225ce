"""Every query with an oracle, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from streamlanes.plans import report_queries  # noqa: F401
from streamlanes.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows):
    return sorted((tuple("null" if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert plain(df.select(columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_detector_query_labels_every_element(spark):
    assert QUERIES["buffered_detector"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
