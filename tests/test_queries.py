"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    assert compare(got, con.sql(entry_points.oracle_sql()[name]).df()).startswith("ok")


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_names_and_columns():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(entry_points.queries()) > 120


def test_feature_frame_does_not_depend_on_the_path(spark):
    from punctual.plans import features
    from punctual.queries.pipeline import analysis_table

    frame = features.analysis_frame(analysis_table(spark, SF))
    plain, cut = (features.build_feature_frame(frame, ["trip_id"], buckets=b).frame for b in (1, 7))
    assert sorted(plain.columns) == sorted(cut.columns)
    assert plain.exceptAll(cut.select(plain.columns)).count() == 0 and plain.count() == cut.count()
