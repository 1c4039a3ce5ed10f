"""Every query of the engine against its SQL, on the smallest tables."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from edgeloom.plans import catalogue  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(frame):
    c = sorted(frame.columns)
    return c, sorted(tuple(cell(x) for x in r) for r in frame[c].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
