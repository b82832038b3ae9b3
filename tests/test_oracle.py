"""Each query with SQL gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest

from corvane import catalog
from tests.compare import same

#: Queries whose order or values hang on floats, compared on ten times the rows as well.
LARGER = ["agg_3", "chk_16", "ev_1", "ev_2", "fu_2", "fu_3", "fu_11", "gr_6", "ltr_1", "sel_1", "sp_2", "win_5"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    found = {}
    for sf in ("sf0.001", "sf0.01"):
        con = found[sf] = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for path in glob.glob(f"{sf_dir.replace('sf0.001', sf)}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


def compare(spark, at, con, name):
    got = catalog.queries()[name](spark, at)
    want = con.execute(catalog.oracle_sql()[name])
    assert same(got.columns, [tuple(r) for r in got.collect()], [c[0] for c in want.description], want.fetchall()) is None


#: Ids that stand for one thing share their SQL and their function; one of them is run.
NAMES = sorted({sql: name for name, sql in sorted(catalog.oracle_sql().items(), reverse=True)}.values())


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, sf_dir, duck, name):
    compare(spark, sf_dir, duck["sf0.001"], name)


@pytest.mark.parametrize("name", LARGER)
def test_rows_equal_sql_on_more_rows(spark, sf_dir, duck, name):
    compare(spark, sf_dir.replace("sf0.001", "sf0.01"), duck["sf0.01"], name)
