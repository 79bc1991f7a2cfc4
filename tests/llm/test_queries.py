"""Every query of the training-data problems runs on the smallest tables; those with SQL agree with it."""

import glob
import os

import duckdb
import pytest

from codeloom.llm.queries import ORACLES, QUERIES
from tools.compare import cells

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    mine, cols = cells([tuple(r) for r in df.collect()], df.columns)
    assert len(set(cols)) == len(cols)
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        theirs, names = cells(cur.fetchall(), [x[0] for x in cur.description])
        assert names == cols and mine == theirs
