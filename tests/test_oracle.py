"""Every catalogue query against its DuckDB oracle on sf0.001 (the driver's
check runs the same comparison at sf0.01)."""
import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF0001

sys.path.insert(0, os.path.join(ROOT, "scripts"))
import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402

from satledger.plans import catalog, oracle  # noqa: E402

KEYS = sorted(oracle.SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF0001, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(oracle.SQL)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF0001)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    sc, sh, _ = digest(df.columns, srows)
    dc, dh, _ = digest(dcols, drows)
    assert sc == dc
    assert len(srows) == len(drows)
    assert sh == dh


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["sender", "total_sats", "boost_count", "first_boost", "tier"]
    assert df.count() > 0
