"""Every registered query against its DuckDB oracle (driver-style check)."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from tidemart import registry  # noqa: E402
from compare import duck, rows_of  # noqa: E402

registry.load_marts()
NAMES = sorted(registry.QUERIES)
SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "float": "FLOAT"}
ORACLES = registry.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle_or_a_reason():
    rows_only = set()
    assert set(NAMES) - set(ORACLES) == rows_only


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = E.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert len(rows) > 0
        return
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]).replace(" ", "") for d in cur.description}
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    for col, t in df.dtypes:   # same column types in both engines
        assert dtypes[col] == SPARK_TO_DUCK.get(t, t.upper().replace(" ", "")), (col, t, dtypes[col])
    assert len(rows) == len(drows)
    assert rows_of(df.columns, rows) == rows_of(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"category", "net_revenue", "gross_profit", "units_sold", "avg_margin"}
