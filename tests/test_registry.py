from pathlib import Path

import duckdb
import pytest

from sparklode.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("events", "documents", "conversations", "pages"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_oracle(spark, db, name):
    ours = registry.QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = db.sql(registry.ORACLES[name])
    assert sorted(theirs.columns) == columns
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert order([tuple(r[c] for c in columns) for r in ours.collect()]) == order([tuple(r[theirs.columns.index(c)] for c in columns) for r in theirs.fetchall()])
