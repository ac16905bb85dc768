"""The registered queries against their SQL, over whole tables."""

import glob
import os

import pytest

from metaseine.llm.queries import ORACLES, QUERIES

SF = os.environ.get("CATALOGUE_SF", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, SF)
    rows = sorted(str(tuple(str(r[c]) for c in sorted(got.columns))) for r in got.collect())
    want = duck.sql(ORACLES[name])
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(got.columns) == sorted(want.columns)
    assert rows == sorted(str(tuple(str(r[i]) for i in order)) for r in want.fetchall())
