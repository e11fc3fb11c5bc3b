"""Every registered query of the core against its SQL twin, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lamina.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    if isinstance(value, dict):
        return str([plain(v) for v in value.values()])
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, twin, name):
    got = QUERIES[name](spark, SF)
    want = twin.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    rows = lambda found, names: sorted(tuple(plain(r[names.index(c)]) for c in order) for r in found)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), columns)
