"""Every query with a SQL twin gives what DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from joinlift.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if pd.isna(a) and pd.isna(b):
        return True
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    cols = sorted(got.columns)
    keys = [c for c in cols if not pd.api.types.is_float_dtype(want[c])] or cols
    order = keys + [c for c in cols if c not in keys]
    a = got[order].sort_values(order, ignore_index=True)
    b = want[order].sort_values(order, ignore_index=True)
    for c in cols:
        bad = [i for i, (x, y) in enumerate(zip(a[c], b[c])) if not same(x, y)]
        assert not bad, f"{c}: {a.loc[bad[0]].to_dict()} against {b.loc[bad[0]].to_dict()}"


def test_names_are_consistent():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
