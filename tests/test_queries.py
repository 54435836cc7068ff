"""Registered queries of the library against their SQL, and hand-made cases."""

import math
import numbers
import os

import numpy as np
import pytest

from papertide.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
            return "null"
        if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)):
            return f"{float(x):.5f}"
        return str(x).removesuffix(" 00:00:00")

    names = sorted(frame.columns)
    return names, sorted(tuple(plain(x) for x in r) for r in frame[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    mine, theirs = rows(catalog.queries()[name](spark, SF).toPandas()), rows(duck.sql(catalog.oracle_sql()[name]).df())
    assert mine == theirs
