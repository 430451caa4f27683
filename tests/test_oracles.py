"""Every query that has an SQL twin gives the twin's rows at sf0.01."""

from __future__ import annotations

import os

import duckdb
import pytest
from conftest import SMALL, rows_of

from pairloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


#: Queries that tests/test_brute.py holds against plain Python, as SQL cannot express them.
WITHOUT_SQL = {"ice_balance", "kr_balance", "boundaries", "compartment_eigenvector", "sample_components", "loop_candidates", "fdr_table", "enriched_peaks", "merge_peaks", "overlap_peaks"}


def test_all_other_queries_have_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == WITHOUT_SQL
