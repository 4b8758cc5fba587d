"""Each query against its SQL on the smallest tables."""

import datetime
from pathlib import Path

import pytest

from siftstone import queries as core

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_its_sql(spark, tables, name):
    got = core.queries()[name](spark, str(DATA))
    want = tables.sql(core.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_other_queries_run(spark, name):
    assert core.queries()[name](spark, str(DATA)).count() > 0


def test_oracles_are_of_queries():
    assert set(core.oracle_sql()) <= set(core.queries())
