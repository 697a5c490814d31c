"""Every registered profile-matching query with SQL, side by side with DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from matchloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def plain(value):
    if hasattr(value, "tolist") and not hasattr(value, "isoformat"):
        value = value.tolist()
    if isinstance(value, float):
        return f"{value:.9g}"
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, FOLDER)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(names)]) for r in got.collect()) == want


def test_entry_has_every_query():
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
