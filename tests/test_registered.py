"""Registered queries against their SQL on small tables.

``tools/compare.py`` runs all of them at any scale.
"""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry
from gradecut.plans import files, oracles, workloads

QUERIES, ORACLES = workloads.QUERIES | files.QUERIES, oracles.ORACLES | files.ORACLES
FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registry.queries()) and set(ORACLES) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, str(FOLDER))
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert multiset(df.columns, df.collect()) == multiset(columns, cursor.fetchall())


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["candidate_id", "county", "media", "answerable", "clears", "tight", "open", "aside"]
    assert df.count() > 0
