"""Every registered query of the engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from quarryline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def _rows(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    assert got
    if name in registry.ORACLE_SQL:
        found = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert _rows(got) == _rows([tuple(r[names.index(c)] for c in columns) for r in found.fetchall()])
