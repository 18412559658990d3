"""Every core query of the registry against its SQL counterpart on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from waymill.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="session")
def engine(data):
    db = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def cells(rows, order):
    text = lambda v: None if v is None or v != v else str(v)
    return sorted((tuple(text(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, data, engine, name):
    df = QUERIES[name](spark, data)
    cursor = engine.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert cells(df.collect(), order) == cells([dict(zip(names, r, strict=True)) for r in cursor.fetchall()], order)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert rows and len(rows) == len(set(rows))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
