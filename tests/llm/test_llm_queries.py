"""Every query of the subpackage against its SQL counterpart on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from waymill.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name not in ORACLE:
        return
    db = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = db.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda r: tuple(str(r[k]) for k in sorted(names))
    assert sorted(map(text, rows)) == sorted(text(dict(zip(names, r, strict=True))) for r in cursor.fetchall())
