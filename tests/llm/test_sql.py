"""Operators that have SQL against it, on the smallest tables."""

import duckdb
import pytest

from quiverql.llm import queries


@pytest.mark.parametrize("name", ["op4_mixing"])
def test_sql(spark, data, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        db.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    frame = queries.queries()[name](spark, data)
    asked = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in asked.description]
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(plain, frame.select(*names).collect()), key=repr) == sorted(map(plain, asked.fetchall()), key=repr)
