"""Every catalog query against its SQL."""

import datetime

import duckdb
import pytest

from pricelens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


def shown(rows):
    text = lambda v: None if v is None or v != v else f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else v.isoformat() if isinstance(v, datetime.date) else str(v)
    return sorted((tuple(text(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, name):
    frame = registry.QUERIES[name](spark, SF)
    rows = frame.collect()
    if name not in registry.ORACLES:
        return
    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = base.sql(registry.ORACLES[name])
    assert sorted(frame.columns) == sorted(want.columns)
    columns = sorted(frame.columns)
    at = [want.columns.index(c) for c in columns]
    assert shown([[r[c] for c in columns] for r in rows]) == shown([[r[i] for i in at] for r in want.fetchall()])
