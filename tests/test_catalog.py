"""Every query of the catalog against its SQL in DuckDB."""

import math

import duckdb
import pytest

from annexa.plans import catalog, preparation  # noqa: F401
from tests.conftest import SF


def clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([clean(v) for v in r]) for r in got.select(columns).collect())
    assert rows or name in catalog.ORACLE_SQL
    if name in catalog.ORACLE_SQL:
        db = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split():
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted(repr([clean(r[i]) for i in at]) for r in want.fetchall())
