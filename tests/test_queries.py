"""Every query of the core runs over the smallest tables; where it has SQL, the rows are those of the SQL."""

import math
import os
import re
from pathlib import Path

import duckdb
import pytest

from letterloom.plans import registry

TABLES = os.environ.get("QUERY_TABLES", "/root/testdata/sf0.001")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value if isinstance(value, (bool, int)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for p in Path(TABLES).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return db


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tables, name):
    df = registry.queries()[name](spark, TABLES)
    got = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    want = tables.execute(re.sub(r";\s*$", "", sql))
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, want.fetchall())
