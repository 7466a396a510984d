"""Comparison of a query with its DuckDB statement: rows as multisets, columns by name."""

from __future__ import annotations

import os
from collections import Counter
from glob import glob

DATA = os.environ.get("MURMUR_TEST_DATA", "/root/testdata/sf0.001")


def connection(sf: str = DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if x != x else round(x, 5)
    if hasattr(x, "as_py"):
        return _value(x.as_py())
    return tuple(_value(y) for y in x) if isinstance(x, list) else x


def bag(table) -> Counter:
    names = sorted(table.column_names)
    columns = [[_value(v) for v in table.column(n).to_pylist()] for n in names]
    return Counter(zip(*columns)) if columns else Counter()


def same(spark, query, sql: str, sf: str = DATA) -> None:
    mine = query(spark, sf).toArrow()
    theirs = connection(sf).sql(sql).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    a, b = bag(mine), bag(theirs)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
