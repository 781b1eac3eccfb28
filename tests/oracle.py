"""Runs a query and its SQL over one data directory and compares rows as multisets."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")


def database(path: Path = DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in path.iterdir():
        con.execute(f"CREATE VIEW {file.name.removesuffix('.parquet')} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def same(spark, con, query, sql: str, path: Path = DATA) -> None:
    df = query(spark, str(path))
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:2], list((theirs - ours).items())[:2])
