"""Compares a query with its SQL in DuckDB."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def expected(sql, sf_dir):
    with duckdb.connect() as con:
        con.sql("SET timezone = 'UTC'")
        for f in Path(sf_dir).glob("*.parquet"):
            con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f / '*.parquet' if os.path.isdir(f) else f}'")
        found = con.sql(sql)
        return sorted(found.columns), rows(found.columns, found.fetchall())


def check(query, sql, spark, sf_dir):
    df = query(spark, sf_dir)
    columns, want = expected(sql, sf_dir)
    assert sorted(df.columns) == columns
    assert rows(df.columns, df.collect()) == want
