"""Comparison of a query with its SQL."""

import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _row(columns, row):
    return tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for _, v in sorted(zip(columns, row)))


def agree(frame, connection, sql):
    """The same columns and the same rows, in any order."""
    answer = connection.execute(sql)
    columns = [d[0] for d in answer.description]
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(_row(frame.columns, r) for r in frame.collect()) == sorted(_row(columns, r) for r in answer.fetchall())
