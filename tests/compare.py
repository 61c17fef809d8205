"""Comparison of a query with its checking SQL over one folder of tables."""

from __future__ import annotations

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _rows(columns: list[str], rows: list) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted(repr([row[i] for i in order]) for row in rows))


def spark_rows(frame) -> tuple[list[str], list[str]]:
    return _rows(frame.columns, [tuple(row) for row in frame.collect()])


def sql_rows(connection, sql: str) -> tuple[list[str], list[str]]:
    result = connection.execute(sql)
    return _rows([d[0] for d in result.description], result.fetchall())
