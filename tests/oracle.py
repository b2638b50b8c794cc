"""Side-by-side run of a registered query and its SQL check."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, connection, folder: str, run, sql: str) -> tuple[int, list[str]]:
    """Row count and a list of differences, empty when both sides agree."""
    df = run(spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _rows(names, cursor.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    elif len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    if not problems and got != expected:
        for a, b in zip(got, expected):
            if a != b:
                problems.append(f"{str(a)[:500]} != {str(b)[:500]}")
                if len(problems) == 3:
                    break
    return len(got), problems
