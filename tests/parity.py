"""Comparing a frame with a DuckDB query, whatever the row and column order."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    return repr(round(value, 6)) if isinstance(value, float) else repr(value)


def rows_of_spark(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(canonical(row[c]) for c in columns) for row in frame.collect())


def rows_of_duck(con, sql, columns):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(columns)]
    return sorted(tuple(canonical(row[i]) for i in at) for row in result.fetchall())
