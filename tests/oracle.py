"""Compare a query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list):
        return tuple(map(plain, v))
    return str(v)


def rows_of(records, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=lambda r: tuple(map(str, r)))


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), rows_of([dict(zip(columns, r, strict=True)) for r in cursor.fetchall()], sorted(columns))


def assert_same(df, sf_dir, sql):
    columns, expected = sql_rows(sf_dir, sql)
    assert sorted(df.columns) == columns
    assert rows_of([r.asDict() for r in df.collect()], columns) == expected
