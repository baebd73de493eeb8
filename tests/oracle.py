"""A query's rows against those of its DuckDB SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def in_order(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is not None, str(type(x)), x) for x in r])


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, in_order(df.select(*columns).collect())


def duck_rows(sf_dir, sql, threads=4):
    con = duckdb.connect()
    con.execute(f"SET threads = {threads}")
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], in_order([[r[i] for i in order] for r in found.fetchall()])


def check(spark, query, sql, sf_dir):
    """Raises unless both give the same columns and rows; returns the count of rows."""
    columns, rows = spark_rows(query(spark, sf_dir))
    names, other = duck_rows(sf_dir, sql)
    assert columns == names, (columns, names)
    if rows != other:
        odd = [(a, b) for a, b in zip(rows, other) if a != b][:3]
        raise AssertionError(f"{columns}: {len(rows)} and {len(other)} rows, first differences {odd}")
    return len(rows)
