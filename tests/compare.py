"""Compare a Spark result with a DuckDB result: columns by name, rows in any order."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem".split()


def duckdb_over(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def as_bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_bag(df):
    return as_bag(df.columns, [tuple(row) for row in df.collect()])


def duckdb_bag(con, sql):
    result = con.sql(sql)
    return as_bag(result.columns, result.fetchall())


DUCKDB_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def spark_types(df):
    return {name: DUCKDB_TYPES.get(kind, kind) for name, kind in df.dtypes}


def duckdb_types(con, sql):
    result = con.sql(sql)
    return dict(zip(result.columns, map(str, result.types)))
