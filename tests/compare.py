"""A Spark result against DuckDB's, as sets of rows with rounded numbers."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def database(folder: str = DATA):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(spark_df, db, sql):
    relation = db.sql(sql)
    assert sorted(spark_df.columns) == sorted(relation.columns)
    assert rows(spark_df.columns, spark_df.collect()) == rows(relation.columns, relation.fetchall())
