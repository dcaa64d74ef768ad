"""Compare a query with its SQL in DuckDB, as bags of rows."""

import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def bag(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


def same(spark, folder, query, sql):
    assert bag(query(spark, folder).toPandas()) == bag(connection(folder).sql(sql).df())
