"""Comparison of a query's rows with those of its SQL."""

import math
import os


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def expected(data, sql):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(data):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{data}/{file}'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def check(spark, data, query, sql):
    found = rows(query(spark, data))
    spark.catalog.clearCache()
    assert found == expected(data, sql)
