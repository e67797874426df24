"""Rows of a Spark query and of its SQL, in one form."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)[:10]
    return str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(row[i]) for i in order] for row in found), key=str)


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect())


def sql_rows(sql, folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return sorted(names), rows(names, result.fetchall())
