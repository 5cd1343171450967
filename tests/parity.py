"""Runs registered queries in Spark and their SQL in DuckDB on the same parquet files and compares all rows.

As a script: ``python tests/parity.py [sf folder] [query ...]``.
"""

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, datetime.datetime):
        return value.isoformat(" ")
    if value is None:
        return "\0null"
    return f"{type(value).__name__}:{value}"


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder, query, sql):
    """(rows, difference or None)"""
    return compare_frame(connection, query(spark, str(folder)), sql)


def compare_frame(connection, df, sql):
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(mine[1]), None
    result = connection.execute(sql)
    theirs = table([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return len(mine[1]), f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        left, right = set(mine[1]) - set(theirs[1]), set(theirs[1]) - set(mine[1])
        sample = "\n   spark " + "\n   spark ".join(map(str, sorted(left)[:2]))
        sample += "\n   duck  " + "\n   duck  ".join(map(str, sorted(right)[:2]))
        return len(mine[1]), f"{len(mine[1])} / {len(theirs[1])} rows, {len(left)} / {len(right)} differ{sample}"
    return len(mine[1]), None


def main(folder="/root/testdata/sf0.01", *names):
    import __spark_entry__ as entry

    from breachlens.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection, queries, sql = duck(folder), entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        began = time.time()
        try:
            rows, problem = compare(spark, connection, folder, queries[name], sql.get(name))
        except Exception as error:  # keep going: the report is the point
            rows, problem = 0, f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28} {rows:7} rows {time.time() - began:6.2f} s", problem or "")
    print(f"{failed} bad")


if __name__ == "__main__":
    main(*sys.argv[1:])
