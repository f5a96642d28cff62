"""Runs registered queries beside their SQL and compares the rows: python tests/compare.py FOLDER [NAME...]"""

import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def difference(con, spark, folder: str, name: str) -> str:
    """Empty if Spark and DuckDB agree; a query without SQL is a difference."""
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, folder)
    mine = rows_of(got.columns, got.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"no SQL ({sum(mine.values())} rows)"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only Spark {list((mine - theirs).items())[:3]}, only SQL {list((theirs - mine).items())[:3]}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
    con = connect(sys.argv[1])
    for n in names:
        began = time.time()
        try:
            found = difference(con, session, sys.argv[1], n)
        except Exception as error:
            found = f"{type(error).__name__} {str(error)[:600]}"
        print(f"{n}: {'ok' if not found else 'DIFFERS ' + found} ({time.time() - began:.1f} s)", flush=True)
