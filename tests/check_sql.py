"""Runs registered queries against their SQL: python tests/check_sql.py [key prefix ...] [--sf DIR]."""

import math
import os
import sys
import time
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)
    return [columns[i] for i in order], data


def kinds(rows):
    if not rows:
        return []
    out = []
    for i in range(len(rows[0])):
        seen = {type(r[i]).__name__ for r in rows if r[i] is not None}
        out.append("/".join(sorted(seen)))
    return out


def compare(spark, con, sf_dir, build, sql):
    """None where equal, else a text that tells the difference."""
    frame = build(spark, sf_dir)
    mine = table(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None if mine[1] else "no rows", len(mine[1])
    found = con.execute(sql)
    theirs = table([d[0] for d in found.description], found.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}", len(mine[1])
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}", len(mine[1])
    if kinds(mine[1]) != kinds(theirs[1]):
        return f"kinds {list(zip(mine[0], kinds(mine[1]), kinds(theirs[1])))}", len(mine[1])
    off = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if off:
        a, b = off[0]
        cols = [(c, x, y) for c, x, y in zip(mine[0], a, b) if x != y]
        return f"{len(off)} values differ, first {cols} in {a[:4]}", len(mine[1])
    return None, len(mine[1])


def main(argv):
    from moodstream.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf_dir = argv[at + 1]
        argv = argv[:at] + argv[at + 2 :]
    import __spark_entry__ as entry

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for key, build in queries.items():
        if argv and not any(key.startswith(p) for p in argv):
            continue
        began = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, build, sql.get(key))
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", 0
        bad += problem is not None
        mark = "ok" if problem is None else "BAD"
        print(f"{mark:4} {key:40} {n:8} rows {'sql' if key in sql else 'rows-only':9} {time.time() - began:6.2f}s", flush=True)
        if problem:
            print("     " + problem, flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
