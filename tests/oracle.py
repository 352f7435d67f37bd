"""Run queries on Spark and their SQL on DuckDB over the same files and compare.

    python tests/oracle.py 0.01 [query ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(repr(tuple(r[k] for k in order)) for r in rows)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    found = con.sql(sql)
    return _rows(found.columns, found.fetchall())


def main():
    from session import build

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark, con = build(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            got = spark_rows(queries[name](spark, sf_dir))
        except Exception as problem:
            print(f"FAIL {name}: {str(problem)[:1500]}")
            bad += 1
            continue
        took, start = time.time() - start, time.time()
        if name not in oracles:
            print(f"rows {name}: {len(got[1])} rows {took:.1f}s")
            continue
        want = sql_rows(con, oracles[name])
        same = got == want
        bad += not same
        word = "ok  " if same else "DIFF"
        print(f"{word} {name}: {len(got[1])} rows {took:.1f}s, sql {time.time() - start:.1f}s")
        if not same:
            print("  columns", got[0], want[0], "rows", len(got[1]), len(want[1]))
            extra, missing = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
            print("  only spark", sorted(extra)[:3], "\n  only sql", sorted(missing)[:3])
    print("not equal:", bad)


if __name__ == "__main__":
    main()
