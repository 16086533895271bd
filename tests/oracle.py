"""Compare named queries with their SQL in DuckDB: ``python tests/oracle.py [sf_dir] [name ...]``."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql, sf_dir):
    """Empty text when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = canonical([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first: {bad[0]}"
    return "" if got[1] else "both sides are empty"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from eventmetrics.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(queries())
    spark = build_session("oracle", master="local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        begin = time.time()
        sql = oracle_sql().get(name)
        try:
            if sql is None:
                found = queries()[name](spark, sf_dir).count()
                verdict = f"{found} rows, no SQL"
            else:
                verdict = compare(spark, con, queries()[name], sql, sf_dir) or "ok"
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += verdict != "ok" and "no SQL" not in verdict
        print(f"{name:28} {time.time() - begin:6.2f}s  {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
