"""Runs a query and its SQL side by side; used by tests and from the command line."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else float(f"{v:.12g}")
        return v

    return sorted(repr(tuple(cell(r[k]) for k in order)) for r in rows)


def differences(spark, con, d, name, query, sql) -> str:
    df = query(spark, d)
    ours, columns = [tuple(r) for r in df.collect()], df.columns
    theirs = con.execute(sql)
    names = [c[0] for c in theirs.description]
    theirs = theirs.fetchall()
    if sorted(columns) != sorted(names):
        return f"{name}: columns {columns} and {names}"
    if len(ours) != len(theirs):
        return f"{name}: {len(ours)} and {len(theirs)} rows"
    for x, y in zip(canonical(ours, columns), canonical(theirs, names)):
        if x != y:
            return f"{name}: {x} and {y}"
    kinds = dict(df.dtypes)
    return "" if "void" not in kinds.values() else f"{name}: void column"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    from stratavec.plans.session import session

    d = sys.argv[1]
    spark, con = session(), connect(d)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            said = differences(spark, con, d, name, queries[name], sql[name]) if name in sql else f"no SQL, {queries[name](spark, d).count()} rows"
        except Exception as x:
            said = f"{type(x).__name__} {str(x)[:600]}"
        print(f"{name} {time.time() - began:.1f}s {said}", flush=True)
