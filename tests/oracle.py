"""Run catalogue queries next to their SQL twin in DuckDB and compare."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, name, fn, sql, sf):
    t = time.time()
    df = fn(spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - t
    con = duckdb.connect()
    for tb in TABLES:
        con.execute(f"CREATE VIEW {tb} AS SELECT * FROM '{sf}/{tb}.parquet'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return took, f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in order) for r in res.fetchall()]
    if len(rows) != len(want):
        return took, f"rows {len(rows)} vs {len(want)}"
    if not rows:
        return took, "empty result"

    def key(r):
        return tuple((x is None, str(type(x)), str(x)) for x in r)

    a, b = sorted(rows, key=key), sorted(want, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return took, f"{len(bad)}/{len(a)} differ, e.g. {cols}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return took, None


def main(argv):
    import __spark_entry__ as entry
    from barline.session import local_session

    sf = "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = entry.queries(), entry.oracle_sql()
    picked = [n for n in qs if not argv or any(n.startswith(a) for a in argv)]
    failed = 0
    for n in picked:
        try:
            if n in sqls:
                took, problem = compare(spark, n, qs[n], sqls[n], sf)
            else:
                t = time.time()
                problem = None if qs[n](spark, sf).count() > 0 else "empty result"
                took = time.time() - t
        except Exception as e:  # report and go on
            took, problem = 0, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {took:6.2f}s {'' if n in sqls else '(rows only) '}{n}", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print(f"{len(picked) - failed}/{len(picked)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
