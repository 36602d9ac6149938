"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py [prefix…]``."""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int,)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=str)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b
    return a == b and type(a) is type(b)


def compare(spark_df, con, sql):
    rows = [tuple(r) for r in spark_df.collect()]
    left = canonical(spark_df.columns, rows)
    cur = con.execute(sql)
    right = canonical([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}", len(rows)
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}; spark {left[1][:2]} sql {right[1][:2]}", len(rows)
    bad = [(a, b) for a, b in zip(left[1], right[1]) if not all(same(x, y) for x, y in zip(a, b))]
    return (f"{len(bad)} rows differ: {bad[:2]}" if bad else None), len(rows)


def main(argv):
    import __spark_entry__ as entry
    from driftgauge.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in sorted(queries):
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                problem, n = None, len(df.collect())
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1200]}", -1
        mark = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{mark:5} {name} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
