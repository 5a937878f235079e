"""Run a registered query on Spark and its SQL twin on DuckDB and compare."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda r: tuple((v is None, "" if v is None else v) for v in r)
    return [cols[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=key)


def same(a, b, tol=2e-6):
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                if math.isnan(u) or math.isnan(v) or abs(u - v) > tol:
                    return f"{x} against {y}"
            elif u != v:
                return f"{x} against {y}"
    return None


def check(spark, con, name, sf_dir):
    """None when equal; also the exact-hash mismatch count is zero then."""
    import __spark_entry__ as entry

    t = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return t, len(got[1]), None if got[1] else "no rows", False
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return t, len(got[1]), f"columns {got[0]} against {want[0]}", True
    types = sorted((c, d) for c, d in df.dtypes)
    spark_kinds = [{"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}[d] for _, d in types]
    duck_kinds = [str(c[1]) for c in sorted(cur.description, key=lambda c: c[0])]
    issue = same(got[1], want[1])
    if issue is None and got[1] != want[1]:
        issue = f"equal within tolerance, {sum(a != b for a, b in zip(got[1], want[1]))} rows differ exactly"
    return t, len(got[1]), issue, True


if __name__ == "__main__":
    from tessella.session import local_session

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    if args and args[0].startswith("sf"):
        sf = f"/root/testdata/{args.pop(0)}"
    names = [n for n in entry.queries() if not args or any(n == a or n.startswith(a + "_") for a in args)]
    spark, con, bad = local_session(8), duck(sf), 0
    for n in names:
        try:
            t, rows, issue, sql = check(spark, con, n, sf)
        except Exception as e:  # report and go on
            t, rows, issue, sql = 0, 0, f"{type(e).__name__}: {str(e)[:1500]}", True
        bad += issue is not None
        print(f"{'FAIL' if issue else 'ok  '} {n:28s} {t:6.2f}s rows={rows} {'' if sql else '(no sql)'} {issue or ''}", flush=True)
    print("failed:", bad, "of", len(names))
