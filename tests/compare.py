"""Run queries and their SQL twins side by side: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "0.0" if v == 0 else repr(v)
        return str(v) if not isinstance(v, int) or isinstance(v, bool) else str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(spark_columns, spark_rows, columns, rows) -> str:
    """Empty when equal, else what differs.  Values must match exactly, whole and real numbers alike."""
    c1, r1 = canonical(spark_columns, spark_rows)
    c2, r2 = canonical(columns, rows)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if len(r1) != len(r2):
        return f"{len(r1)} rows != {len(r2)}"
    diff = [(a, b) for a, b in zip(r1, r2) if a != b]
    return f"{len(diff)} of {len(r1)} rows differ, first {diff[0]}" if diff else ""


def main() -> None:
    from hazeline.plans.oracle import ORACLE
    from hazeline.plans.queries import QUERIES
    from tests.conftest import session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = session()
    bad = 0
    for name in args or QUERIES:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t
            verdict = same(df.columns, rows, *oracle_rows(sf_dir, ORACLE[name])) if name in ORACLE else "rows only"
        except Exception as e:  # report and go on
            took, verdict, rows = time.time() - t, f"{type(e).__name__}: {str(e)[:600]}", []
        bad += verdict not in ("", "rows only")
        print(f"{name:28s} {len(rows):8d} rows {took:6.2f} s  {verdict or 'ok'}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
