"""Run registered queries and their SQL side by side: python tools/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from flowkit.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: list(v) if isinstance(v, (list, tuple)) else v
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, folder, query, sql):
    """Empty text when both agree, else what differs."""
    df = query(spark, folder)
    got = _rows(df.columns, df.collect())
    if sql is None:
        return "" if got else "no rows", len(got)
    rel = con.sql(sql)
    want = _rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    for g, w in zip(got, want):
        if repr(g) != repr(w):
            return f"values {g} != {w}", len(got)
    return "", len(got)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def main() -> int:
    from flowkit.catalog import QUERIES, SQL

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(QUERIES)
    names = [q for q in QUERIES if any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    spark, con, bad = local_session(8), connect(folder), 0
    for name in names:
        t = time.time()
        try:
            problem, n = compare(spark, con, folder, QUERIES[name], SQL.get(name))
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok" if name in SQL else "ok (rows only)")
        print(f"{mark:15} {name:32} {n:7} rows {time.time() - t:6.1f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
