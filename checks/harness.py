"""Runs registered queries on Spark and DuckDB and compares row count, columns and values.

python -m checks.harness [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
from collections import Counter
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, dt.datetime) and (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
        return v.date()
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) and v == int(v):
        return int(v) if not math.isinf(v) else v
    return v


def compare(left_names, left_rows, right_names, right_rows, exact=True):
    if sorted(left_names) != sorted(right_names):
        return f"columns differ: {sorted(left_names)} / {sorted(right_names)}"
    lo, ro = ([sorted(range(len(n)), key=lambda i, n=n: n[i]) for n in (left_names, right_names)])
    left = Counter(tuple(plain(r[i]) for i in lo) for r in left_rows)
    right = Counter(tuple(plain(r[i]) for i in ro) for r in right_rows)
    if left != right:
        a, b = list((left - right).elements()), list((right - left).elements())
        return f"{len(a)} rows only in Spark, {len(b)} only in SQL, of {sum(left.values())}/{sum(right.values())}: {a[:2]} / {b[:2]}"
    return None


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def coarse(kind: str) -> str:
    kind = kind.lower()
    for prefix, name in [("int", "int"), ("big", "int"), ("small", "int"), ("tiny", "int"), ("huge", "huge"), ("double", "double"), ("float", "double"), ("decimal", "decimal"), ("varchar", "text"), ("string", "text"), ("date", "date"), ("timestamp", "ts"), ("bool", "bool")]:
        if kind.startswith(prefix):
            return name
    return kind


def run(spark, folder, names=None, verbose=True):
    from checks import ORACLE, QUERIES

    con = duck(folder)
    bad = {}
    for name in names or QUERIES:
        began = time.time()
        try:
            df = QUERIES[name](spark, folder)
            rows = df.collect()
            spent = time.time() - began
            note = ""
            if name in ORACLE:
                con.execute(ORACLE[name])
                right_names = [d[0] for d in con.description]
                right_kinds = {d[0]: coarse(str(d[1])) for d in con.description}
                problem = compare(df.columns, rows, right_names, con.fetchall())
                kinds = {n: coarse(t) for n, t in df.dtypes}
                if not problem and kinds != {n: right_kinds[n] for n in kinds}:
                    note = " TYPES " + str({n: (kinds[n], right_kinds[n]) for n in kinds if kinds[n] != right_kinds[n]})
            else:
                problem, note = None, " (rows only)"
            if not rows:
                note += " EMPTY"
        except Exception as e:
            problem, rows, spent, note = f"{type(e).__name__}: {str(e)[:1500]}", [], time.time() - began, ""
        if problem:
            bad[name] = problem
        if verbose:
            print(f"{'FAIL' if problem else 'ok  '} {name:32s} {len(rows):7d} rows {spent:6.2f}s{note}{' ' + problem if problem else ''}", flush=True)
    return bad


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from ledgerloom.session import build_session

    session = build_session("checks", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    failed = run(session, f"/root/testdata/sf{args.sf}", args.names or None)
    print(f"{len(failed)} failed: {list(failed)}")
    sys.exit(bool(failed))
