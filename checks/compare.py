"""Run registered Spark queries and their DuckDB oracles side by side.

    python -m checks.compare [sf_dir] [key ...]

Prints one line per key: row counts, column names, and whether the sorted
rows agree (floats compared to 1e-9 relative).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from checks.oracle_sql import SQL
from quarry.catalog import REGISTRY
from quarry.session import build_session
from quarry.sources.tables import TABLES


def norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def key(row):
    return tuple((v is None, str(type(v).__name__) if v is not None else "", v if v is not None else 0)
                 if not isinstance(v, (list, dict)) else (False, "list", str(v)) for v in row)


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        try:
            return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
        except TypeError:
            return False
    return a == b


def run(sf_dir, keys):
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = REGISTRY[k](spark, sf_dir)
            cols = sorted(df.columns)
            srows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in SQL:
            print(f"{k:28s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(SQL[k])
            dcols = [d[0] for d in cur.description]
            drows_raw = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} DUCKDB ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        idx = [dcols.index(c) if c in dcols else None for c in cols]
        if None in idx or len(dcols) != len(cols):
            print(f"{k:28s} COLUMNS spark={cols} duck={sorted(dcols)}")
            bad += 1
            continue
        drows = [tuple(norm(r[i]) for i in idx) for r in drows_raw]
        sa, sb = sorted(srows, key=key), sorted(drows, key=key)
        ok = len(sa) == len(sb) and all(all(same(x, y) for x, y in zip(r1, r2)) for r1, r2 in zip(sa, sb))
        if not ok:
            bad += 1
            diff = [(r1, r2) for r1, r2 in zip(sa, sb) if not all(same(x, y) for x, y in zip(r1, r2))][:3]
            print(f"{k:28s} MISMATCH rows spark={len(sa)} duck={len(sb)} cols={cols} first={diff}")
        else:
            print(f"{k:28s} ok rows={len(sa)} {ts:.1f}s")
    print(f"failed: {bad} of {len(keys)}")
    return bad


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    ks = sys.argv[2:] or list(REGISTRY)
    sys.exit(1 if run(sf, ks) else 0)
