"""Run catalogued queries in Spark and their oracle SQL in DuckDB and compare the results.

Mirrors the driver's check: row count, column names, and an order-insensitive comparison
of values with columns sorted by name.  Usage::

    python -m emporion.plans.parity /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

from emporion.session import drop_all_scratch
from emporion.sources.adapter import DRIVER_TABLES, driver_path


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = driver_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(cols: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    from emporion.plans.catalog import oracle_sql, queries

    qs, sqls = queries(), oracle_sql()
    con = duckdb_connection(sf_dir)
    report = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
            drop_all_scratch(spark)
        except Exception as e:  # pragma: no cover - reported
            report[name] = {"status": "spark_error", "error": repr(e)[:400]}
            if verbose:
                print(f"{name:40s} SPARK ERROR {repr(e)[:300]}")
            continue
        t_spark = time.time() - t0
        if name not in sqls:
            report[name] = {"status": "no_oracle", "rows": len(s_rows), "spark_s": round(t_spark, 2)}
            if verbose:
                print(f"{name:40s} rows={len(s_rows):7d} (no oracle) {t_spark:6.2f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            d_cols = [c[0] for c in cur.description]
            d_rows = [tuple(r) for r in cur.fetchall()]
        except Exception as e:  # pragma: no cover - reported
            report[name] = {"status": "oracle_error", "error": repr(e)[:400]}
            if verbose:
                print(f"{name:40s} ORACLE ERROR {repr(e)[:300]}")
            continue
        sc, sv = _canon(s_cols, s_rows)
        dc, dv = _canon(d_cols, d_rows)
        ok = sc == dc and sv == dv
        rec = {
            "status": "match" if ok else "mismatch",
            "rows": len(s_rows),
            "oracle_rows": len(d_rows),
            "spark_s": round(t_spark, 2),
        }
        if not ok:
            rec["spark_cols"], rec["oracle_cols"] = sc, dc
            rec["only_spark"] = [list(map(str, k)) for k in (sv - dv)][:5]
            rec["only_oracle"] = [list(map(str, k)) for k in (dv - sv)][:5]
        report[name] = rec
        if verbose:
            print(f"{name:40s} rows={len(s_rows):7d} {rec['status']:9s} {t_spark:6.2f}s")
            if not ok:
                print("   cols", sc, dc)
                print("   only spark ", rec["only_spark"][:3])
                print("   only oracle", rec["only_oracle"][:3])
    return report


def main(argv: list[str]) -> int:
    from emporion.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    rep = compare(spark, sf_dir, argv[1:] or None)
    bad = [k for k, v in rep.items() if v["status"] not in ("match", "no_oracle")]
    print(f"{len(rep) - len(bad)}/{len(rep)} ok; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
