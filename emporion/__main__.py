"""Command line: list the query catalogue or run one query.

    python -m emporion                          # list queries
    python -m emporion e2_delay_by_category     # run on /root/testdata/sf0.01, print rows
    python -m emporion e9_rfm_segment_summary /path/to/sf_dir --rows 50
    python -m emporion e2_delay_by_category --explain   # formatted physical plan
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="python -m emporion")
    parser.add_argument("query", nargs="?", help="catalogue key; omit to list them")
    parser.add_argument("sf_dir", nargs="?", default="/root/testdata/sf0.01")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    parser.add_argument("--master", default="local[*]")
    parser.add_argument("--explain", action="store_true", help="print the formatted physical plan instead of rows")
    args = parser.parse_args(argv)

    from emporion.plans.catalog import oracle_sql, queries

    qs = queries()
    if not args.query:
        sql = oracle_sql()
        for name, fn in qs.items():
            doc = (fn.__doc__ or "").strip().splitlines()
            print(f"{name:34s} {'sql' if name in sql else '   '}  {doc[0] if doc else ''}")
        return 0
    if args.query not in qs:
        print(f"unknown query {args.query!r}; run without arguments for the list", file=sys.stderr)
        return 2

    from emporion.session import build_session

    spark = build_session(args.master, app_name=f"emporion-{args.query}")
    df = qs[args.query](spark, args.sf_dir)
    if args.explain:
        df.explain("formatted")
    else:
        df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
