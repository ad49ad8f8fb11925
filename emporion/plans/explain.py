"""Summarise the physical plans of catalogued queries.

For each query: the static plan's shuffles and join strategies, and — after running it —
the adaptive plan's final join strategies, plus every scan's pruned schema and pushed
filters.  Usage::

    python -m emporion.plans.explain /root/testdata/sf0.1 [query ...] > PLANS.md
"""

from __future__ import annotations

import re
import sys
from collections import Counter

from pyspark.sql import DataFrame

_OPS = ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
        "CartesianProduct", "Exchange hashpartitioning", "Exchange rangepartitioning",
        "Exchange SinglePartition", "BroadcastExchange", "Window", "Generate", "Subquery")


def _count_ops(plan: str) -> Counter:
    c: Counter = Counter()
    for line in plan.splitlines():
        for op in _OPS:
            if op in line:
                c[op] += 1
    return c


def summarize(df: DataFrame, run: bool = True) -> dict:
    qe = df._jdf.queryExecution()
    static = qe.executedPlan().toString()
    formatted = qe.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = re.findall(r"Scan parquet[^\n]*\n(?:.*\n)*?Location: [^\n]*?([\w.]+\.parquet)\]?\n(?:PushedFilters: \[([^\n]*)\]\n)?ReadSchema: (struct<[^\n]*>)", formatted)
    out = {"static": _count_ops(static), "scans": scans}
    if run:
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString()
        out["final"] = _count_ops(final.split("+- == Initial Plan ==")[0])
    return out


def _fmt(c: Counter) -> str:
    return ", ".join(f"{k} ×{v}" for k, v in sorted(c.items())) or "—"


def main(argv: list[str]) -> int:
    from emporion.plans.catalog import queries
    from emporion.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    names = argv[1:]
    spark = build_session("local[8]", shuffle_partitions=8)
    qs = queries()
    print(f"# Physical plans at {sf_dir}\n")
    print("Generated by `python -m emporion.plans.explain`. *Static* is the plan before execution "
          "(what the planner commits to from file-size estimates); *adaptive* is AQE's final plan "
          "after measuring shuffle outputs. Exchange counts are shuffles; a BroadcastExchange is "
          "a side shipped to every task.\n")
    for name in names or list(qs):
        if name.startswith("h9") or name.startswith("h1") and name[2] != "_":
            continue  # model training: not a single plan
        s = summarize(qs[name](spark, sf_dir))
        print(f"## {name}\n")
        print(f"- static: {_fmt(s['static'])}")
        print(f"- adaptive: {_fmt(s.get('final', Counter()))}")
        for table, pushed, schema in s["scans"]:
            pf = f"; pushed: `{pushed}`" if pushed else ""
            print(f"- scan `{table}`: `{schema}`{pf}")
        print()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
