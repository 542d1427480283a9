"""Summarise the physical plan of every registered query: join strategies, shuffles, and what
reaches the Parquet scans. Optionally write the full formatted plans to a folder.

    python tools/plan_report.py [sf_dir] [--write docs/plans]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spendguard.registry import QUERIES  # noqa: E402
from spendguard.session import local_session  # noqa: E402

JOINS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def plan_text(df) -> str:
    """The physical plan; for an executed adaptive plan only its final part."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def summary(text: str) -> dict:
    return {
        "joins": {j: text.count(j + " ") for j in JOINS if text.count(j + " ")},
        "shuffles": len(re.findall(r"\bExchange (hashpartitioning|SinglePartition|RoundRobin|rangepartitioning)",
                                   text)),
        "broadcasts": text.count("BroadcastExchange"),
        "subqueries": text.count("Subquery subquery"),
        "reused_subqueries": text.count("ReusedSubquery"),
    }


def main() -> None:
    args = sys.argv[1:]
    out = None
    if "--write" in args:
        i = args.index("--write")
        out = args[i + 1]
        del args[i:i + 2]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session(8)
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.collect()  # runs this DataFrame's own query, so its plan below is the final adaptive one
        print(f"{name:34s} {summary(plan_text(df))}")
        if out:
            os.makedirs(out, exist_ok=True)
            buf = io.StringIO()
            with contextlib.redirect_stdout(buf):
                df.explain("formatted")
            with open(os.path.join(out, f"{name}.txt"), "w") as fh:
                fh.write(buf.getvalue())


if __name__ == "__main__":
    main()
