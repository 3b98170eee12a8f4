"""List plan shapes that would not survive a large cluster: nested loops, cross joins, single-task windows.

    python tools/plan_review.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from terrascope.plans import catalog  # noqa: E402
from terrascope.session import local_session  # noqa: E402


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--show", action="store_true")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    # Sizes of the test tables say nothing about a cluster: hide them from the planner.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for key, q in catalog.REGISTRY.items():
        if args.keys and key not in args.keys:
            continue
        plan = q.run(spark, f"/root/testdata/sf{args.sf}")._jdf.queryExecution().executedPlan().toString()
        counts = {
            "nested_loop": plan.count("BroadcastNestedLoopJoin"),
            "cartesian": plan.count("CartesianProduct"),
            "single_partition": plan.count("Exchange SinglePartition"),
            "shuffles": len(re.findall(r"Exchange (?:hash|range|Single|Round)", plan)),
            "broadcast": plan.count("BroadcastExchange"),
            "python": len(re.findall(r"ArrowEval|MapInArrow|InPandas", plan)),
            "scans": plan.count("FileScan"),
        }
        print(f"{key:30s} " + " ".join(f"{k}={v}" for k, v in counts.items() if v), flush=True)
        if args.show:
            print(plan)


if __name__ == "__main__":
    main()
