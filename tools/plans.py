"""Summarise physical plans of registered queries: exchanges, joins, windows, scans, read schemas.

Usage: python tools/plans.py [sf_dir] [--md OUT.md] [name ...]
AQE is switched off so the static plan is shown (AQE may later turn a
shuffle join into a broadcast one from measured sizes).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from locflow.plans.checks import QUERIES  # noqa: E402
from locflow.plans.jobs import all_plans  # noqa: E402
from locflow.session import build_session  # noqa: E402


def summarise(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "windows": plan.count("Window ["),
        "generate": plan.count("Generate "),
        "scans": len(re.findall(r"FileScan parquet", plan)),
        "read": sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*)", plan))),
        "python": any(op in plan for op in ("BatchEvalPython", "ArrowEvalPython")),
    }


def main():
    args = sys.argv[1:]
    md = None
    if "--md" in args:
        i = args.index("--md")
        md = args[i + 1]
        del args[i:i + 2]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)] or sorted(QUERIES)
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false",
                                                                 "spark.sql.adaptive.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    rows = []
    for n in names:
        _, plans = all_plans(lambda: QUERIES[n](spark, sf_dir))
        plan = "\n".join(plans)
        s = summarise(plan) | {"jobs": len(plans)}
        rows.append((n, s))
        print(f"{n:22s} tables={len(plans)} shuffles={s['shuffles']} bcast={s['broadcasts']} smj={s['smj']} bhj={s['bhj']} "
              f"windows={s['windows']} scans={s['scans']} python={s['python']}")
        if os.environ.get("FULL"):
            print(plan)
    if md:
        with open(md, "w") as f:
            f.write("# PLANS\n\nStatic physical plans of the registered queries (`python tools/plans.py --md PLANS.md`, "
                    f"{os.path.basename(sf_dir)}, AQE off so the planned shuffles are visible; at run time AQE may replace a shuffle join "
                    "by a broadcast one from measured sizes and coalesces partitions). Shuffles count every "
                    "keyed `Exchange` (hash, range, single partition) of all jobs of a query: those that write a staged table "
                    "while the query is built, and the last one; `tables` counts them. Reads list the Parquet "
                    "`ReadSchema`s: only the columns a query needs are read.\n\n")
            f.write("| query | tables | shuffles | broadcasts | sort-merge joins | broadcast joins | windows | generators | scans | Python in plan | read columns |\n")
            f.write("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |\n")
            for n, s in rows:
                reads = "; ".join(r.strip()[len("struct<"):-1] for r in s["read"])
                f.write(f"| `{n}` | {s['jobs']} | {s['shuffles']} | {s['broadcasts']} | {s['smj']} | {s['bhj']} | {s['windows']} | "
                        f"{s['generate']} | {s['scans']} | {'yes' if s['python'] else 'no'} | {reads} |\n")


if __name__ == "__main__":
    main()
