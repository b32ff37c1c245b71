"""Write PLANS.md: the physical plans of selected queries after AQE ran.

    python -m tests.show_plans [sf_dir] [key ...]
"""

from __future__ import annotations

import sys

from tidepool.plans.catalog import QUERIES
from tidepool.session import build_session

DEFAULT = ["triage_queue", "anti_seen_news", "sync_tables", "first_accepted_attempt",
           "near_dup_vs_latest", "keep_one_reply", "dim_settings", "term_frequencies", "near_dup_pairs"]


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    keys = argv[2:] or DEFAULT
    spark = build_session("local[8]", 16)
    out = ["# Physical plans (after execution, AQE final plans)", "",
           f"Generated by `python -m tests.show_plans {sf_dir}`; `local[8]`, AQE on.", ""]
    for k in keys:
        df = QUERIES[k](spark, sf_dir)
        df.collect()   # run this very plan so AQE settles it (small outputs only)
        plan = df._jdf.queryExecution().executedPlan().toString()
        out += [f"## {k}", "", "```", plan.strip(), "```", ""]
    with open("PLANS.md", "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main(sys.argv)
