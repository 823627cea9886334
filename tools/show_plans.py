"""Print the physical-plan skeleton of registered queries: scans (pruned
schema, pushed filters), joins, exchanges, aggregates.

    python tools/show_plans.py /root/testdata/sf0.1 cohort c1l_codelist_events ...
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEYS = ("Scan parquet", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
        "CartesianProduct", "Exchange", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "Generate",
        "ArrowEvalPython", "BatchEvalPython")


def skeleton(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.split("\n"):
        if any(k in line for k in KEYS):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[file:[^\]]*/", "file ", line)
            out.append(line.rstrip()[:200])
        if "FileScan" in line:
            rs = re.search(r"ReadSchema: (struct<[^>]*>)", line)
            pf = re.search(r"PushedFilters: (\[[^\]]*\])", line)
            out.append(re.sub(r"#\d+L?", "", "      FileScan " + line.split("FileScan parquet")[1].split(" Batched")[0]
                              + (" ReadSchema=" + rs.group(1) if rs else "") + (" PushedFilters=" + pf.group(1) if pf else ""))[:200])
    return out


def main():
    from phenospark.session import get_session
    from phenospark.queries import all_queries

    sf, names = sys.argv[1], sys.argv[2:]
    spark = get_session("local[8]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    for n in names:
        print(f"### {n}\n```")
        print("\n".join(skeleton(qs[n](spark, sf))))
        print("```\n")


if __name__ == "__main__":
    main()
