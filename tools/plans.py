"""Summarise the executed physical plan of each report (after AQE).

Usage: python tools/plans.py [sf_dir] [name ...] [--md PLANS.md]
Per report: number of shuffles, broadcasts, joins, windows, sorts, aggregates,
and each parquet scan's columns and pushed filters.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODE = r"(?m)^[\s:|+-]*"
KINDS = [
    ("shuffle", NODE + r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)"),
    ("reused", NODE + r"ReusedExchange"),
    ("broadcast", NODE + r"BroadcastExchange"),
    ("bhj", r"BroadcastHashJoin"),
    ("smj", r"SortMergeJoin"),
    ("window", r"\bWindow \["),
    ("group_limit", r"WindowGroupLimit"),
    ("sort", r"\bSort \["),
    ("hash_agg", r"HashAggregate\("),
    ("sort_agg", r"SortAggregate\("),
    ("cached", NODE + r"(\*\(\d+\) )?InMemoryTableScan"),
    ("python", r"Python|ArrowEval"),
]


def summarise(plan: str) -> dict:
    final = plan.split("== Initial Plan ==")[0]
    out = {k: len(re.findall(p, final)) for k, p in KINDS}
    scans = []
    for line in final.splitlines():
        if "FileScan parquet" not in line:
            continue
        table = re.search(r"/([a-z_]+)\.parquet", line)
        pushed = re.search(r"PushedFilters: (\[[^\]]*\])", line)
        schema = re.search(r"ReadSchema: struct<([^>]*)>", line)
        scans.append(f"{table.group(1) if table else '?'} cols={schema.group(1) if schema else '?'} "
                     f"pushed={pushed.group(1) if pushed else '?'}")
    out["scans"] = sorted(set(scans))
    return out


HEADER = """# PLANS

Executed physical plans (after AQE) of every registered report on `{sf_dir}`, summarised by
`python tools/plans.py {sf_dir} --md PLANS.md`. Counts are nodes of the final adaptive plan:
`shuffle` = exchanges actually run, `reused` = exchanges served from an earlier stage,
`broadcast` / `bhj` = broadcast exchanges / broadcast hash joins (chosen by the planner or AQE
from measured sizes, never by a hint on a growing table), `window`, `group_limit` (map-side and
final top-k per case), `sort`, `hash_agg` / `sort_agg`. No plan contains a Python UDF node.

How to read them at 100 TB:

* The broadcast in most reports is the customer dimension at test size. At scale the planner
  sees its size and uses a sort-merge join on the customer key; AQE splits a hot customer's
  partition of `events`.
* Aggregating reports: partial aggregation before each shuffle; exact distinct counts add one
  shuffle on `(keys, case)`.
* Share reports (`result_dist_*`, `att_*`, `birth_*`, `talk_time_share*`): the group totals are
  an aggregate of the report's own aggregate; AQE reuses that exchange and broadcasts the
  totals, so the attempts are read once.
* First-k reports (`attempt_*`, `birth_missing_cases`) show `group_limit`: each case is cut to its
  first attempts inside every map task before the shuffle by case.
* `cached` = reads of a shared base aggregate (`cache()`): report families (P02 and P05-P09 from
  one aggregation of case bitmaps; P10-P13, P15/P16, P20-P22, P23/P24, P27/P28/P40, P29-P34,
  P35-P39, P43-P46) compute their base once per attempts table; the counts shown for a family
  member include the base's plan the first time. Run as a pack, the additive reports read the
  four bases of `plans/lattice.py` instead.
* `attempts`, `uncategorised` carry the numbering (counts per (case, hour) joined to the rows,
  so the extract is read twice); `attempts_from_loads` reads the rows once and joins the
  offsets that the growing store holds, by a merge hint (their files are small for the hash
  table that a broadcast would make of them). `case_history` / `cases_history` add a
  range-partitioned sort. Reports that never read the attempt number have no window.
* The scans of `attempts_from_loads` name folders of a scratch store.

| report | executed plan |
|---|---|
"""


def main(argv):
    md = None
    if "--md" in argv:
        i = argv.index("--md")
        md = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from dialmetrics.plans import registry
    from dialmetrics.session import build_session

    spark = build_session("local[8]", 8)
    qs = registry.queries()
    table, scan_lines = [], []
    for name in names or list(qs):
        df = qs[name](spark, sf_dir)
        df.collect()  # runs df's own query execution, so its adaptive plan is final
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        counts = " ".join(f"{k}={v}" for k, v in s.items() if k != "scans" and v)
        print(f"### {name}\n{counts}")
        for sc in s["scans"]:
            print(f"  scan {sc}")
        table.append(f"| `{name}` | {counts} |")
        scan_lines.append(f"* `{name}`: " + "; ".join(f"`{x}`" for x in s["scans"]))
    if md:
        with open(md, "w") as fh:
            fh.write(HEADER.format(sf_dir=sf_dir) + "\n".join(table)
                     + "\n\nParquet scans (columns read and filters pushed) per report:\n\n"
                     + "\n".join(scan_lines) + "\n")


if __name__ == "__main__":
    main(sys.argv)
