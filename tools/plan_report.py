"""Physical-plan audit of every registered query (``explain("formatted")``).

Writes a Markdown table: shuffles, broadcasts, aggregate kinds, windows, sorts and
anything that would not scale (nested-loop / cartesian joins, sort-based aggregates).
usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultbench.plans.queries import QUERIES  # noqa: E402
from faultbench.session import build_session  # noqa: E402

PATTERNS = {
    "shuffles": r"^\(\d+\) Exchange\b",
    "broadcasts": r"^\(\d+\) BroadcastExchange\b",
    "hash_aggs": r"^\(\d+\) HashAggregate\b",
    "sort_aggs": r"^\(\d+\) SortAggregate\b",
    "object_aggs": r"^\(\d+\) ObjectHashAggregate\b",
    "windows": r"^\(\d+\) Window\b",
    "smj": r"^\(\d+\) SortMergeJoin\b",
    "bhj": r"^\(\d+\) BroadcastHashJoin\b",
    "nested_loop": r"^\(\d+\) (BroadcastNestedLoopJoin|CartesianProduct)\b",
    "scans": r"^\(\d+\) Scan parquet\b",
}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    qs = dict(QUERIES)
    print("# Physical plans of the registered queries\n")
    print(f"`explain(\"formatted\")` at `{sf}` (AQE initial plans; counts of plan nodes, "
          "including subqueries and cached sub-plans). Generated by `tools/plan_report.py`.\n")
    print("| query | " + " | ".join(PATTERNS) + " | widest scan (columns) |")
    print("|---|" + "---|" * (len(PATTERNS) + 1))
    flagged = []
    for name in qs:
        df = qs[name](spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode="formatted")
        text = buf.getvalue()
        counts = {k: len(re.findall(p, text, re.M)) for k, p in PATTERNS.items()}
        # A sort-based aggregate only sorts when it has grouping keys.
        keyed_sort = re.findall(r"^\(\d+\) SortAggregate\n(?:.*\n)*?Keys \[\d+\]: \[", text, re.M)
        if counts["nested_loop"] or keyed_sort:
            flagged.append(name)
        widths = [len(re.findall(r"[A-Za-z_]+:", m)) for m in re.findall(r"^ReadSchema: struct<(.*)>$", text, re.M)]
        print(f"| {name} | " + " | ".join(str(counts[k]) for k in PATTERNS) + f" | {max(widths, default=0)} |")
    print()
    print("Queries with a nested-loop/cartesian join or a keyed sort-based aggregate: "
          + (", ".join(flagged) if flagged else "none") + ".")


if __name__ == "__main__":
    main()
