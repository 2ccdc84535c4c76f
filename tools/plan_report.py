"""Summarise the executed plan of every registered batch query (PLANS.md).

For each key: number of shuffles (Exchange), which operators feed a
single-partition exchange (only aggregates / top-N should), broadcasts, the
columns each parquet scan reads and the filters pushed into it.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from ticklens.plans import registry  # noqa: E402
from ticklens.session import build_session  # noqa: E402

SKIP_PREFIX = ("stream_",)
SKIP = {"write_rollups", "merge_rollups", "append_trades", "retain_stored", "sketched_price_quantiles", "sketched_value_at_risk", "dashboard_bundle"}


def summarise(plan: str) -> dict:
    lines = plan.split("\n")
    single = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            nxt = re.sub(r"^[\s:|+\-*()0-9]*", "", lines[i + 1])
            single.append(nxt.split(" ")[0].split("(")[0])
    # distinct exchanges (a reused subquery's plan is printed at every reference)
    shuffles = len({m.group(1) for m in re.finditer(
        r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)[^\n]*plan_id=(\d+)", plan)})
    broadcasts = len({m.group(1) for m in re.finditer(r"BroadcastExchange [^\n]*plan_id=(\d+)", plan)})
    schemas = sorted({m.group(1) for m in re.finditer(r"ReadSchema: struct<([^>]*)>", plan)})
    pushed = sorted({m.group(1) for m in re.finditer(r"PushedFilters: \[([^\]]*)\]", plan) if m.group(1)})
    codegen = plan.count("WholeStageCodegen") + len(re.findall(r"^\s*[:+\- ]*\*\(\d+\)", plan, re.M))
    return {"shuffles": shuffles, "single": single, "broadcasts": broadcasts, "schemas": schemas,
            "pushed": pushed, "codegen": codegen}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(cpus=os.environ.get("BENCH_CPUS", "*"))
    print("# Plan report\n")
    print(f"Executed (AQE final) plans of every registered batch query at `{sf}`, generated by "
          "`tools/plan_report.py`. *Jobs run* counts every Spark job of the query, planning jobs included; "
          "*exchanges in plan* counts distinct exchange nodes in the printed plan (a scalar subquery's plan is "
          "listed per use, so this over-counts work). *Single-partition inputs* lists the operators feeding each "
          "single-partition exchange: only aggregates and top-N results may meet in one partition. Stream and sink "
          "keys run their own jobs and are not listed.\n")
    print("| Query | Jobs run | Exchanges in plan | Single-partition inputs | Broadcasts | Scan reads | Pushed filters |")
    print("|---|---|---|---|---|---|---|")
    sc = spark.sparkContext
    for key in sorted(registry.queries()):
        if key.startswith(SKIP_PREFIX) or key in SKIP:
            continue
        sc.setJobGroup(f"plan-{key}", key)
        df = registry.queries()[key](spark, sf)          # planning jobs (counts, samples) count too
        df.write.format("noop").mode("overwrite").save()
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"plan-{key}"))
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        single = ", ".join(sorted(set(s["single"]))) or "-"  # kinds only
        reads = "<br>".join(s["schemas"]) or "-"
        pushed = "<br>".join(p[:80] for p in s["pushed"]) or "-"
        print(f"| `{key}` | {jobs} | {s['shuffles']} | {single} | {s['broadcasts']} | {reads} | {pushed} |")


if __name__ == "__main__":
    main()
