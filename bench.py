"""Benchmark: headline reconciliations at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
Each query is timed end to end (profiling actions + the action producing its
result); the reconciliations write every output (complete sets) to a fresh
folder under the session's checkpoint directory.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tally.plans import queries as Q  # noqa: E402
from tally.plans.fixtures import load  # noqa: E402
from tally.plans.pipeline import reconcile  # noqa: E402
from tally.session import local_session, scratch_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def _sf(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def recon_all(spark, name: str) -> None:
    s, t, fx = load(spark, SF_DIR, name)
    r = reconcile(s, t, fx.spec)
    r.write(scratch_path(spark, f"bench-{name}-{uuid.uuid4().hex[:8]}"))


def count_query(name: str):
    return lambda spark: Q.queries()[name](spark, SF_DIR).count()


def main() -> None:
    spark = local_session(CPUS, int(CPUS) * 2)
    plan = {
        "recon_lines": lambda sp: recon_all(sp, "lines"),
        "recon_orders": lambda sp: recon_all(sp, "orders"),
        "recon_events": lambda sp: recon_all(sp, "events"),
        "discrepancies_lines": count_query("discrepancies_lines"),
        "summary": count_query("summary"),
        "paginate_report": count_query("paginate_report"),
        "detect_numeric_columns": count_query("detect_numeric_columns"),
    }
    # warm-up: JVM start and code generation are not part of any query
    load(spark, SF_DIR, "cust")[0].count()
    times = {}
    for name, fn in plan.items():
        t0 = time.time()
        fn(spark)
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": _sf(SF_DIR)}))


if __name__ == "__main__":
    main()
