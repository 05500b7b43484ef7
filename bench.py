"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) names the tables, ``BENCH_CPUS`` (default 8) the cores.
"""

from __future__ import annotations

import json
import os
import time

from knownat import plans
from knownat.session import build_session

HEADLINE = (
    "p2_history_many", "p7_value_as_of", "p13_absence_reason", "p17_anchored_snapshot", "p23_latest_verdict", "i4_macd", "i8_percentile_rank",
    "f1_technical_factor", "f10_signals", "k8_snapshots_over_time", "n1_name_matches", "n8_fair_selection", "n10_title_events", "n13_overlay_points",
    "n14_covered_days", "n16_surge_discovery", "m1_regime", "m5_previous_limits", "l3_selection_v2", "t1_minute_bars", "t7_day_summary",
    "t10_excursion_medians", "r6_take_stop", "b4_grid", "e3_filing_verdicts", "e12_selected_names", "w5_forward_report", "k6_walk_forward", "s3_changed_revisions",
    "s14_clean_text",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = plans.queries()
    # one untimed pass over the scans starts the JVM and the Python workers
    queries["t6_half_hours"](spark, folder).write.format("noop").mode("overwrite").save()
    queries["s14_clean_text"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
