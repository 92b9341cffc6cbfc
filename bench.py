"""Seconds per headline query; prints one JSON line.

Each query runs over the whole tables of $BENCH_SF_DIR on local[$BENCH_CPUS]: one round of
all queries to warm up, then three rounds, of which the median counts. Results are written
to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from taquilla.session import build_session  # noqa: E402
from verification.registry import queries  # noqa: E402

HEADLINE = (
    "daily_monthly_stats",
    "upcoming_matches",
    "stand_comparison",
    "sales_trend",
    "general_summary",
    "dashboard_document",
    "report_match_details",
    "report_revenue_by_stand",
    "report_totals",
    "match_history",
    "user_purchase_summary",
    "user_match_history",
    "user_stand_distribution",
    "user_recent_purchases",
    "match_occupancy",
    "match_stand_summary",
    "ticket_listing",
    "transaction_details",
    "match_timeline",
    "patch_rows",
    "delete_cascade_teams",
    "settle_matches_rows",
    "admit_purchases",
    "check_references_tickets",
    "check_unique",
)
WARM_RUNS = 3


def run_once(spark, query, folder: str) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        extra={
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds = {}
    for name in names:
        run_once(spark, registered[name], folder)
    rounds = [
        {name: run_once(spark, registered[name], folder) for name in names}
        for _ in range(WARM_RUNS)
    ]
    for name in names:
        seconds[name] = round(statistics.median(r[name] for r in rounds), 3)
    print(
        json.dumps(
            {
                "metric": "total median seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
