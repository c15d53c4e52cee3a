"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Queries named ``fact_*`` run on a stored fact table, as the published baseline does; the others
start from the raw tables and include every join. ``load_fact`` is the time to build the table.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from bizdiag.functions.lineage import release, written
from bizdiag.operators import anomaly, contribution, diagnosis, metrics, trend
from bizdiag.plans import registry
from bizdiag.plans.metric_queries import END, RULES, START
from bizdiag.session import local_session
from bizdiag.sources.adapters import daily_fact

REGISTERED = (
    "metric_ratio_by_channel", "anomaly_events", "staging_coverage_grid", "health_ranks_and_percentile",
    "priority_levels", "orders_monthly_diagnosis", "facts_core_ranked", "standardise_export", "quality_issues",
    "profile_lineitem",
)
YEAR = ("1998-01-01", "1998-12-31")
QUARTER = ("1998-04-01", "1998-06-30")


def on_fact(fact) -> dict:
    """The baseline's queries over a stored fact; each value is a list of DataFrame makers."""
    split = lambda m, d: lambda: contribution.contribution(fact, m, *QUARTER, d)[0]
    events = lambda: anomaly.events(anomaly.evaluate_rules(fact, START, END, RULES))
    return {
        "fact_trend_365_days": [lambda: trend.series(fact, "conversion_rate", *YEAR)],
        "fact_funnel": [lambda: metrics.funnel(fact)],
        "fact_all_metrics": [lambda: metrics.metrics_by(fact, ["leads", "conversion_rate", "net_revenue"], ["channel"])],
        "fact_year_scan_3_rules": [lambda: anomaly.evaluate_rules(fact, *YEAR)],
        "fact_contribution_channel_and_salesperson": [split("gross_revenue", "channel"), split("leads", "salesperson")],
        "fact_diagnosis_all_events": [lambda: diagnosis.diagnose(fact, events()).results],
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bizdiag-bench", os.environ.get("BENCH_MEMORY", "12g"))
    seconds, rows = {}, {}

    def timed(name, make_all) -> None:
        start = time.perf_counter()
        rows[name] = sum(make().toArrow().num_rows for make in make_all)
        seconds[name] = round(time.perf_counter() - start, 3)

    start = time.perf_counter()
    fact = written(daily_fact(spark, sf_dir))
    seconds["load_fact"] = round(time.perf_counter() - start, 3)
    for name, makers in on_fact(fact).items():
        timed(name, makers)
    for name in REGISTERED:
        timed(name, [lambda name=name: registry.queries()[name](spark, sf_dir)])
    n_events = max(rows["fact_diagnosis_all_events"], 1)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "rows": rows,
                "diagnosis_sec_per_event": round(seconds["fact_diagnosis_all_events"] / n_events, 6),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
