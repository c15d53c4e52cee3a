"""The registered queries agree with their SQL at the smallest scale."""

import pytest

from compare import compare, duck
from bizdiag.plans import registry

SF = "/root/testdata/sf0.001"
FAST = [
    "metric_ratio_by_channel", "metrics_by_date", "compare_previous_period", "series_daily_by_channel", "series_rolling_ratio",
    "contribution_net_revenue_by_channel", "anomaly_events", "staging_coverage_grid", "health_ranks_and_percentile",
    "priority_scale_class", "orders_line_flags", "orders_quality_summary", "case_activity_contribution", "standardise_export",
    "quality_issues", "profile_lineitem",
]


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())
    assert set(FAST) <= set(registry.oracles())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), registry.queries()[name], registry.oracles()[name], SF) == ""


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert len(e.queries()) > 120
