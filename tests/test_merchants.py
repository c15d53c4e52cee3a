"""Staging, health, priority and dashboard on small frames."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from bizdiag.operators import dashboard, health, priority, staging

STAGED = "month string, merchant_key string, merchant_name_raw string, mapping_status string, coverage_status string, gmv decimal(18,2), cash_sales_amount decimal(18,2), order_count bigint, aftersales_order_count bigint, aftersales_rate double"


def staged(spark, values, unresolved=(), rate=0.1):
    """Rows of {month: {key: gmv}}."""
    rows = []
    for month, cells in values.items():
        for k, v in cells.items():
            rows.append((month, k, k, "UNRESOLVED" if k in unresolved else "ID_MATCHED", "CURRENT", v, v, v, 1, rate))
    schema = STAGED.replace("decimal(18,2)", "bigint")
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("gmv", "cash_sales_amount")})


TREES = {"2026-01": {"oak": 300, "elm": 260, "fir": 90}, "2026-02": {"oak": 225, "elm": None, "fir": 81}, "2026-03": {"oak": 180, "elm": 240, "fir": 30}}
HERBS = {"2026-01": {"anis": 2000, "bay": 900, "cress": 300, "dill": 120, "fennel": 60}, "2026-02": {"anis": 1500, "bay": 240, "cress": None, "dill": 90, "fennel": 70},
         "2026-03": {"anis": 1260, "bay": 150, "cress": None, "dill": 60, "fennel": 40}}


def cell(df, key, month):
    return df.where((F.col("merchant_key") == key) & (F.col("month") == F.lit(date(2026, month, 1)))).first()


def test_health_states_and_runs(spark):
    h = health.health(staged(spark, TREES, {"fir"})).cache()
    assert cell(h, "oak", 1).gmv_mom_quality_status == "INSUFFICIENT_HISTORY"
    assert cell(h, "elm", 2).gmv_quality_status == "MISSING" and cell(h, "elm", 3).gmv_mom is None
    assert cell(h, "fir", 3).gmv_mom_quality_status == "UNRESOLVED_MERCHANT" and cell(h, "fir", 3).gmv_mom is None
    assert cell(h, "oak", 2).gmv_mom == pytest.approx(-0.25)
    assert [cell(h, "oak", m).consecutive_gmv_decline for m in (1, 2, 3)] == [0, 1, 2]
    assert cell(h, "elm", 3).consecutive_gmv_decline == 0
    assert cell(h, "elm", 1).gmv_percentile == pytest.approx(2 / 3) and cell(h, "oak", 1).gmv_rank == 1
    t = health.health_thresholds(h)
    a = health.attention(h, t)
    assert {r.business_attention_status for r in a.where("merchant_key = 'fir'").collect()} == {"DATA_QUALITY_ALERT"}
    assert t.first().order_decline == -0.20  # two resolved falls: too few for a quantile


def test_changes_need_the_calendar_month_but_runs_need_rows(spark):
    h = health.health(staged(spark, {"2026-01": {"oak": 44}, "2026-03": {"oak": 31}}))
    row = cell(h, "oak", 3)
    assert row.gmv_mom is None and row.consecutive_gmv_decline == 1


def test_priority_values(spark):
    p, thresholds = priority.priority(health.health(staged(spark, HERBS, rate=0.01)))
    p = p.cache()
    c, a = cell(p, "cress", 3), cell(p, "anis", 3)
    assert c.priority_level == "DATA_QUALITY_ALERT" and c.gmv_loss is None
    assert (a.gmv_loss, a.previous_gmv, a.current_gmv) == (240, 1500, 1260)
    assert a.merchant_scale == "KEY" and a.diagnostic_dimension_count == len(a.diagnostic_dimensions.split("|"))
    assert thresholds.first().high_loss > 0
    # cress has no previous value; the others lost 240, 90, 30 and 30
    assert (a.regional_previous_gmv, a.regional_current_gmv) == (1900, 1510)
    assert a.regional_gmv_loss_contribution == pytest.approx(240 / 390)
    top = priority.priority_list(p, date(2026, 3, 1)).collect()
    levels = [priority.LEVELS[r.priority_level] for r in top]
    assert levels == sorted(levels) and "cress" not in {r.merchant_key for r in top}
    s = priority.priority_summary(p, date(2026, 3, 1)).first()
    assert (s.valid_merchants, s.current_total, s.previous_total, s.data_quality) == (4, 1510, 1900, 1)


def test_unresolved_rows_are_classed_by_previous_value(spark):
    values = {"2026-01": {k: 70 * i for i, k in enumerate("pqrsz", 1)}, "2026-02": {k: 56 * i for i, k in enumerate("pqrsz", 1)}}
    p = priority.with_impact_and_scale(priority.with_previous(health.health(staged(spark, values, {"z"}))))
    assert cell(p, "z", 2).merchant_scale == "KEY" and cell(p, "z", 2).regional_previous_gmv == 700


def sources(spark):
    cash = spark.createDataFrame(
        [("2026-01", "甲 有限公司", 10.0, 1, "o1"), ("2026-02", "甲有限公司", 20.0, 2, "o1"), ("2026-01", "乙", 5.0, 1, "o2"), ("2026-02", "丙", 7.0, 1, "o3")],
        "month string, name string, cash_sales_amount double, order_count bigint, owner string",
    )
    gmv = spark.createDataFrame(
        [("2026-01", "1", "甲有限公司", 11.0, "r", "g"), ("2026-03", "1", "甲有限公司", 12.0, "r", "g"), ("2026-01", "2", "丙", 1.0, "r", "g"), ("2026-01", "3", "丙", 2.0, "r", "g")],
        "month string, raw_id string, name string, gmv double, region string, owner string",
    )
    after = spark.createDataFrame(
        [("2026-02", "4", "丁", 3, 0.5, "r4", "o4")],
        "month string, raw_id string, name string, aftersales_order_count bigint, aftersales_rate double, region string, owner string",
    )
    money = lambda df, c: df.withColumn(c, F.col(c).cast("decimal(18,2)"))
    return money(cash, "cash_sales_amount"), money(gmv, "gmv"), after


def test_crosswalk_and_grid(spark):
    src = sources(spark)
    cw = {r.merchant_key: r for r in staging.crosswalk(*src).collect()}
    assert {k: r.mapping_status for k, r in cw.items()} == {
        "ID:1": "NAME_MATCHED", "NAME:乙": "UNRESOLVED", "NAME:丙": "UNRESOLVED", "ID:2": "ID_MATCHED", "ID:3": "ID_MATCHED", "ID:4": "ID_MATCHED",
    }
    assert (cw["ID:1"].first_seen_month, cw["ID:1"].last_seen_month) == ("2026-01", "2026-03")
    grid = {(r.merchant_key, r.month): r for r in staging.merchant_month(*src).collect()}
    assert len(grid) == 6 * 3
    state = lambda k: [grid[k, m].coverage_status for m in ("2026-01", "2026-02", "2026-03")]
    assert state("ID:1") == ["NEW", "CURRENT", "CURRENT"]
    assert state("ID:4") == ["MISSING", "NEW", "MISSING"]
    assert state("NAME:乙") == ["UNRESOLVED"] * 3
    assert grid["ID:1", "2026-01"].owner == "o1" and grid["ID:1", "2026-03"].owner == "g"
    assert staging.reconcile(*src, staging.merchant_month(*src)).where("absolute_difference <> 0").count() == 0
    moved = {(r.merchant_key, r.month): r for r in staging.with_month_on_month(staging.merchant_month(*src)).collect()}
    assert moved["ID:1", "2026-02"].mom_cash_sales == 1.0 and moved["ID:1", "2026-03"].mom_gmv is None


def test_duplicate_source_keys_fail(spark):
    cash, gmv, after = sources(spark)
    with pytest.raises(Exception, match="duplicate key in gmv"):
        staging.merchant_month(cash, gmv.unionByName(gmv), after).collect()


def test_wide_to_long(spark):
    wide = spark.createDataFrame([("1", 5, None, 9, 4, 8)], "id string, a202601 int, a202602 int, b202603 int, a199812 int, a202613 int")
    assert sorted(tuple(r) for r in staging.unpivot_months(wide, ["id"], "v").collect()) == [("1", "1998-12", 4), ("1", "2026-01", 5)]


def test_rows_that_cannot_be_placed_are_skipped_and_counted(spark):
    cash, gmv, after = sources(spark)
    more = (cash.unionByName(cash.withColumn("name", F.lit("\u3000"))), gmv.unionByName(gmv.withColumn("raw_id", F.lit(None).cast("string"))),
            after.unionByName(after.withColumn("month", F.lit(" "))))
    assert sorted(map(str, staging.merchant_month(*more).collect())) == sorted(map(str, staging.merchant_month(cash, gmv, after).collect()))
    assert {r.source: (r.row_count, r.skipped) for r in staging.keyless_rows(*more).collect()} == {"cash": (8, 4), "gmv": (8, 4), "after": (2, 1)}


def test_dashboard(spark):
    base = dict(merchant_name="A", owner="O1", merchant_scale="KEY", merchant_mapping_status="ID_MATCHED", data_quality_status="NO_ALERT", diagnostic_dimensions="Trend")
    rows = [
        dict(base, month=date(2026, 4, 1), merchant_key="A", priority_level="PRIORITY", current_gmv=270.0, previous_gmv=300.0, gmv_change_abs=-30.0, gmv_loss=30.0),
        dict(base, month=date(2026, 4, 1), merchant_key="B", owner="O2", priority_level="ATTENTION", current_gmv=75.0, previous_gmv=60.0, gmv_change_abs=15.0, gmv_loss=0.0, diagnostic_dimensions="Service"),
        dict(base, month=date(2026, 5, 1), merchant_key="A", priority_level="PRIORITY", current_gmv=270.0, previous_gmv=300.0, gmv_change_abs=-30.0, gmv_loss=30.0),
        dict(base, month=date(2026, 6, 1), merchant_key="A", priority_level="DATA_QUALITY_ALERT", current_gmv=None, previous_gmv=270.0, gmv_change_abs=None, gmv_loss=None),
    ]
    p = spark.createDataFrame(rows, "month date, merchant_key string, merchant_name string, owner string, merchant_scale string, priority_level string, merchant_mapping_status string, current_gmv double, previous_gmv double, gmv_change_abs double, gmv_loss double, data_quality_status string, diagnostic_dimensions string")
    periods = spark.createDataFrame(
        [(date(2026, 4, 1), "LIKELY_COMPLETE"), (date(2026, 5, 1), "HISTORICAL_SNAPSHOT / PARTIAL_PERIOD"), (date(2026, 6, 1), "COMPLETE")],
        "month date, period_quality_status string",
    )
    assert dashboard.latest_complete_period(p, periods).first().month == date(2026, 4, 1)
    april = dashboard.filter_dashboard(p, date(2026, 4, 1))
    o = dashboard.overview(april).first()
    assert (o.region_gmv, o.region_gmv_previous, o.declining_merchants, o.growth_merchants, o.service_alerts) == (345, 360, 1, 1, 1)
    assert o.gmv_mom == pytest.approx(345 / 360 - 1)
    assert dashboard.overview(dashboard.filter_dashboard(p, date(2026, 6, 1))).first().region_gmv is None
    assert [r.merchant_key for r in dashboard.filter_dashboard(p, date(2026, 4, 1), ["O1"], None, ["PRIORITY"]).collect()] == ["A"]
    assert [r.merchant_key for r in dashboard.top_loss(april).collect()] == ["A"]
    assert [r.merchant_key for r in dashboard.top_growth(april).collect()] == ["B"]
    assert dashboard.quality_rows(p).count() == 1
    labels = {r.month.month: r.period_quality_label for r in dashboard.with_period_quality(p, periods).collect()}
    assert labels == {4: "完整周期候选", 5: "历史快照", 6: "完整周期候选"}


def test_wording(spark):
    text = "Trend: GMV环比-20.0%；Relative Position: 排名变化-3，同月分位5.0%；Order: 订单环比1.0%；Service: 售后率9.0%"
    df = spark.createDataFrame([(text, 2), ("", -2), (None, None), ("Relative Position: 排名变化0，同月分位5.0%", 0)], "t string, n int")
    got = df.select(dashboard.reasons_text(F.col("t")).alias("t"), dashboard.rank_change_text(F.col("n")).alias("n")).collect()
    assert got[0].t == "GMV趋势：GMV环比-20.0%｜相对位置：排名上升3名，同月分位5.0%｜订单：订单环比1.0%"
    assert [r.n for r in got] == ["↓2名", "↑2名", "NULL", "持平"]
    assert got[1].t == got[2].t == "" and "排名持平" in got[3].t


def test_merchant_exports_share_one_pass_over_the_lines(spark):
    from bizdiag.sources.adapters import merchant_sources

    for df in merchant_sources(spark, "/root/testdata/sf0.001"):
        assert df.count() and "l_orderkey" not in df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_merchant_and_month_are_shuffled_once(spark):
    from bizdiag.sources import adapters

    lines = adapters._merchant_lines(spark, "/root/testdata/sf0.001")
    sums = lines.groupBy("l_suppkey", "month").agg(F.sum("gmv"), F.count("*"))
    assert sums._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
