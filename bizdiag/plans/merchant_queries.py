"""Registered queries on merchant staging, health, priority and the regional dashboard."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from bizdiag.functions.lineage import written
from bizdiag.operators import dashboard, health, priority, staging
from bizdiag.plans.edge import edge
from bizdiag.plans.oracle import sql
from bizdiag.sources.adapters import merchant_month, merchant_sources, table, wide_gmv

QUERIES, ORACLES = {}, {}
MONTH, MONTH_SQL = date(1998, 5, 1), "DATE '1998-05-01'"


def query(name: str, oracle: str | None = None):
    """Register a query and, when there is one, its SQL."""
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle)
        return f
    return add


def dbl(*columns: str) -> str:
    """Money columns as double."""
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


# ------------------------------------------------------------------ staging
def with_keyless(cash, gmv, after):
    """The sources, and each row again without what it is placed by."""
    blank, none = F.lit("\u3000 "), F.lit(None).cast("string")
    return (
        cash.unionByName(cash.withColumn("name", blank)), gmv.unionByName(gmv.withColumn("raw_id", none)),
        after.unionByName(after.withColumn("month", none)),
    )


@query("staging_wide_to_long", f"SELECT raw_id, name, month, {dbl('gmv')} FROM src_gmv")
def _(spark, sf):
    return edge(staging.unpivot_months(wide_gmv(spark, sf), ["raw_id", "name"]))


@query(
    "staging_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
)
def _(spark, sf):
    return edge(staging.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query(
    "staging_crosswalk",
    """SELECT merchant_key, merchant_id_raw, merchant_name_raw, LOWER(merchant_name_raw) AS merchant_name_normalized, first_seen_month, last_seen_month,
  CASE WHEN merchant_id_raw IS NULL THEN 'NAME_MATCHED' ELSE 'ID_MATCHED' END AS mapping_method, mapping_status FROM stg_crosswalk""",
)
def _(spark, sf):
    return edge(staging.crosswalk(*with_keyless(*merchant_sources(spark, sf))))


@query(
    "staging_keyless_rows",
    """SELECT 'cash' AS source, 2 * COUNT(*) AS row_count, COUNT(*) AS skipped FROM src_cash UNION ALL SELECT 'gmv', 2 * COUNT(*), COUNT(*) FROM src_gmv
UNION ALL SELECT 'after', 2 * COUNT(*), COUNT(*) FROM src_after""",
)
def _(spark, sf):
    return edge(staging.keyless_rows(*with_keyless(*merchant_sources(spark, sf))))


GRID = (
    "month", "merchant_key", "merchant_id_raw", "merchant_name_raw", "region", "owner", "cash_sales_amount", "gmv",
    "order_count", "aftersales_order_count", "aftersales_rate", "mapping_status", "coverage_status",
)


@query(
    "staging_coverage_grid",
    f"SELECT month, merchant_key, merchant_id_raw, merchant_name_raw, region, owner, {dbl('cash_sales_amount', 'gmv')}, order_count, aftersales_order_count, aftersales_rate, mapping_status, coverage_status FROM stg_grid",
)
def _(spark, sf):
    return edge(staging.merchant_month(*merchant_sources(spark, sf)), *GRID)


@query(
    "staging_source_lineage",
    """SELECT g.month, g.merchant_key, CONCAT_WS(' | ', CASE WHEN a.month IS NOT NULL THEN 'aftersales' END, CASE WHEN g.cash_sales_amount IS NOT NULL OR g.order_count IS NOT NULL THEN 'cash' END,
  CASE WHEN g.gmv IS NOT NULL THEN 'gmv' END) AS source_file
FROM stg_grid AS g LEFT JOIN src_after AS a ON 'ID:' || a.raw_id = g.merchant_key AND a.month = g.month""",
)
def _(spark, sf):
    cash, gmv, after = merchant_sources(spark, sf)
    named = lambda df, n: df.withColumn("source_file", F.lit(n))
    df = staging.merchant_month(named(cash, "cash"), named(gmv, "gmv"), named(after, "aftersales"))
    return edge(df, "month", "merchant_key", "source_file")


@query(
    "staging_month_on_month",
    """SELECT c.month, c.merchant_key, CAST(c.gmv AS DOUBLE) / NULLIF(CAST(p.gmv AS DOUBLE), 0) - 1 AS mom_gmv,
  CAST(c.cash_sales_amount AS DOUBLE) / NULLIF(CAST(p.cash_sales_amount AS DOUBLE), 0) - 1 AS mom_cash_sales
FROM stg_grid AS c LEFT JOIN stg_grid AS p ON p.merchant_key = c.merchant_key AND p.month = STRFTIME(CAST(c.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')""",
)
def _(spark, sf):
    df = staging.with_month_on_month(staging.merchant_month(*merchant_sources(spark, sf)))
    return edge(df, "month", "merchant_key", "mom_gmv", "mom_cash_sales")


@query(
    "staging_ranks",
    """SELECT month, merchant_key, CASE WHEN gmv IS NOT NULL THEN RANK() OVER (PARTITION BY month ORDER BY gmv DESC NULLS LAST) END AS merchant_rank_gmv,
  CASE WHEN cash_sales_amount IS NOT NULL THEN RANK() OVER (PARTITION BY month ORDER BY cash_sales_amount DESC NULLS LAST) END AS merchant_rank_cash_sales FROM stg_grid""",
)
def _(spark, sf):
    df = staging.with_staging_ranks(written(staging.merchant_month(*merchant_sources(spark, sf))))
    return edge(df, "month", "merchant_key", "merchant_rank_gmv", "merchant_rank_cash_sales")


@query(
    "staging_reconciliation",
    """SELECT s.month, s.metric, CAST(s.total AS DOUBLE) AS source_total, CAST(t.total AS DOUBLE) AS staging_total, CAST(t.total - s.total AS DOUBLE) AS absolute_difference,
  CAST(t.total - s.total AS DOUBLE) / NULLIF(CAST(s.total AS DOUBLE), 0) AS difference_rate
FROM (SELECT month, 'gmv' AS metric, SUM(gmv) AS total FROM src_gmv GROUP BY 1 UNION ALL SELECT month, 'cash_sales_amount', SUM(cash_sales_amount) FROM src_cash GROUP BY 1
  UNION ALL SELECT month, 'order_count', SUM(order_count) FROM src_cash GROUP BY 1 UNION ALL SELECT month, 'aftersales_order_count', SUM(aftersales_order_count) FROM src_after GROUP BY 1) AS s
JOIN (SELECT month, 'gmv' AS metric, SUM(gmv) AS total FROM stg_grid GROUP BY 1 UNION ALL SELECT month, 'cash_sales_amount', SUM(cash_sales_amount) FROM stg_grid GROUP BY 1
  UNION ALL SELECT month, 'order_count', SUM(order_count) FROM stg_grid GROUP BY 1 UNION ALL SELECT month, 'aftersales_order_count', SUM(aftersales_order_count) FROM stg_grid GROUP BY 1) AS t
  ON t.month = s.month AND t.metric = s.metric""",
)
def _(spark, sf):
    sources = merchant_sources(spark, sf)
    return edge(staging.reconcile(*sources, staging.merchant_month(*sources)))


@query(
    "staging_metric_coverage",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, COUNT({m}) AS non_null_rows, COUNT(*) AS total_rows, CAST(COUNT({m}) AS DOUBLE) / COUNT(*) AS non_null_rate FROM stg_grid"
        for m in staging.METRICS
    ),
)
def _(spark, sf):
    return edge(staging.coverage(staging.merchant_month(*merchant_sources(spark, sf))))


@query(
    "staging_mapping_summary",
    """SELECT COUNT(*) AS merchants, COUNT(*) FILTER (WHERE mapping_status = 'ID_MATCHED') AS id_matched, COUNT(*) FILTER (WHERE mapping_status = 'NAME_MATCHED') AS name_matched,
  COUNT(*) FILTER (WHERE mapping_status = 'UNRESOLVED') AS unresolved, CAST(COUNT(*) FILTER (WHERE mapping_status <> 'UNRESOLVED') AS DOUBLE) / COUNT(*) AS success_rate FROM stg_crosswalk""",
)
def _(spark, sf):
    return edge(staging.mapping_summary(staging.crosswalk(*merchant_sources(spark, sf))))


# ------------------------------------------------------------------ health
def health_rows(spark, sf):
    """Health rows as a written table: thresholds and signals read it several times."""
    return written(health.health(merchant_month(spark, sf)))


KEY_SQL = "CAST(month AS VARCHAR) AS month, merchant_key"


def _quality(c: str) -> str:
    return f"CASE WHEN mapping_status = 'UNRESOLVED' THEN 'UNRESOLVED_MERCHANT' WHEN {c} IS NULL THEN 'MISSING' ELSE 'VALID' END"


@query(
    "health_quality_status",
    "SELECT " + KEY_SQL + ", " + ", ".join(f"{_quality(c)} AS {c}_quality_status" for c in health.BASE)
    + ", CASE WHEN mapping_status = 'UNRESOLVED' THEN 'UNRESOLVED_MERCHANT' WHEN "
    + " OR ".join(f"{c} IS NULL" for c in health.BASE) + " THEN 'MISSING' ELSE 'VALID' END AS metric_quality_status FROM m_months",
)
def _(spark, sf):
    df = health.health(merchant_month(spark, sf))
    return edge(df, "month", "merchant_key", *[f"{c}_quality_status" for c in health.BASE], "metric_quality_status")


@query("health_ranks_and_percentile", f"SELECT {KEY_SQL}, gmv_rank, cash_sales_rank, gmv_percentile FROM h_base")
def _(spark, sf):
    return edge(health.health(merchant_month(spark, sf)), "month", "merchant_key", "gmv_rank", "cash_sales_rank", "gmv_percentile")


CHANGES = ("gmv_mom", "cash_sales_mom", "order_count_mom", "aftersales_rate_mom")
_state = lambda c, p: f"CASE WHEN mapping_status = 'UNRESOLVED' THEN 'UNRESOLVED_MERCHANT' WHEN {c} IS NULL THEN 'MISSING' WHEN {p} IS NOT NULL THEN 'VALID' ELSE 'INSUFFICIENT_HISTORY' END"


@query(
    "health_changes",
    f"""SELECT {KEY_SQL}, {', '.join(CHANGES)}, gmv_rank_change, {_state('gmv', 'p_gmv')} AS gmv_mom_quality_status, {_state('cash_sales_amount', 'p_cash')} AS cash_sales_mom_quality_status,
  {_state('order_count', 'p_orders')} AS order_count_mom_quality_status, {_state('aftersales_rate', 'p_rate')} AS aftersales_rate_mom_quality_status FROM h_all""",
)
def _(spark, sf):
    df = health.health(merchant_month(spark, sf))
    return edge(df, "month", "merchant_key", *CHANGES, "gmv_rank_change", *[f"{c}_quality_status" for c in CHANGES])


@query("health_consecutive_declines", f"SELECT {KEY_SQL}, consecutive_gmv_decline FROM h_run")
def _(spark, sf):
    return edge(health.health(merchant_month(spark, sf)), "month", "merchant_key", "consecutive_gmv_decline")


def rounded(df, *columns):
    """Interpolated quantiles differ in the last bit between engines."""
    return df.select(*[F.round(c, 6).alias(c) for c in columns])


THRESHOLDS = (
    "gmv_decline", "cash_decline", "order_decline", "rank_drop", "aftersales_high", "aftersales_worsening",
    "order_rise_for_divergence", "low_gmv_percentile",
)


@query("health_thresholds", "SELECT " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in THRESHOLDS) + " FROM h_thr")
def _(spark, sf):
    return rounded(health.health_thresholds(health_rows(spark, sf)), *THRESHOLDS)


def attention_rows(spark, sf):
    """Attention signals over the written health rows."""
    h = health_rows(spark, sf)
    return health.attention(h, health.health_thresholds(h))


@query(
    "health_attention_signals",
    f"""SELECT {KEY_SQL}, CAST(n_business AS BIGINT) AS priority_score, severity, business_attention_status, data_quality_status,
  CONCAT_WS('|', CASE WHEN n_business > 0 THEN 'BUSINESS_ALERT' END, CASE WHEN n_quality > 0 THEN 'DATA_QUALITY_ALERT' END) AS attention_reason_types,
  CASE WHEN NOT known THEN 'UNRESOLVED_MERCHANT' ELSE CONCAT_WS('；', CASE WHEN latest AND gmv IS NULL THEN '近期GMV缺失' END, CASE WHEN latest AND cash_sales_amount IS NULL THEN '近期现金额缺失' END) END AS data_quality_reasons
FROM h_attention""",
)
def _(spark, sf):
    return edge(
        attention_rows(spark, sf), "month", "merchant_key", "priority_score", "severity", "business_attention_status",
        "data_quality_status", "attention_reason_types", "data_quality_reasons",
    )


_pct = lambda c: f"FORMAT('{{:.1f}}%', ROUND(100 * {c}, 1))"


@query(
    "health_attention_reasons",
    f"""SELECT {KEY_SQL}, CASE WHEN NOT known THEN 'UNRESOLVED_MERCHANT' ELSE CONCAT_WS('；',
  CASE WHEN s1 THEN 'GMV环比明显下降(' || {_pct('gmv_mom')} || ')' END, CASE WHEN s2 THEN 'GMV排名恶化(' || CAST(gmv_rank_change AS VARCHAR) || '名)' END,
  CASE WHEN s3 THEN 'GMV处于同月区域低分位' END, CASE WHEN s4 THEN '售后率处于同月区域高位' END, CASE WHEN s5 THEN '售后率明显恶化(' || {_pct('aftersales_rate_mom')} || ')' END,
  CASE WHEN s6 THEN '订单数明显下降(' || {_pct('order_count_mom')} || ')' END, CASE WHEN s7 THEN 'GMV下降与订单数上升方向背离' END,
  CASE WHEN s8 THEN 'GMV连续下降' || CAST(consecutive_gmv_decline AS VARCHAR) || '个月' END,
  CASE WHEN latest AND gmv IS NULL THEN '近期GMV缺失' END, CASE WHEN latest AND cash_sales_amount IS NULL THEN '近期现金额缺失' END) END AS attention_reasons FROM h_attention""",
)
def _(spark, sf):
    return edge(attention_rows(spark, sf), "month", "merchant_key", "attention_reasons")


@query(
    "health_attention_sample",
    f"""SELECT {KEY_SQL}, CAST(n_business AS BIGINT) AS priority_score, gmv_mom FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY month ORDER BY n_business DESC, gmv_mom ASC NULLS LAST, merchant_key) AS rn
  FROM h_attention WHERE business_attention_status <> 'NO_ALERT') AS t WHERE rn <= 15""",
)
def _(spark, sf):
    return edge(health.attention_sample(attention_rows(spark, sf)), "month", "merchant_key", "priority_score", "gmv_mom")


@query(
    "health_alert_counts",
    """SELECT CAST(month AS VARCHAR) AS month, COUNT(*) FILTER (WHERE business_attention_status = 'BUSINESS_ALERT') AS business_alert,
  COUNT(*) FILTER (WHERE business_attention_status = 'DATA_QUALITY_ALERT') AS data_quality_alert, COUNT(*) FILTER (WHERE business_attention_status <> 'NO_ALERT') AS total_attention_rows FROM h_attention GROUP BY 1""",
)
def _(spark, sf):
    return edge(health.alert_counts(attention_rows(spark, sf)))


# ------------------------------------------------------------------ priority
def priority_rows(spark, sf):
    """Priority rows and thresholds over the attention rows, which ``priority`` reads once."""
    return priority.priority(attention_rows(spark, sf))


P_KEY = ("month", "merchant_key")


@query(
    "priority_previous_values",
    f"""SELECT {KEY_SQL}, {dbl('previous_gmv', 'gmv_change_abs')}, CASE WHEN gmv_change_abs IS NOT NULL THEN CAST(gmv_loss0 AS DOUBLE) END AS gmv_loss, p_rank AS rank_previous,
  p_orders AS previous_order_count, gmv_rank_change FROM p_prev""",
)
def _(spark, sf):
    df = priority.with_previous(health.health(merchant_month(spark, sf)))
    return edge(df, *P_KEY, "previous_gmv", "gmv_change_abs", "gmv_loss", "rank_previous", "previous_order_count", "gmv_rank_change")


@query(
    "priority_regional_impact",
    f"""SELECT {KEY_SQL}, {dbl('regional_previous_gmv', 'regional_current_gmv', 'regional_gmv_loss')}, CAST(gmv_loss AS DOUBLE) / CAST(regional_gmv_loss AS DOUBLE) AS regional_gmv_loss_contribution, previous_gmv_share FROM p_impact""",
)
def _(spark, sf):
    df = priority.with_impact_and_scale(priority.with_previous(health_rows(spark, sf)))
    return edge(df, *P_KEY, "regional_previous_gmv", "regional_current_gmv", "regional_gmv_loss", "regional_gmv_loss_contribution", "previous_gmv_share")


@query("priority_scale_class", f"SELECT {KEY_SQL}, merchant_scale FROM p_impact")
def _(spark, sf):
    df = priority.with_impact_and_scale(priority.with_previous(health_rows(spark, sf)))
    return edge(df, *P_KEY, "merchant_scale")


P_THRESHOLDS = (
    "severe_gmv_mom", "severe_order_mom", "high_loss", "important_share", "rank_drop", "high_aftersales",
    "aftersales_worsening", "order_rise_divergence", "low_percentile",
)


@query(
    "priority_thresholds",
    """SELECT ROUND(severe_gmv_mom, 6) AS severe_gmv_mom, ROUND(severe_order_mom, 6) AS severe_order_mom, ROUND(high_loss, 6) AS high_loss, ROUND(important_share, 6) AS important_share,
  ROUND(rank_drop_p, 6) AS rank_drop, ROUND(high_aftersales, 6) AS high_aftersales, ROUND(aftersales_worsening_p, 6) AS aftersales_worsening,
  ROUND(order_rise_divergence, 6) AS order_rise_divergence, CAST(0.2 AS DOUBLE) AS low_percentile FROM p_thr""",
)
def _(spark, sf):
    base = priority.with_impact_and_scale(priority.with_previous(health_rows(spark, sf)))
    return rounded(priority.priority_thresholds(base), *P_THRESHOLDS)


@query("priority_diagnostic_dimensions", f"SELECT {KEY_SQL}, diagnostic_dimensions, CAST(n_dims AS BIGINT) AS diagnostic_dimension_count FROM p_all")
def _(spark, sf):
    return edge(priority_rows(spark, sf)[0], *P_KEY, "diagnostic_dimensions", "diagnostic_dimension_count")


@query(
    "priority_levels",
    f"""SELECT {KEY_SQL}, priority_level, CASE WHEN priority_level IN ('PRIORITY', 'ATTENTION', 'WATCHLIST') THEN 'BUSINESS_ALERT' ELSE priority_level END AS attention_pool,
  CAST(COALESCE(gmv_loss, 0) AS DOUBLE) AS priority_sort_loss, COALESCE(previous_gmv_share, 0) AS priority_sort_share FROM p_all""",
)
def priority_levels(spark, sf):
    return edge(priority_rows(spark, sf)[0], *P_KEY, "priority_level", "attention_pool", "priority_sort_loss", "priority_sort_share")


@query(
    "priority_list_of_month",
    f"""SELECT merchant_key, priority_level, merchant_scale, CAST(COALESCE(gmv_loss, 0) AS DOUBLE) AS priority_sort_loss FROM p_all WHERE month = {MONTH_SQL} AND priority_level IN ('PRIORITY', 'ATTENTION', 'WATCHLIST')
ORDER BY CASE priority_level WHEN 'PRIORITY' THEN 1 WHEN 'ATTENTION' THEN 2 ELSE 3 END, CASE merchant_scale WHEN 'KEY' THEN 1 WHEN 'MID' THEN 2 WHEN 'LONG_TAIL' THEN 3 ELSE 4 END,
  COALESCE(gmv_loss, 0) DESC, n_dims DESC, COALESCE(previous_gmv_share, 0) DESC, merchant_key LIMIT 15""",
)
def _(spark, sf):
    df = priority.priority_list(priority_rows(spark, sf)[0], MONTH)
    return edge(df, "merchant_key", "priority_level", "merchant_scale", "priority_sort_loss")


_shared = "gmv IS NOT NULL AND p_gmv IS NOT NULL AND known"


@query(
    "priority_month_summary",
    f"""SELECT valid_merchants, {dbl('current_total', 'previous_total')}, decline_merchants, growth_merchants, service_merchants, priority, attention, watchlist, data_quality,
  CAST(current_total - previous_total AS DOUBLE) / NULLIF(CAST(previous_total AS DOUBLE), 0) AS mom
FROM (SELECT COUNT(*) FILTER (WHERE {_shared}) AS valid_merchants, SUM(gmv) FILTER (WHERE {_shared}) AS current_total, SUM(p_gmv) FILTER (WHERE {_shared}) AS previous_total,
  COUNT(*) FILTER (WHERE {_shared} AND gmv < p_gmv) AS decline_merchants, COUNT(*) FILTER (WHERE {_shared} AND gmv > p_gmv) AS growth_merchants, COUNT(*) FILTER (WHERE d_service) AS service_merchants,
  COUNT(*) FILTER (WHERE priority_level = 'PRIORITY') AS priority, COUNT(*) FILTER (WHERE priority_level = 'ATTENTION') AS attention, COUNT(*) FILTER (WHERE priority_level = 'WATCHLIST') AS watchlist,
  COUNT(*) FILTER (WHERE priority_level = 'DATA_QUALITY_ALERT') AS data_quality FROM p_all WHERE month = {MONTH_SQL}) AS t""",
)
def _(spark, sf):
    return edge(priority.priority_summary(priority_rows(spark, sf)[0], MONTH))


# ------------------------------------------------------------------ dashboard
def periods(df):
    """Period table derived from the months of the data: one status per month, none for July."""
    m = F.month("month")
    status = (
        F.when(F.col("month") >= F.lit(date(2001, 10, 1)), "PARTIAL_PERIOD")
        .when(m == 5, "HISTORICAL_SNAPSHOT / PARTIAL_PERIOD")
        .when(m % 2 == 0, "COMPLETE")
        .otherwise("LIKELY_COMPLETE")
    )
    return df.select("month").distinct().where(m != 7).select("month", status.alias("period_quality_status"))


_status = "COALESCE(q.period_quality_status, 'UNRESOLVED')"


@query(
    "dashboard_period_quality",
    f"""SELECT DISTINCT CAST(p.month AS VARCHAR) AS month, {_status} AS period_quality_status, {_status} IN ('COMPLETE', 'LIKELY_COMPLETE') AS is_comparable_period,
  CASE WHEN {_status} IN ('COMPLETE', 'LIKELY_COMPLETE') THEN '完整周期候选' WHEN {_status} LIKE '%HISTORICAL_SNAPSHOT%' THEN '历史快照' WHEN {_status} = 'PARTIAL_PERIOD' THEN '部分周期' ELSE '待确认' END AS period_quality_label
FROM m_months AS p LEFT JOIN p_periods AS q ON q.month = p.month""",
)
def _(spark, sf):
    df = merchant_month(spark, sf)
    out = dashboard.with_period_quality(df, periods(df))
    return edge(out, "month", "period_quality_status", "is_comparable_period", "period_quality_label").distinct()


@query(
    "dashboard_latest_complete_period",
    f"""SELECT CAST(MAX(p.month) AS VARCHAR) AS month FROM p_prev AS p JOIN p_periods AS q ON q.month = p.month
WHERE q.period_quality_status IN ('COMPLETE', 'LIKELY_COMPLETE') AND gmv IS NOT NULL AND p_gmv IS NOT NULL AND known""",
)
def _(spark, sf):
    df = written(priority.with_previous(health.health(merchant_month(spark, sf))))
    df = df.withColumn("merchant_mapping_status", F.col("mapping_status"))
    return edge(dashboard.latest_complete_period(df, periods(df)))


@query(
    "dashboard_filter",
    f"SELECT merchant_key, owner, merchant_scale, priority_level FROM p_all WHERE month = {MONTH_SQL} AND owner IN ('NATION_1', 'NATION_15', 'NATION_20') AND merchant_scale IN ('KEY', 'MID')",
)
def _(spark, sf):
    df = dashboard.filter_dashboard(priority_rows(spark, sf)[0], MONTH, ["NATION_1", "NATION_15", "NATION_20"], ["KEY", "MID"])
    return edge(df, "merchant_key", "owner", "merchant_scale", "priority_level")


_business = "priority_level <> 'DATA_QUALITY_ALERT' AND gmv IS NOT NULL AND p_gmv IS NOT NULL"


@query(
    "dashboard_business_and_quality_rows",
    f"""SELECT CAST(month AS VARCHAR) AS month, COUNT(*) FILTER (WHERE {_business}) AS business_rows,
  COUNT(*) FILTER (WHERE priority_level = 'DATA_QUALITY_ALERT' OR data_quality_status = 'DATA_QUALITY_ALERT') AS quality_rows FROM p_all GROUP BY 1""",
)
def _(spark, sf):
    p = written(priority_rows(spark, sf)[0])
    rows = dashboard.business_rows(p).select("month", F.lit(1).alias("b"), F.lit(None).cast("int").alias("q"))
    rows = rows.unionByName(dashboard.quality_rows(p).select("month", F.lit(None).cast("int").alias("b"), F.lit(1).alias("q")))
    return edge(rows.groupBy("month").agg(F.count("b").alias("business_rows"), F.count("q").alias("quality_rows")))


@query(
    "dashboard_overview_by_month",
    f"""SELECT month, {dbl('region_gmv', 'region_gmv_previous')}, declining_merchants, growth_merchants, priority_merchants, attention_merchants, watchlist_merchants, service_alerts, comparable_merchants,
  CAST(region_gmv AS DOUBLE) / NULLIF(CAST(region_gmv_previous AS DOUBLE), 0) - 1 AS gmv_mom
FROM (SELECT CAST(month AS VARCHAR) AS month, SUM(gmv) FILTER (WHERE {_business}) AS region_gmv, SUM(p_gmv) FILTER (WHERE {_business}) AS region_gmv_previous,
  COUNT(*) FILTER (WHERE {_business} AND gmv < p_gmv) AS declining_merchants, COUNT(*) FILTER (WHERE {_business} AND gmv > p_gmv) AS growth_merchants,
  COUNT(*) FILTER (WHERE priority_level = 'PRIORITY') AS priority_merchants, COUNT(*) FILTER (WHERE priority_level = 'ATTENTION') AS attention_merchants,
  COUNT(*) FILTER (WHERE priority_level = 'WATCHLIST') AS watchlist_merchants, COUNT(*) FILTER (WHERE d_service) AS service_alerts, COUNT(*) FILTER (WHERE {_business}) AS comparable_merchants
  FROM p_all GROUP BY 1) AS t""",
)
def _(spark, sf):
    return edge(dashboard.overview(priority_rows(spark, sf)[0], ["month"]))


@query(
    "dashboard_top_loss",
    f"SELECT merchant_key, CAST(month AS VARCHAR) AS month, {dbl('gmv_loss')} FROM p_all WHERE {_business} AND gmv_loss > 0 AND month = {MONTH_SQL} ORDER BY p_all.gmv_loss DESC, merchant_key LIMIT 10",
)
def _(spark, sf):
    p = dashboard.filter_dashboard(priority_rows(spark, sf)[0], MONTH)
    return edge(dashboard.top_loss(p), "merchant_key", "month", "gmv_loss")


@query(
    "dashboard_top_growth",
    f"SELECT merchant_key, CAST(month AS VARCHAR) AS month, {dbl('gmv_change_abs')} FROM p_all WHERE {_business} AND gmv_change_abs > 0 AND month = {MONTH_SQL} ORDER BY p_all.gmv_change_abs DESC, merchant_key LIMIT 10",
)
def _(spark, sf):
    p = dashboard.filter_dashboard(priority_rows(spark, sf)[0], MONTH)
    return edge(dashboard.top_growth(p), "merchant_key", "month", "gmv_change_abs")


@query(
    "dashboard_merchant_trend",
    f"""SELECT merchant_key, CAST(month AS VARCHAR) AS month, {dbl('gmv')}, gmv_mom, gmv_rank AS gmv_rank_current, aftersales_rate FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_key ORDER BY month DESC) AS rn FROM h_all) AS t WHERE rn <= 12""",
)
def _(spark, sf):
    p = priority_rows(spark, sf)[0]
    return edge(dashboard.merchant_trend(p), "merchant_key", "month", "gmv", "gmv_mom", "gmv_rank_current", "aftersales_rate")


@query(
    "dashboard_rank_wording",
    f"""SELECT {KEY_SQL}, CASE WHEN gmv_rank_change IS NULL THEN 'NULL' WHEN gmv_rank_change > 0 THEN '↓' || CAST(gmv_rank_change AS VARCHAR) || '名'
  WHEN gmv_rank_change < 0 THEN '↑' || CAST(-gmv_rank_change AS VARCHAR) || '名' ELSE '持平' END AS rank_change_text FROM h_all""",
)
def _(spark, sf):
    df = health.health(merchant_month(spark, sf))
    return edge(df.withColumn("rank_change_text", dashboard.rank_change_text(F.col("gmv_rank_change"))), *P_KEY, "rank_change_text")


_worded = (
    """CASE WHEN gmv_rank_change IS NULL THEN '排名变化NA' WHEN gmv_rank_change = 0 THEN '排名持平' WHEN gmv_rank_change < 0 THEN '排名上升' || CAST(-gmv_rank_change AS VARCHAR) || '名'
  ELSE '排名下降' || CAST(gmv_rank_change AS VARCHAR) || '名' END"""
)


@query(
    "dashboard_reason_wording",
    f"""SELECT {KEY_SQL}, COALESCE(ARRAY_TO_STRING(LIST_FILTER([
  CASE WHEN d_trend THEN 'GMV趋势：' || COALESCE('GMV环比' || {_pct('gmv_mom')}, 'GMV连续下降') || CASE WHEN consecutive_gmv_decline >= 3 THEN '，连续下降' || CAST(consecutive_gmv_decline AS VARCHAR) || '个月' ELSE '' END END,
  CASE WHEN d_impact THEN '区域影响：GMV损失' || COALESCE(FORMAT('{{:.2f}}', CAST(gmv_loss AS DOUBLE)), 'nan') || '，上月区域占比' || COALESCE({_pct('previous_gmv_share')}, 'nan%') END,
  CASE WHEN d_relative THEN '相对位置：' || {_worded} || '，同月分位' || COALESCE({_pct('gmv_percentile')}, 'nan%') END,
  CASE WHEN d_order THEN '订单：订单环比' || {_pct('order_count_mom')} END,
  CASE WHEN d_service THEN '服务风险：售后率' || COALESCE({_pct('aftersales_rate')}, 'nan%') || COALESCE('，环比变化' || {_pct('aftersales_rate_mom')}, '') END], lambda x: x IS NOT NULL)[1:3], '｜'), '') AS reasons FROM p_all""",
)
def _(spark, sf):
    p = priority_rows(spark, sf)[0]
    return edge(p.withColumn("reasons", dashboard.reasons_text(F.col("attention_reasons"))), *P_KEY, "reasons")
