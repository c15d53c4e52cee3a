"""Plain SQL building blocks for the oracle queries. They share no code with the operators."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
ONCE: set[str] = set()  # blocks that are computed once, however often they are named


def sql(body: str) -> str:
    """Body with the named building blocks it needs, in dependency order."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                need_one(name)

    def need_one(name: str) -> None:
        for other in CTES:
            if other != name and other not in ordered and re.search(rf"\b{other}\b", CTES[name]):
                need_one(other)
        if name not in ordered:
            ordered.append(name)

    need(body)
    if not ordered:
        return body
    once = lambda n: "MATERIALIZED " if n in ONCE else ""
    blocks = ",\n".join(f"{n} AS {once(n)}(\n{CTES[n].strip()}\n)" for n in ordered)
    return f"WITH {blocks}\n{body.strip()}"


CTES["f_daily"] = """
SELECT CAST(o_orderdate AS DATE) AS date, r_name AS business_line, p_brand AS product,
  NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS channel, n_name AS region, c_mktsegment AS team,
  s_name AS salesperson,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS impressions,
  COUNT(*) AS leads,
  COUNT(*) FILTER (WHERE o_orderstatus <> 'P') AS valid_leads,
  COUNT(*) FILTER (WHERE o_orderstatus <> 'P' AND l_linestatus = 'F') AS contacted_leads,
  COUNT(*) FILTER (WHERE o_orderstatus <> 'P' AND l_returnflag <> 'A') AS followed_leads,
  COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS paid_users,
  COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS paid_orders,
  CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DECIMAL(18,2)) AS gross_revenue,
  COUNT(*) FILTER (WHERE o_orderstatus = 'F' AND l_returnflag = 'R') AS refund_users,
  COUNT(*) FILTER (WHERE o_orderstatus = 'F' AND l_returnflag = 'R') AS refund_orders,
  CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END END) AS DECIMAL(18,2)) AS refund_amount
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
GROUP BY 1, 2, 3, 4, 5, 6, 7
"""

# ---------------------------------------------------------------- merchant months
CTES["m_orders"] = """
SELECT l_suppkey, DATE_TRUNC('month', CAST(l_shipdate AS DATE)) AS month, l_orderkey,
  SUM(CASE WHEN l_returnflag <> 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS gmv,
  SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS cash,
  MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned,
  MAX(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS settled
FROM lineitem GROUP BY 1, 2, 3
"""
CTES["m_months"] = """
SELECT CAST(month AS DATE) AS month, 'ID:' || CAST(l_suppkey AS VARCHAR) AS merchant_key, s_name AS merchant_name_raw,
  n_name AS owner, CASE WHEN s_acctbal < 0 THEN 'UNRESOLVED' ELSE 'ID_MATCHED' END AS mapping_status,
  gmv, cash_sales_amount, order_count, aftersales_order_count,
  CAST(aftersales_order_count AS DOUBLE) / CAST(order_count AS DOUBLE) AS aftersales_rate
FROM (SELECT l_suppkey, month, CAST(SUM(gmv) AS DECIMAL(18,2)) AS gmv, CAST(SUM(cash) AS DECIMAL(18,2)) AS cash_sales_amount,
        COUNT(*) AS order_count, NULLIF(COUNT(*) FILTER (WHERE returned = 1), 0) AS aftersales_order_count
      FROM m_orders GROUP BY 1, 2) AS t
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""
CTES["src_cash"] = """
SELECT STRFTIME(month, '%Y-%m') AS month, s_name AS name, n_name AS owner,
  CAST(SUM(cash) AS DECIMAL(18,2)) AS cash_sales_amount, COUNT(*) AS order_count
FROM m_orders JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE settled = 1 GROUP BY 1, 2, 3
"""
CTES["src_gmv"] = """
SELECT STRFTIME(month, '%Y-%m') AS month, CAST(l_suppkey AS VARCHAR) AS raw_id, s_name AS name, n_name AS owner,
  CAST(SUM(gmv) AS DECIMAL(18,2)) AS gmv
FROM m_orders JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE s_acctbal >= 0 GROUP BY 1, 2, 3, 4 HAVING SUM(gmv) IS NOT NULL
"""
CTES["src_after"] = """
SELECT STRFTIME(month, '%Y-%m') AS month, CAST(l_suppkey AS VARCHAR) AS raw_id, s_name AS name, n_name AS owner,
  COUNT(*) FILTER (WHERE returned = 1) AS aftersales_order_count,
  CAST(COUNT(*) FILTER (WHERE returned = 1) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS aftersales_rate
FROM m_orders JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE s_acctbal >= 0 GROUP BY 1, 2, 3, 4 HAVING COUNT(*) FILTER (WHERE returned = 1) > 0
"""
CTES["stg_ids"] = """
SELECT LOWER(REGEXP_REPLACE(name, '\\s+', '', 'g')) AS nname, MIN(raw_id) AS raw_id
FROM src_gmv GROUP BY 1 HAVING COUNT(DISTINCT raw_id) = 1
"""
CTES["stg_cash"] = """
SELECT c.*, i.raw_id, CASE WHEN i.raw_id IS NULL THEN 'NAME:' || LOWER(REGEXP_REPLACE(c.name, '\\s+', '', 'g')) ELSE 'ID:' || i.raw_id END AS merchant_key
FROM src_cash AS c LEFT JOIN stg_ids AS i ON LOWER(REGEXP_REPLACE(c.name, '\\s+', '', 'g')) = i.nname
"""
CTES["stg_seen"] = """
SELECT merchant_key, month, name, raw_id, CASE WHEN raw_id IS NULL THEN 'UNRESOLVED' ELSE 'NAME_MATCHED' END AS status, 1 AS source FROM stg_cash
UNION ALL SELECT 'ID:' || raw_id, month, name, raw_id, 'ID_MATCHED', 2 FROM src_gmv
UNION ALL SELECT 'ID:' || raw_id, month, name, raw_id, 'ID_MATCHED', 3 FROM src_after
"""
CTES["stg_crosswalk"] = """
SELECT merchant_key, raw_id AS merchant_id_raw, name AS merchant_name_raw, status AS mapping_status, first_seen_month, last_seen_month
FROM (SELECT *, MIN(month) OVER (PARTITION BY merchant_key) AS first_seen_month, MAX(month) OVER (PARTITION BY merchant_key) AS last_seen_month,
        ROW_NUMBER() OVER (PARTITION BY merchant_key ORDER BY source, month, name) AS rn FROM stg_seen) AS t
WHERE rn = 1
"""
CTES["stg_grid"] = """
SELECT m.month, w.merchant_key, w.merchant_id_raw, w.mapping_status,
  CASE WHEN c.month IS NOT NULL THEN c.name WHEN g.month IS NOT NULL THEN g.name WHEN a.month IS NOT NULL THEN a.name ELSE w.merchant_name_raw END AS merchant_name_raw,
  CASE WHEN c.month IS NOT NULL THEN c.owner WHEN g.month IS NOT NULL THEN g.owner WHEN a.month IS NOT NULL THEN a.owner ELSE '' END AS owner,
  CASE WHEN g.month IS NOT NULL THEN g.owner WHEN a.month IS NOT NULL THEN a.owner ELSE '' END AS region,
  c.cash_sales_amount, g.gmv, c.order_count, a.aftersales_order_count, a.aftersales_rate,
  CASE WHEN w.mapping_status = 'UNRESOLVED' THEN 'UNRESOLVED'
       WHEN m.month = w.first_seen_month THEN 'NEW'
       WHEN m.month = w.last_seen_month AND w.last_seen_month < (SELECT MAX(month) FROM stg_seen) THEN 'LOST'
       WHEN c.month IS NOT NULL OR g.month IS NOT NULL OR a.month IS NOT NULL THEN 'CURRENT' ELSE 'MISSING' END AS coverage_status
FROM stg_crosswalk AS w CROSS JOIN (SELECT DISTINCT month FROM stg_seen) AS m
LEFT JOIN stg_cash AS c ON c.merchant_key = w.merchant_key AND c.month = m.month
LEFT JOIN src_gmv AS g ON 'ID:' || g.raw_id = w.merchant_key AND g.month = m.month
LEFT JOIN src_after AS a ON 'ID:' || a.raw_id = w.merchant_key AND a.month = m.month
"""
CTES["h_base"] = """
SELECT *,
  CASE WHEN gmv IS NOT NULL THEN RANK() OVER (PARTITION BY month ORDER BY gmv DESC NULLS LAST) END AS gmv_rank,
  CASE WHEN cash_sales_amount IS NOT NULL THEN RANK() OVER (PARTITION BY month ORDER BY cash_sales_amount DESC NULLS LAST) END AS cash_sales_rank,
  CASE WHEN gmv IS NOT NULL THEN
    CAST(2 * RANK() OVER (PARTITION BY month ORDER BY gmv ASC NULLS LAST) + COUNT(*) OVER (PARTITION BY month, gmv) - 1 AS DOUBLE)
    / CAST(2 * COUNT(gmv) OVER (PARTITION BY month) AS DOUBLE) END AS gmv_percentile
FROM m_months
"""
CTES["h_prior"] = """
SELECT c.*, p.gmv AS p_gmv, p.cash_sales_amount AS p_cash, p.order_count AS p_orders, p.aftersales_rate AS p_rate, p.gmv_rank AS p_rank
FROM h_base AS c LEFT JOIN h_base AS p ON p.merchant_key = c.merchant_key AND p.month = CAST(c.month - INTERVAL 1 MONTH AS DATE)
"""
CTES["h_run"] = """
SELECT merchant_key, month, CAST(SUM(fell) OVER (PARTITION BY merchant_key, island ORDER BY month) AS BIGINT) AS consecutive_gmv_decline
FROM (SELECT merchant_key, month, fell, SUM(1 - fell) OVER (PARTITION BY merchant_key ORDER BY month) AS island
      FROM (SELECT merchant_key, month, CASE WHEN gmv < LAG(gmv) OVER (PARTITION BY merchant_key ORDER BY month) THEN 1 ELSE 0 END AS fell FROM m_months) AS a) AS b
"""


def _mom(cur: str, prior: str) -> str:
    return f"CASE WHEN mapping_status <> 'UNRESOLVED' THEN CAST({cur} AS DOUBLE) / NULLIF(CAST({prior} AS DOUBLE), 0) - 1 END"


CTES["h_all"] = f"""
SELECT p.*, {_mom('gmv', 'p_gmv')} AS gmv_mom, {_mom('cash_sales_amount', 'p_cash')} AS cash_sales_mom,
  {_mom('order_count', 'p_orders')} AS order_count_mom, {_mom('aftersales_rate', 'p_rate')} AS aftersales_rate_mom,
  gmv_rank - p_rank AS gmv_rank_change, r.consecutive_gmv_decline
FROM h_prior AS p JOIN h_run AS r USING (merchant_key, month)
"""


def _q(value: str, cond: str, q: float, fallback: float, minimum: int) -> str:
    return (
        f"CASE WHEN COUNT({value}) FILTER (WHERE {cond}) >= {minimum} "
        f"THEN QUANTILE_CONT(CAST({value} AS DOUBLE), {q}) FILTER (WHERE {cond}) ELSE {fallback} END"
    )


CTES["h_thr"] = f"""
SELECT {_q('gmv_mom', 'gmv_mom < 0', 0.10, -0.20, 3)} AS gmv_decline,
  {_q('cash_sales_mom', 'cash_sales_mom < 0', 0.10, -0.20, 3)} AS cash_decline,
  {_q('order_count_mom', 'order_count_mom < 0', 0.10, -0.20, 3)} AS order_decline,
  {_q('gmv_rank_change', 'gmv_rank_change > 0', 0.90, 10.0, 3)} AS rank_drop,
  {_q('aftersales_rate', 'aftersales_rate IS NOT NULL', 0.90, 0.0, 3)} AS aftersales_high,
  {_q('aftersales_rate_mom', 'aftersales_rate_mom > 0', 0.90, 0.20, 3)} AS aftersales_worsening,
  {_q('order_count_mom', 'order_count_mom > 0', 0.75, 0.10, 3)} AS order_rise_for_divergence,
  CAST(0.20 AS DOUBLE) AS low_gmv_percentile
FROM h_all
"""
CTES["h_signals"] = """
SELECT h.*,
  mapping_status <> 'UNRESOLVED' AS known,
  COALESCE(gmv_mom <= gmv_decline AND gmv_mom < 0, FALSE) AS s1,
  COALESCE(gmv_rank_change >= rank_drop, FALSE) AS s2,
  COALESCE(gmv_percentile <= low_gmv_percentile, FALSE) AS s3,
  COALESCE(aftersales_rate >= aftersales_high, FALSE) AS s4,
  COALESCE(aftersales_rate_mom >= aftersales_worsening, FALSE) AS s5,
  COALESCE(order_count_mom <= order_decline AND order_count_mom < 0, FALSE) AS s6,
  COALESCE(gmv_mom <= gmv_decline AND order_count_mom >= order_rise_for_divergence, FALSE) AS s7,
  COALESCE(consecutive_gmv_decline >= 3, FALSE) AS s8,
  month = (SELECT MAX(month) FROM m_months) AS latest
FROM h_all AS h CROSS JOIN h_thr
"""
CTES["h_attention"] = """
SELECT *, CASE WHEN n_business >= 3 THEN 'HIGH' WHEN n_business >= 1 THEN 'MEDIUM' WHEN n_quality > 0 THEN 'DATA_QUALITY' ELSE 'NONE' END AS severity,
  CASE WHEN n_business > 0 THEN 'BUSINESS_ALERT' WHEN n_quality > 0 THEN 'DATA_QUALITY_ALERT' ELSE 'NO_ALERT' END AS business_attention_status,
  CASE WHEN n_quality > 0 THEN 'DATA_QUALITY_ALERT' ELSE 'NO_ALERT' END AS data_quality_status
FROM (SELECT *, CASE WHEN known THEN CAST(s1 AS INT) + CAST(s2 AS INT) + CAST(s3 AS INT) + CAST(s4 AS INT) + CAST(s5 AS INT) + CAST(s6 AS INT) + CAST(s7 AS INT) + CAST(s8 AS INT) ELSE 0 END AS n_business,
  CASE WHEN NOT known THEN 1 ELSE CAST(latest AND gmv IS NULL AS INT) + CAST(latest AND cash_sales_amount IS NULL AS INT) END AS n_quality
  FROM h_signals) AS t
"""
CTES["p_prev"] = """
SELECT *, p_gmv AS previous_gmv, gmv - p_gmv AS gmv_change_abs, GREATEST(p_gmv - gmv, 0) AS gmv_loss0
FROM h_attention
"""
CTES["p_month"] = """
SELECT month, SUM(p_gmv) AS regional_previous_gmv, SUM(gmv) AS regional_current_gmv, COUNT(*) AS n_values,
  QUANTILE_CONT(CAST(p_gmv AS DOUBLE), 0.25) AS q25, QUANTILE_CONT(CAST(p_gmv AS DOUBLE), 0.75) AS q75
FROM h_all WHERE p_gmv IS NOT NULL AND mapping_status <> 'UNRESOLVED' GROUP BY 1
"""
CTES["p_impact"] = """
SELECT p.*, m.regional_previous_gmv, m.regional_current_gmv,
  CASE WHEN gmv_change_abs IS NOT NULL THEN gmv_loss0 END AS gmv_loss,
  CASE WHEN m.regional_current_gmv < m.regional_previous_gmv THEN m.regional_previous_gmv - m.regional_current_gmv END AS regional_gmv_loss,
  CAST(p_gmv AS DOUBLE) / NULLIF(CAST(m.regional_previous_gmv AS DOUBLE), 0) AS previous_gmv_share,
  CASE WHEN p_gmv IS NULL OR COALESCE(n_values, 0) < 4 THEN 'UNAVAILABLE'
       WHEN CAST(p_gmv AS DOUBLE) >= q75 THEN 'KEY' WHEN CAST(p_gmv AS DOUBLE) >= q25 THEN 'MID' ELSE 'LONG_TAIL' END AS merchant_scale
FROM p_prev AS p LEFT JOIN p_month AS m ON m.month = p.month
"""
CTES["p_thr"] = f"""
SELECT {_q('gmv_mom', 'gmv_mom < 0', 0.10, -0.20, 4)} AS severe_gmv_mom,
  {_q('order_count_mom', 'order_count_mom < 0', 0.10, -0.20, 4)} AS severe_order_mom,
  {_q('gmv_loss', 'gmv_loss > 0', 0.75, 0.0, 4)} AS high_loss,
  {_q('previous_gmv_share', 'previous_gmv_share > 0', 0.75, 0.0, 4)} AS important_share,
  {_q('gmv_rank_change', 'gmv_rank_change > 0', 0.90, 10.0, 4)} AS rank_drop_p,
  {_q('aftersales_rate', 'aftersales_rate IS NOT NULL', 0.90, 0.0, 4)} AS high_aftersales,
  {_q('aftersales_rate_mom', 'aftersales_rate_mom > 0', 0.90, 0.20, 4)} AS aftersales_worsening_p,
  {_q('order_count_mom', 'order_count_mom > 0', 0.75, 0.10, 4)} AS order_rise_divergence
FROM p_impact WHERE mapping_status <> 'UNRESOLVED'
"""
CTES["p_dims"] = """
SELECT i.*,
  known AND (COALESCE(gmv_mom <= severe_gmv_mom AND gmv_mom < 0, FALSE) OR consecutive_gmv_decline >= 3) AS d_trend,
  known AND (COALESCE(CAST(gmv_loss AS DOUBLE) >= high_loss, FALSE) OR COALESCE(previous_gmv_share >= important_share, FALSE)) AS d_impact,
  known AND (COALESCE(gmv_rank_change >= rank_drop_p, FALSE) OR COALESCE(gmv_percentile <= 0.20, FALSE)) AS d_relative,
  known AND (COALESCE(order_count_mom <= severe_order_mom AND order_count_mom < 0, FALSE)
    OR COALESCE(gmv_mom <= severe_gmv_mom AND order_count_mom >= order_rise_divergence, FALSE)) AS d_order,
  known AND (COALESCE(aftersales_rate >= high_aftersales, FALSE) OR COALESCE(aftersales_rate_mom >= aftersales_worsening_p, FALSE)) AS d_service
FROM p_impact AS i CROSS JOIN p_thr
"""
CTES["p_all"] = """
SELECT *, CASE WHEN NOT known OR gmv IS NULL THEN 'DATA_QUALITY_ALERT' WHEN n_dims = 0 THEN 'NO_PRIORITY'
  WHEN d_trend AND (d_impact OR d_service OR consecutive_gmv_decline >= 3) THEN 'PRIORITY'
  WHEN n_dims >= 2 THEN 'ATTENTION' ELSE 'WATCHLIST' END AS priority_level
FROM (SELECT *, CAST(d_trend AS INT) + CAST(d_impact AS INT) + CAST(d_relative AS INT) + CAST(d_order AS INT) + CAST(d_service AS INT) AS n_dims,
  CONCAT_WS('|', CASE WHEN d_trend THEN 'Trend' END, CASE WHEN d_impact THEN 'Scale / Impact' END, CASE WHEN d_relative THEN 'Relative Position' END,
    CASE WHEN d_order THEN 'Order' END, CASE WHEN d_service THEN 'Service' END) AS diagnostic_dimensions FROM p_dims) AS t
"""
CTES["p_periods"] = """
SELECT DISTINCT month, CASE WHEN month >= DATE '2001-10-01' THEN 'PARTIAL_PERIOD'
  WHEN EXTRACT(MONTH FROM month) = 5 THEN 'HISTORICAL_SNAPSHOT / PARTIAL_PERIOD'
  WHEN EXTRACT(MONTH FROM month) % 2 = 0 THEN 'COMPLETE' ELSE 'LIKELY_COMPLETE' END AS period_quality_status
FROM m_months WHERE EXTRACT(MONTH FROM month) <> 7
"""

# ---------------------------------------------------------------- order lines
CTES["i_lines"] = """
SELECT r_name AS merchant_key, CAST(l_shipdate AS DATE) AS order_date, CAST(l_orderkey AS VARCHAR) AS order_id,
  CAST(o_custkey AS VARCHAR) AS customer_key, c_name AS customer_name, CAST(l_partkey AS VARCHAR) AS product_key,
  p_brand AS product_code, p_name AS product_name, n_name AS manufacturer_raw, CAST(p_size AS VARCHAR) AS specification_raw,
  CAST(CAST(l_quantity AS BIGINT) AS DECIMAL(18,2)) AS quantity,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) // CAST(l_quantity AS BIGINT) AS price_cents,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS purchase_amount,
  CASE o_orderstatus WHEN 'F' THEN '交易完成' WHEN 'O' THEN '待收货' END AS order_status_raw,
  CASE l_returnflag WHEN 'R' THEN '已退款' WHEN 'N' THEN '配送完成' ELSE 'A' END AS processing_status_raw,
  CAST(NULL AS VARCHAR) AS processing_remark_raw,
  CASE l_linestatus WHEN 'F' THEN '已结算' ELSE '未结算' END AS settlement_status_raw,
  o_orderpriority AS order_type_raw, c_mktsegment AS activity_type, p_brand AS activity_id
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""
CTES["i_product_conflict"] = """
SELECT merchant_key, product_key FROM i_lines WHERE product_key IS NOT NULL GROUP BY 1, 2
HAVING COUNT(DISTINCT product_code) > 1 OR COUNT(DISTINCT COALESCE(manufacturer_raw, '') || '|' || COALESCE(specification_raw, '')) > 1
"""
CTES["i_customer_conflict"] = """
SELECT merchant_key, customer_key FROM i_lines GROUP BY 1, 2 HAVING COUNT(DISTINCT customer_name) > 1
"""
CTES["i_orders"] = """
SELECT merchant_key, order_id, SUM(purchase_amount) AS order_purchase_amount, COUNT(DISTINCT order_date) > 1 AS crosses
FROM i_lines GROUP BY 1, 2
"""
CTES["i_flagged"] = """
SELECT l.*, o.order_purchase_amount, o.order_purchase_amount > 0 AS included_in_order_count,
  ABS(CAST(quantity AS BIGINT) * price_cents - CAST(purchase_amount * 100 AS BIGINT)) > 1 AS f_mismatch,
  purchase_amount = 0 AS f_zero_line, c.customer_key IS NOT NULL AS f_customer, p.product_key IS NOT NULL AS f_product,
  o.crosses AS f_cross, o.order_purchase_amount = 0 AS f_zero_order,
  COALESCE(order_status_raw, '<BLANK>') NOT IN ('交易完成', '待收货') AS f_order_status,
  COALESCE(processing_status_raw, '<BLANK>') NOT IN ('配送完成', '已退款', '药品已出库', '待处理', '订单已接受', '无法配送退款中') AS f_processing,
  COALESCE(settlement_status_raw, '<BLANK>') NOT IN ('已结算', '未结算', '结算中') AS f_settlement
FROM i_lines AS l JOIN i_orders AS o USING (merchant_key, order_id)
LEFT JOIN i_customer_conflict AS c ON c.merchant_key = l.merchant_key AND c.customer_key = l.customer_key
LEFT JOIN i_product_conflict AS p ON p.merchant_key = l.merchant_key AND p.product_key = l.product_key
"""
CTES["i_month0"] = """
SELECT merchant_key, CAST(DATE_TRUNC('month', order_date) AS DATE) AS month, SUM(purchase_amount) AS purchase_amount,
  COUNT(DISTINCT CASE WHEN included_in_order_count THEN order_id END) AS order_count,
  COUNT(DISTINCT CASE WHEN purchase_amount > 0 THEN customer_key END) AS active_customers,
  COUNT(DISTINCT CASE WHEN purchase_amount > 0 THEN product_key END) AS active_products,
  MIN(order_date) AS coverage_start, MAX(order_date) AS coverage_end, COUNT(DISTINCT order_date) AS observed_days
FROM i_flagged GROUP BY 1, 2
"""
CTES["i_month1"] = """
SELECT *, CAST(purchase_amount AS DOUBLE) / NULLIF(CAST(order_count AS DOUBLE), 0) AS aov,
  EXTRACT(DAY FROM LAST_DAY(month)) AS calendar_days,
  CASE WHEN observed_days = EXTRACT(DAY FROM LAST_DAY(month)) THEN 'COMPLETE' ELSE 'PARTIAL' END AS period_quality_status
FROM i_month0
"""
CTES["i_monthly"] = """
SELECT c.*, p.purchase_amount AS p_amount, p.order_count AS p_orders, p.aov AS p_aov, p.active_customers AS p_customers, p.active_products AS p_products,
  CASE WHEN p.month IS NULL THEN 'UNAVAILABLE' WHEN c.period_quality_status = 'COMPLETE' AND p.period_quality_status = 'COMPLETE' THEN 'VERIFIED' ELSE 'INCOMPLETE_PERIOD' END AS comparison_quality_status
FROM i_month1 AS c LEFT JOIN i_month1 AS p ON p.merchant_key = c.merchant_key AND p.month = CAST(c.month - INTERVAL 1 MONTH AS DATE)
"""
CTES["i_pairs"] = """
SELECT merchant_key, MAX(month) AS current_month, CAST(MAX(month) - INTERVAL 1 MONTH AS DATE) AS previous_month
FROM i_monthly WHERE comparison_quality_status = 'VERIFIED' GROUP BY 1
"""
CTES["i_active"] = """
SELECT l.*, CAST(DATE_TRUNC('month', order_date) AS DATE) = p.current_month AS now, p.current_month, p.previous_month
FROM i_flagged AS l JOIN i_pairs AS p ON p.merchant_key = l.merchant_key
WHERE purchase_amount > 0 AND CAST(DATE_TRUNC('month', order_date) AS DATE) IN (p.current_month, p.previous_month)
"""


def contribution(key: str, label: str, suffix: str) -> str:
    """Two-period amounts per entity with the preferred label."""
    return f"""
SELECT t.merchant_key, previous_month, current_month, t.{key}, n.{label}, previous_amount, current_amount,
  current_amount - previous_amount AS amount_change,
  CASE WHEN previous_amount > 0 AND current_amount > 0 THEN 'RETAINED{suffix}' WHEN current_amount > 0 THEN 'CURRENT_ONLY{suffix}' ELSE 'PREVIOUS_ONLY{suffix}' END AS period_status
FROM (SELECT merchant_key, {key}, ANY_VALUE(previous_month) AS previous_month, ANY_VALUE(current_month) AS current_month,
        COALESCE(SUM(purchase_amount) FILTER (WHERE NOT now), 0) AS previous_amount, COALESCE(SUM(purchase_amount) FILTER (WHERE now), 0) AS current_amount
      FROM i_active GROUP BY 1, 2) AS t
JOIN (SELECT merchant_key, {key}, {label}, ROW_NUMBER() OVER (PARTITION BY merchant_key, {key} ORDER BY COUNT(*) DESC, {label}) AS rn
      FROM i_active WHERE {label} IS NOT NULL GROUP BY 1, 2, 3) AS n ON n.merchant_key = t.merchant_key AND n.{key} = t.{key} AND n.rn = 1
"""


CTES["i_customers"] = contribution("customer_key", "customer_name", "")
CTES["i_products0"] = contribution("product_key", "product_name", "_ACTIVE")
CTES["i_products"] = """
SELECT p.*, CASE WHEN c.product_key IS NULL THEN 'VALID' ELSE 'CONFLICT' END AS mapping_quality_status
FROM i_products0 AS p LEFT JOIN i_product_conflict AS c ON c.merchant_key = p.merchant_key AND c.product_key = p.product_key
"""
CTES["i_decomposed"] = """
SELECT m.*, q.previous_month AS pair_previous, (order_count - p_orders) * (p_aov + aov) / 2 AS order_effect, (aov - p_aov) * (p_orders + order_count) / 2 AS aov_effect,
  m.purchase_amount - p_amount AS purchase_amount_change
FROM i_monthly AS m JOIN i_pairs AS q ON q.merchant_key = m.merchant_key AND q.current_month = m.month
"""
