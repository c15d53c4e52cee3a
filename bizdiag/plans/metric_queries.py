"""Registered queries on metrics, comparisons, series, contribution, scans and diagnosis."""

from __future__ import annotations

from bizdiag import definitions as defs
from bizdiag.functions.lineage import written
from bizdiag.operators import anomaly, contribution, diagnosis, metrics, trend
from bizdiag.plans.diagnosis_sql import blocks
from bizdiag.plans.edge import edge
from bizdiag.plans.oracle import CTES, ONCE, sql
from bizdiag.schema import COLUMNS
from bizdiag.sources.adapters import daily_fact

QUERIES, ORACLES = {}, {}
START, END = "1995-01-08", "2001-08-01"
RESULT = ("metric_id", "status", "value", "numerator_value", "denominator_value")

# Rules of the configured form whose volume gates suit some twenty lines a day.
RULES = [{**r, "min_denominator": 3 if r["min_denominator"] == 100 else 1000} for r in defs.RULES]
WEEK_RULE = {
    "id": "leads_week_drop", "name": "线索周同比下降", "metric_id": "leads", "dimension": "team",
    "method": "comparison", "comparison": "previous_week", "direction": "both",
    "thresholds": {"info": ("relative_change", 0.25), "warning": ("relative_change", 0.5), "critical": ("relative_change", 1.0)},
    "min_baseline_value": 4,
}
ZSCORE_RULE = {
    "id": "leads_zscore", "name": "线索偏离", "metric_id": "leads", "dimension": "channel", "method": "zscore",
    "direction": "both", "thresholds": {"warning": ("z_score", 2.0), "critical": ("z_score", 3.0)},
    "history_window_days": 28, "min_history_days": 20,
}
STREAK_RULE = {
    "id": "leads_streak", "name": "线索连续下降", "metric_id": "leads", "dimension": None,
    "method": "comparison", "comparison": "rolling_7d_average", "direction": "decrease",
    "thresholds": {"warning": ("relative_change", -0.05), "critical": ("relative_change", -0.5)}, "consecutive_days": 2,
}


def query(name: str, oracle: str | None = None):
    """Register a query and, when there is one, its SQL."""
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle)
        return f
    return add


# ------------------------------------------------------------------ SQL of metric results
def _agg(keys: str = "", where: str = "") -> str:
    fields = [c for c in COLUMNS[7:]]
    cols = ", ".join(f"COUNT({f}) AS n_{f}, SUM({f}) AS s_{f}" for f in fields)
    group = f" GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"SELECT {lead}{cols} FROM f_daily {where}{group}"


def _num(f: str) -> str:
    """Sum as a double; a difference is taken exactly first."""
    if f == "net_revenue":
        return "CAST(s_gross_revenue - s_refund_amount AS DOUBLE)"
    return f"CAST(s_{f} AS DOUBLE)"


def _cents(f: str) -> str:
    """Sum in whole hundredths as a double, so that one division gives the value."""
    if f == "net_revenue":
        return "CAST(CAST((s_gross_revenue - s_refund_amount) * 100 AS HUGEINT) AS DOUBLE)"
    return f"CAST(CAST(s_{f} * 100 AS HUGEINT) AS DOUBLE)"


def _state(f: str, off: tuple[str, ...]) -> str:
    """Status of an atomic metric or of net revenue."""
    if f == "net_revenue":
        a, b = _state("gross_revenue", off), _state("refund_amount", off)
        return f"CASE WHEN {a} <> 'available' THEN {a} ELSE {b} END"
    if f in off:
        return "'unavailable_missing_field'"
    return f"CASE WHEN COALESCE(n_{f}, 0) > 0 THEN 'available' ELSE 'unavailable_no_data' END"


def _metric_sql(mid: str, keys: str = "", off: tuple[str, ...] = ()) -> str:
    d = defs.METRICS[mid]
    lead = f"{keys}, " if keys else ""
    none = "CAST(NULL AS DOUBLE)"
    if d["type"] == "atomic":
        s = _state(d["field"], off)
        return f"SELECT {lead}'{mid}' AS metric_id, {s} AS status, CASE WHEN {s} = 'available' THEN {_num(d['field'])} END AS value, {none} AS numerator_value, {none} AS denominator_value FROM agg"
    a, b = d["parts"]
    sa, sb = _state(a, off), _state(b, off)
    passed = "'unavailable_dependency'" if a == "net_revenue" else sa
    zero = f"WHEN s_{b} = 0 THEN 'unavailable_zero_denominator' " if d["type"] == "ratio" else ""
    status = f"CASE WHEN {sa} <> 'available' THEN {passed} WHEN {sb} <> 'available' THEN {sb} {zero}ELSE 'available' END"
    ok = f"{sa} = 'available' AND {sb} = 'available'"
    value = f"{_cents(a)} / NULLIF({_cents(b)}, 0)" if d["type"] == "ratio" else f"CAST(s_{a} - s_{b} AS DOUBLE)"
    return (
        f"SELECT {lead}'{mid}' AS metric_id, {status} AS status, CASE WHEN {ok} THEN {value} END AS value, "
        f"CASE WHEN {ok} THEN {_num(a)} END AS numerator_value, CASE WHEN {ok} THEN {_num(b)} END AS denominator_value FROM agg"
    )


def _metrics_sql(ids, keys: str = "", where: str = "", off: tuple[str, ...] = (), order: str = "") -> str:
    union = " UNION ALL ".join(_metric_sql(m, keys, off) for m in ids)
    union = union.replace("FROM agg", f"FROM ({_agg(keys, where)}) AS agg")
    if "date" in keys.split(", "):
        rest = keys.replace("date", "CAST(date AS VARCHAR) AS date")
        return f"SELECT {rest}, metric_id, status, value, numerator_value, denominator_value FROM ({union}) AS u"
    return union


# ------------------------------------------------------------------ metrics
ATOMIC = ("leads", "gross_revenue", "refund_amount")


@query("metric_atomic_overall", _metrics_sql(ATOMIC))
def _(spark, sf):
    return edge(metrics.metrics(daily_fact(spark, sf, ()), ATOMIC), *RESULT)


@query("metric_ratio_by_channel", _metrics_sql(("refund_rate_amount",), "channel"))
def metric_ratio_by_channel(spark, sf):
    return edge(metrics.metrics_by(daily_fact(spark, sf, ("channel",)), ["refund_rate_amount"], ["channel"]), "channel", *RESULT)


@query("metric_difference_by_region", _metrics_sql(("net_revenue", "revenue_per_lead"), "region"))
def _(spark, sf):
    df = metrics.metrics_by(daily_fact(spark, sf, ("region",)), ["net_revenue", "revenue_per_lead"], ["region"])
    return edge(df, "region", *RESULT)


DEPENDENT = ("refund_amount", "net_revenue", "revenue_per_lead", "refund_rate_amount", "valid_lead_rate")


@query("metric_status_unmapped_field", _metrics_sql(DEPENDENT, "team", off=("refund_amount",)))
def _(spark, sf):
    mapped = [c for c in COLUMNS if c != "refund_amount"]
    df = metrics.metrics_by(daily_fact(spark, sf, ("team",)), DEPENDENT, ["team"], mapped)
    return edge(df, "team", *RESULT)


@query("metrics_all_one_scan", _metrics_sql(tuple(defs.METRICS)))
def _(spark, sf):
    return edge(metrics.metrics(daily_fact(spark, sf, ()), list(defs.METRICS)), *RESULT)


WHERE = "WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND channel IN ('1-URGENT', '5-LOW') AND team = 'BUILDING'"


@query("metrics_filtered_scope", _metrics_sql(("leads", "conversion_rate", "net_revenue"), where=WHERE))
def _(spark, sf):
    df = daily_fact(spark, sf, ("channel", "team"))
    scope = {"channel": ["1-URGENT", "5-LOW"], "team": "BUILDING"}
    ids = ["leads", "conversion_rate", "net_revenue"]
    return edge(metrics.metrics(df, ids, start="1996-01-01", end="1997-12-31", filters=scope), *RESULT)


@query("metrics_by_date", _metrics_sql(("refund_rate_amount", "net_revenue"), "date"))
def _(spark, sf):
    df = metrics.metrics_by(daily_fact(spark, sf, ()), ["refund_rate_amount", "net_revenue"], ["date"])
    return edge(df, "date", *RESULT)


@query("metrics_by_date_and_channel", _metrics_sql(("avg_order_value", "revenue_per_lead"), "date, channel"))
def _(spark, sf):
    df = metrics.metrics_by(daily_fact(spark, sf, ("channel",)), ["avg_order_value", "revenue_per_lead"], ["date", "channel"])
    return edge(df, "date", "channel", *RESULT)


@query("metrics_by_salesperson", _metrics_sql(("leads", "contact_rate", "follow_rate", "refund_rate_users", "refund_rate_orders"), "salesperson"))
def _(spark, sf):
    ids = ["leads", "contact_rate", "follow_rate", "refund_rate_users", "refund_rate_orders"]
    return edge(metrics.metrics_by(daily_fact(spark, sf, ("salesperson",)), ids, ["salesperson"]), "salesperson", *RESULT)


# ------------------------------------------------------------------ comparisons
COMPARED = ("current_value", "current_status", "baseline_value", "baseline_status", "delta", "relative_change", "percentage_point_change", "comparison_status")


def _change_sql(points: bool) -> str:
    """Changes of rows with exact hundredths cn/cd and bn/bd and both states."""
    return f"""
  CASE WHEN current_status <> 'available' THEN 'unavailable_current' WHEN baseline_status <> 'available' THEN 'unavailable_baseline' ELSE 'available' END AS comparison_status,
  CASE WHEN current_status = 'available' THEN CAST(cn AS DOUBLE) / CAST(cd AS DOUBLE) END AS current_value,
  CASE WHEN baseline_status = 'available' THEN CAST(bn AS DOUBLE) / CAST(bd AS DOUBLE) END AS baseline_value,
  CASE WHEN current_status = 'available' AND baseline_status = 'available' THEN CAST(cn * bd - bn * cd AS DOUBLE) / CAST(cd * bd AS DOUBLE) END AS delta,
  CASE WHEN current_status = 'available' AND baseline_status = 'available' THEN CAST(cn * bd - bn * cd AS DOUBLE) / NULLIF(CAST(cd * bn AS DOUBLE), 0) END AS relative_change,
  {"CASE WHEN current_status = 'available' AND baseline_status = 'available' THEN CAST(cn * bd - bn * cd AS DOUBLE) / CAST(cd * bd AS DOUBLE) END" if points else "CAST(NULL AS DOUBLE)"} AS percentage_point_change"""


def _ratio_state(n: str, d: str, a: str, b: str) -> str:
    return f"CASE WHEN COALESCE({n}, 0) = 0 THEN 'unavailable_no_data' WHEN COALESCE({d}, 0) = 0 THEN 'unavailable_no_data' WHEN {b} = 0 THEN 'unavailable_zero_denominator' ELSE 'available' END"


def _period_compare_sql(keys: str, num: str, den: str, cur: tuple[str, str], base: tuple[str, str], scale: int) -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    c = f"date BETWEEN DATE '{cur[0]}' AND DATE '{cur[1]}'"
    b = f"date BETWEEN DATE '{base[0]}' AND DATE '{base[1]}'"
    h = lambda f: f"CAST({f} * {scale} AS BIGINT)"
    return f"""
SELECT {lead}current_status, baseline_status, {_change_sql(True)}
FROM (SELECT {lead}{_ratio_state('cnn', 'cdn', 'cn', 'cd')} AS current_status, {_ratio_state('bnn', 'bdn', 'bn', 'bd')} AS baseline_status, cn, cd, bn, bd
  FROM (SELECT {lead}COUNT({num}) FILTER (WHERE {c}) AS cnn, COUNT({den}) FILTER (WHERE {c}) AS cdn,
    CAST(SUM({h(num)}) FILTER (WHERE {c}) AS HUGEINT) AS cn, CAST(SUM({h(den)}) FILTER (WHERE {c}) AS HUGEINT) AS cd,
    COUNT({num}) FILTER (WHERE {b}) AS bnn, COUNT({den}) FILTER (WHERE {b}) AS bdn,
    CAST(SUM({h(num)}) FILTER (WHERE {b}) AS HUGEINT) AS bn, CAST(SUM({h(den)}) FILTER (WHERE {b}) AS HUGEINT) AS bd
    FROM f_daily WHERE {c} OR {b} {group}) AS s) AS t"""


@query("compare_previous_period", _period_compare_sql("", "valid_leads", "leads", ("1998-01-01", "1998-03-31"), ("1997-10-03", "1997-12-31"), 1))
def _(spark, sf):
    return edge(metrics.compare(daily_fact(spark, sf, ()), "valid_lead_rate", "1998-01-01", "1998-03-31"), *COMPARED)


@query("compare_previous_week_by_team", _period_compare_sql("team", "refund_amount", "gross_revenue", ("1998-03-02", "1998-03-04"), ("1998-02-23", "1998-02-25"), 100))
def _(spark, sf):
    df = daily_fact(spark, sf, ("team",))
    out = metrics.compare(df, "refund_rate_amount", "1998-03-02", "1998-03-04", "previous_week", ("team",))
    return edge(out, "team", *COMPARED)


def _rolling_compare_sql(key: str, num: str, den: str | None, day: str, scale: int) -> str:
    first = f"DATE '{day}' - INTERVAL 7 DAY"
    h = lambda f: f"CAST({f} * {scale} AS BIGINT)"
    if den:
        daily = f"SELECT date, {key}, CAST(SUM({h(num)}) AS HUGEINT) AS n, CAST(SUM({h(den)}) AS HUGEINT) AS d, COUNT({num}) > 0 AND COUNT({den}) > 0 AS has FROM f_daily GROUP BY 1, 2"
        ok, zero = "has AND d <> 0", "has AND d = 0"
        used, part = "has", "d"
        base_state = "CASE WHEN n_ok = 0 THEN CASE WHEN n_zero > 0 THEN 'unavailable_zero_denominator' ELSE 'unavailable_no_data' END WHEN bd = 0 THEN 'unavailable_zero_denominator' ELSE 'available' END"
    else:
        daily = f"SELECT date, {key}, CAST(SUM({h(num)}) AS HUGEINT) AS n, CAST(1 AS HUGEINT) AS d, COUNT({num}) > 0 AS has FROM f_daily GROUP BY 1, 2"
        ok, zero, used, part = "has", "FALSE", "has", "1"
        base_state = "CASE WHEN n_ok = 0 THEN 'unavailable_no_data' ELSE 'available' END"
    now = f"date = DATE '{day}'"
    before = f"date >= {first} AND date < DATE '{day}'"
    return f"""
SELECT {key}, current_status, baseline_status, {_change_sql(den is not None)}
FROM (SELECT {key}, cn, cd, bn, bd, {base_state} AS baseline_status,
    CASE WHEN COALESCE(c_has, FALSE) = FALSE THEN 'unavailable_no_data' WHEN cd = 0 THEN 'unavailable_zero_denominator' ELSE 'available' END AS current_status
  FROM (SELECT {key}, BOOL_OR(has) FILTER (WHERE {now}) AS c_has, MAX(n) FILTER (WHERE {now}) AS cn, MAX(d) FILTER (WHERE {now}) AS cd,
      COUNT(*) FILTER (WHERE {before} AND {ok}) AS n_ok, COUNT(*) FILTER (WHERE {before} AND {zero}) AS n_zero,
      CAST(SUM(n) FILTER (WHERE {before} AND {used}) AS HUGEINT) AS bn, CAST(SUM({part}) FILTER (WHERE {before} AND {used}) AS HUGEINT) AS bd
    FROM ({daily}) AS x WHERE ({now}) OR ({before}) GROUP BY 1) AS s) AS t"""


@query("compare_rolling_average_by_channel", _rolling_compare_sql("channel", "paid_users", "valid_leads", "1998-03-31", 1))
def _(spark, sf):
    df = daily_fact(spark, sf, ("channel",))
    out = metrics.compare(df, "conversion_rate", "1998-03-31", "1998-03-31", "rolling_7d_average", ("channel",))
    return edge(out, "channel", *COMPARED)


@query("compare_rolling_mean_by_product", _rolling_compare_sql("product", "leads", None, "1998-03-31", 1))
def _(spark, sf):
    df = daily_fact(spark, sf, ("product",))
    out = metrics.compare(df, "leads", "1998-03-31", "1998-03-31", "rolling_7d_average", ("product",))
    return edge(out, "product", *COMPARED)


# ------------------------------------------------------------------ series
def _series_sql(num: str, den: str, start: str, end: str, dimension: str | None) -> str:
    days = f"SELECT CAST(d AS DATE) AS date FROM GENERATE_SERIES(DATE '{start}', DATE '{end}', INTERVAL 1 DAY) AS g(d)"
    key = f", {dimension}" if dimension else ""
    daily = f"SELECT date{key}, COUNT({num}) AS nn, COUNT({den}) AS dn, SUM({num}) AS n, SUM({den}) AS d FROM f_daily WHERE date BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY date{key}"
    spine = f"SELECT days.date, m.{dimension} FROM ({days}) AS days CROSS JOIN (SELECT DISTINCT {dimension} FROM ({daily}) AS x) AS m" if dimension else days
    on = f"s.date = a.date AND s.{dimension} IS NOT DISTINCT FROM a.{dimension}" if dimension else "s.date = a.date"
    dim = f"s.{dimension}, " if dimension else ""
    state = "CASE WHEN COALESCE(nn, 0) = 0 OR COALESCE(dn, 0) = 0 THEN 'unavailable_no_data' WHEN d = 0 THEN 'unavailable_zero_denominator' ELSE 'available' END"
    has = "COALESCE(nn, 0) > 0 AND COALESCE(dn, 0) > 0"
    return f"""SELECT CAST(s.date AS VARCHAR) AS date, {dim}{state} AS status,
  CASE WHEN {has} THEN CAST(CAST(n * 100 AS HUGEINT) AS DOUBLE) / NULLIF(CAST(CAST(d * 100 AS HUGEINT) AS DOUBLE), 0) END AS value,
  CASE WHEN {has} THEN CAST(n AS DOUBLE) END AS numerator_value, CASE WHEN {has} THEN CAST(d AS DOUBLE) END AS denominator_value
FROM ({spine}) AS s LEFT JOIN ({daily}) AS a ON {on}"""


@query("series_daily", _series_sql("refund_amount", "gross_revenue", "1994-12-25", "1996-12-31", None))
def _(spark, sf):
    df = trend.series(daily_fact(spark, sf, ()), "refund_rate_amount", "1994-12-25", "1996-12-31")
    return edge(df, "date", *RESULT[1:])


@query("series_daily_by_channel", _series_sql("paid_users", "valid_leads", "1998-01-01", "1999-12-31", "channel"))
def _(spark, sf):
    df = trend.series(daily_fact(spark, sf, ("channel",)), "conversion_rate", "1998-01-01", "1999-12-31", "channel")
    return edge(df, "date", "channel", *RESULT[1:])


def _rolling_sql(ratio: bool) -> str:
    days = "SELECT CAST(d AS DATE) AS date FROM GENERATE_SERIES(DATE '1995-01-01' - INTERVAL 6 DAY, DATE '2001-08-05', INTERVAL 1 DAY) AS g(d)"
    daily = "SELECT date, SUM(CAST(refund_amount * 100 AS BIGINT)) AS r, SUM(CAST(gross_revenue * 100 AS BIGINT)) AS g, COUNT(gross_revenue) AS k FROM f_daily GROUP BY 1"
    over = "OVER (ORDER BY s.date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)"
    if ratio:
        parts = f"SUM(CASE WHEN k > 0 AND g <> 0 THEN 1 ELSE 0 END) {over} AS n_ok, SUM(CASE WHEN k > 0 THEN r END) {over} AS n, SUM(CASE WHEN k > 0 THEN g END) {over} AS d"
    else:
        parts = f"SUM(CASE WHEN k > 0 THEN 1 ELSE 0 END) {over} AS n_ok, SUM(CASE WHEN k > 0 THEN g - r END) {over} AS n, SUM(CASE WHEN k > 0 THEN 100 END) {over} AS d"
    shown = "CAST(n AS DOUBLE) / 100, CAST(d AS DOUBLE) / 100" if ratio else "NULL, NULL"
    a, b = shown.split(", ")
    return f"""SELECT CAST(date AS VARCHAR) AS date, CASE WHEN ok THEN 'available' ELSE 'unavailable_no_data' END AS status,
  CASE WHEN ok THEN CAST(n AS DOUBLE) / CAST(d AS DOUBLE) END AS value,
  CAST(CASE WHEN ok THEN {a} END AS DOUBLE) AS numerator_value, CAST(CASE WHEN ok THEN {b} END AS DOUBLE) AS denominator_value
FROM (SELECT *, COALESCE(n_ok, 0) > 0 AND date - INTERVAL 6 DAY >= (SELECT MIN(date) FROM f_daily) AS ok
  FROM (SELECT s.date, {parts} FROM ({days}) AS s LEFT JOIN ({daily}) AS x ON x.date = s.date) AS w) AS t WHERE date >= DATE '1995-01-01'"""


@query("series_rolling_ratio", _rolling_sql(True))
def _(spark, sf):
    df = trend.rolling_series(daily_fact(spark, sf, ()), "refund_rate_amount", "1995-01-01", "2001-08-05")
    return edge(df, "date", *RESULT[1:])


@query("series_rolling_difference", _rolling_sql(False))
def _(spark, sf):
    df = trend.rolling_series(daily_fact(spark, sf, ()), "net_revenue", "1995-01-01", "2001-08-05")
    return edge(df, "date", *RESULT[1:])


def _funnel_sql() -> str:
    rows = []
    d = defs.FUNNELS["business_funnel"]
    for section in ("stages", "outcomes"):
        for i, m in enumerate(d[section], 1):
            rows.append(f"SELECT '{section}' AS section, {i} AS position, NULL AS from_stage, * FROM ({_metric_sql(m)}) AS x")
    for i, (a, b) in enumerate(d["step_rates"], 1):
        rows.append(
            f"SELECT 'step_rates' AS section, {i} AS position, '{b}' AS from_stage, '{a}' AS metric_id, 'available' AS status, "
            f"{_cents(a)} / {_cents(b)} AS value, {_num(a)} AS numerator_value, {_num(b)} AS denominator_value FROM agg"
        )
    body = " UNION ALL ".join(rows).replace("FROM agg", f"FROM ({_agg()}) AS agg")
    return f"SELECT section, CAST(position AS BIGINT) AS position, CAST(from_stage AS VARCHAR) AS from_stage, metric_id, status, value, numerator_value, denominator_value FROM ({body}) AS u"


@query("funnel_stages_steps_outcomes", _funnel_sql())
def _(spark, sf):
    return edge(metrics.funnel(daily_fact(spark, sf, ())), "section", "position", "from_stage", *RESULT)


# ------------------------------------------------------------------ contribution
def _contribution_cte(dimension: str, value: str, cur: tuple[str, str], base: tuple[str, str]) -> str:
    c = f"date BETWEEN DATE '{cur[0]}' AND DATE '{cur[1]}'"
    b = f"date BETWEEN DATE '{base[0]}' AND DATE '{base[1]}'"
    return f"""SELECT {dimension} AS dimension_value, COALESCE(SUM(CASE WHEN {c} THEN {value} END), 0) AS current_value,
  COALESCE(SUM(CASE WHEN {b} THEN {value} END), 0) AS baseline_value FROM f_daily WHERE {c} OR {b} GROUP BY 1"""


def _segments_sql(cte: str) -> str:
    return f"""SELECT dimension_value, CAST(current_value AS DOUBLE) AS current_value, CAST(baseline_value AS DOUBLE) AS baseline_value, CAST(delta AS DOUBLE) AS delta,
  CAST(delta AS DOUBLE) / NULLIF(CAST(SUM(delta) OVER () AS DOUBLE), 0) AS net_change_share,
  CAST(ABS(delta) AS DOUBLE) / NULLIF(CAST(SUM(ABS(delta)) OVER () AS DOUBLE), 0) AS movement_share,
  CASE WHEN delta > 0 THEN 'increase' WHEN delta < 0 THEN 'decrease' ELSE 'unchanged' END AS direction,
  ROW_NUMBER() OVER (ORDER BY ABS(delta) DESC, dimension_value ASC NULLS LAST) AS rank_by_absolute_change
FROM (SELECT *, current_value - baseline_value AS delta FROM ({cte}) AS a) AS s"""


Q1, Q0 = ("1998-04-01", "1998-06-30"), ("1997-12-31", "1998-03-31")
SEGMENT = ("dimension_value", "current_value", "baseline_value", "delta", "net_change_share", "movement_share", "direction", "rank_by_absolute_change")
BY_CHANNEL = _segments_sql(_contribution_cte("channel", "gross_revenue - refund_amount", Q1, Q0))


@query("contribution_net_revenue_by_channel", BY_CHANNEL)
def _(spark, sf):
    segments, _h = contribution.contribution(daily_fact(spark, sf, ("channel",)), "net_revenue", *Q1, "channel")
    return edge(segments, *SEGMENT)


WEEK = _segments_sql(_contribution_cte("salesperson", "leads", ("1998-03-02", "1998-03-08"), ("1998-02-23", "1998-03-01")))


@query("contribution_leads_by_salesperson_week", WEEK)
def _(spark, sf):
    df = daily_fact(spark, sf, ("salesperson",))
    segments, _h = contribution.contribution(df, "leads", "1998-03-02", "1998-03-08", "salesperson", "previous_week")
    return edge(segments, *SEGMENT)


@query(
    "contribution_reconciliation_header",
    f"""SELECT 'available' AS status, CAST(SUM(current_value) AS DOUBLE) AS overall_current, CAST(SUM(baseline_value) AS DOUBLE) AS overall_baseline,
  CAST(SUM(current_value) - SUM(baseline_value) AS DOUBLE) AS overall_delta, TRUE AS net_change_share_available,
  CAST(0 AS DOUBLE) AS current_reconciliation_difference, CAST(0 AS DOUBLE) AS baseline_reconciliation_difference, CAST(0 AS DOUBLE) AS reconciliation_difference
FROM ({_contribution_cte("product", "gross_revenue", Q1, Q0)}) AS a""",
)
def _(spark, sf):
    _s, header = contribution.contribution(daily_fact(spark, sf, ("product",)), "gross_revenue", *Q1, "product")
    return edge(
        header, "status", "overall_current", "overall_baseline", "overall_delta", "net_change_share_available",
        "current_reconciliation_difference", "baseline_reconciliation_difference", "reconciliation_difference",
    )


_blocked = """SELECT CASE WHEN BOOL_OR((c_rows > 0 AND c_n = 0) OR (b_rows > 0 AND b_n = 0)) THEN 'unavailable' ELSE 'available' END AS status,
  CASE WHEN BOOL_OR((c_rows > 0 AND c_n = 0) OR (b_rows > 0 AND b_n = 0)) THEN NULL ELSE CAST(SUM(c) - SUM(b) AS DOUBLE) END AS overall_delta
FROM (SELECT salesperson, COUNT(*) FILTER (WHERE date = DATE '1998-03-09') AS c_rows, COUNT(gross_revenue) FILTER (WHERE date = DATE '1998-03-09') AS c_n,
  COUNT(*) FILTER (WHERE date = DATE '1998-03-08') AS b_rows, COUNT(gross_revenue) FILTER (WHERE date = DATE '1998-03-08') AS b_n,
  COALESCE(SUM(gross_revenue) FILTER (WHERE date = DATE '1998-03-09'), 0) AS c, COALESCE(SUM(gross_revenue) FILTER (WHERE date = DATE '1998-03-08'), 0) AS b
  FROM f_daily WHERE date BETWEEN DATE '1998-03-08' AND DATE '1998-03-09' GROUP BY 1) AS t"""


@query("contribution_unavailable_segment", _blocked)
def _(spark, sf):
    df = daily_fact(spark, sf, ("salesperson",))
    _s, header = contribution.contribution(df, "gross_revenue", "1998-03-09", "1998-03-09", "salesperson")
    return edge(header, "status", "overall_delta")


BY_PRODUCT = _segments_sql(_contribution_cte("product", "gross_revenue", Q1, Q0))
for _kind, _cond, _order in (
    ("increases", "direction = 'increase'", "rank_by_absolute_change"),
    ("decreases", "direction = 'decrease'", "rank_by_absolute_change"),
    ("movements", "TRUE", "rank_by_absolute_change"),
):
    def _top(spark, sf, kind=_kind):
        segments, _h = contribution.contribution(daily_fact(spark, sf, ("product",)), "gross_revenue", *Q1, "product")
        return edge(contribution.top(segments, kind, 5), *SEGMENT)

    query(f"contribution_top_{_kind}", f"SELECT * FROM ({BY_PRODUCT}) AS z WHERE {_cond} ORDER BY {_order} LIMIT 5")(_top)


# ------------------------------------------------------------------ anomaly scans
EVALUATED = (
    "rule_id", "date", "dimension_value", "current_value", "current_status", "baseline_value", "baseline_status",
    "delta", "relative_change", "percentage_point_change", "skip_reason", "severity", "is_event",
)


def _scan_base(rule_id: str, dim: str | None, num: str, den: str | None, scale: int, lookback: str, weekly: bool = False) -> str:
    """Daily parts with their baseline: one row per day and member with data."""
    h = lambda f: f"CAST({f} * {scale} AS BIGINT)"
    key = f"{dim}" if dim else "CAST(NULL AS VARCHAR)"
    d = f"SUM({h(den)})" if den else "1"
    has = f"COUNT({num}) > 0 AND COUNT({den}) > 0" if den else f"COUNT({num}) > 0"
    daily = f"SELECT date, {key} AS m, CAST(SUM({h(num)}) AS HUGEINT) AS n, CAST({d} AS HUGEINT) AS d, {has} AS has FROM f_daily WHERE date BETWEEN DATE '{lookback}' AND DATE '{END}' GROUP BY 1, 2"
    frame = "INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING" if weekly else "INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING"
    over = f"OVER (PARTITION BY m ORDER BY date RANGE BETWEEN {frame})"
    zero = "has AND d = 0" if den else "FALSE"
    return f"""SELECT '{rule_id}' AS rule_id, date, m AS dimension_value, n AS cn, d AS cd,
    CASE WHEN NOT has THEN 'unavailable_no_data' WHEN d = 0 THEN 'unavailable_zero_denominator' ELSE 'available' END AS current_status,
    CASE WHEN COALESCE(SUM(CASE WHEN has AND d <> 0 THEN 1 ELSE 0 END) {over}, 0) = 0
         THEN CASE WHEN COALESCE(SUM(CASE WHEN {zero} THEN 1 ELSE 0 END) {over}, 0) > 0 THEN 'unavailable_zero_denominator' ELSE 'unavailable_no_data' END
         ELSE 'available' END AS baseline_status,
    CAST(SUM(CASE WHEN has THEN n END) {over} AS HUGEINT) AS bn, CAST(SUM(CASE WHEN has THEN d END) {over} AS HUGEINT) AS bd
  FROM ({daily}) AS x"""


def _scan_sql(base: str, points: bool, low: str, severity: str, start: str = START) -> str:
    judged = f"""SELECT rule_id, date, dimension_value, cd, current_status, baseline_status, {_change_sql(points)} FROM ({base}) AS b"""
    skipped = f"""SELECT *, CASE WHEN comparison_status <> 'available' THEN 'no_data' WHEN {low} THEN 'low_volume' END AS skip_reason FROM ({judged}) AS j"""
    return f"""SELECT rule_id, date, dimension_value, current_value, current_status, baseline_value, baseline_status,
  CASE WHEN skip_reason IS NULL THEN delta END AS delta, CASE WHEN skip_reason IS NULL THEN relative_change END AS relative_change,
  CASE WHEN skip_reason IS NULL THEN percentage_point_change END AS percentage_point_change, skip_reason,
  CASE WHEN skip_reason IS NULL THEN {severity} END AS severity FROM ({skipped}) AS k WHERE date >= DATE '{start}'"""


def _drop(w: float, c: float) -> str:
    return f"CASE WHEN relative_change <= {c} THEN 'critical' WHEN relative_change <= {w} THEN 'warning' END"


SCANS = {
    "channel_valid_lead_rate_drop": _scan_sql(
        _scan_base("channel_valid_lead_rate_drop", "channel", "valid_leads", "leads", 1, "1995-01-01"), True, "cd < 3", _drop(-0.12, -0.20)),
    "team_conversion_rate_drop": _scan_sql(
        _scan_base("team_conversion_rate_drop", "team", "paid_users", "valid_leads", 1, "1995-01-01"), True, "cd < 3", _drop(-0.15, -0.25)),
    "product_refund_rate_rise": _scan_sql(
        _scan_base("product_refund_rate_rise", "product", "refund_amount", "gross_revenue", 100, "1995-01-01"), True, "cd < 100000",
        "CASE WHEN percentage_point_change >= 0.08 THEN 'critical' WHEN percentage_point_change >= 0.04 THEN 'warning' END"),
}
SCAN_ALL = " UNION ALL ".join(SCANS.values())
_dated = "SELECT rule_id, CAST(date AS VARCHAR) AS date, dimension_value, current_value, current_status, baseline_value, baseline_status, delta, relative_change, percentage_point_change, skip_reason, severity, {event} AS is_event FROM ({scan}) AS f"


def scan_fact(spark, sf):
    return daily_fact(spark, sf, ("channel", "team", "product"))


@query("anomaly_scan_all_rules", _dated.format(event="severity IS NOT NULL", scan=SCAN_ALL))
def anomaly_scan_all_rules(spark, sf):
    return edge(anomaly.evaluate_rules(scan_fact(spark, sf), START, END, RULES), *EVALUATED)


_default = SCAN_ALL.replace("cd < 3 ", "cd < 100 ")


@query(
    "anomaly_scan_configured_rules",
    _dated.format(event="severity IS NOT NULL", scan=_default),
)
def _(spark, sf):
    return edge(anomaly.evaluate_rules(scan_fact(spark, sf), START, END), *EVALUATED)


_week = _scan_sql(
    _scan_base("leads_week_drop", "team", "leads", None, 1, "1995-01-01", weekly=True), False, "ABS(baseline_value) < 4",
    "CASE WHEN ABS(relative_change) >= 1.0 THEN 'critical' WHEN ABS(relative_change) >= 0.5 THEN 'warning' WHEN ABS(relative_change) >= 0.25 THEN 'info' END")


@query("anomaly_previous_week", _dated.format(event="severity IS NOT NULL", scan=_week))
def _(spark, sf):
    return edge(anomaly.evaluate_rules(daily_fact(spark, sf, ("team",)), START, END, [WEEK_RULE]), *EVALUATED)


_streak = _scan_sql(
    _scan_base("leads_streak", None, "leads", None, 1, "1994-12-31"), False, "FALSE", _drop(-0.05, -0.5), start="1995-01-07")
_streak_sql = f"""SELECT rule_id, CAST(date AS VARCHAR) AS date, dimension_value, current_value, current_status, baseline_value, baseline_status, delta, relative_change,
  percentage_point_change, skip_reason, severity, is_event FROM (SELECT *, COUNT(*) FILTER (WHERE severity IN ('warning', 'critical')) OVER (ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) = 2 AS is_event FROM ({_streak}) AS f) AS g
WHERE date >= DATE '{START}'"""


@query("anomaly_consecutive_days", _streak_sql)
def _(spark, sf):
    return edge(anomaly.evaluate_rules(daily_fact(spark, sf, ()), START, END, [STREAK_RULE]), *EVALUATED)


_z = f"""SELECT 'leads_zscore' AS rule_id, CAST(date AS VARCHAR) AS date, channel AS dimension_value, CAST(x AS DOUBLE) AS current_value,
  CASE WHEN k >= 20 THEN CAST(sx AS DOUBLE) / CAST(k AS DOUBLE) END AS baseline_value,
  ROUND(CASE WHEN ready THEN z END, 9) AS z_score, CASE WHEN NOT ready THEN 'no_data' END AS skip_reason,
  CASE WHEN ready THEN CASE WHEN ABS(z) >= 3 THEN 'critical' WHEN ABS(z) >= 2 THEN 'warning' END END AS severity
FROM (SELECT *, k >= 20 AND spread > 0 AS ready, (CAST(x * k - sx AS DOUBLE) / CAST(k AS DOUBLE)) / NULLIF(SQRT(CAST(spread AS DOUBLE)) / CAST(k AS DOUBLE), 0) AS z
  FROM (SELECT *, k * sxx - sx * sx AS spread FROM (SELECT date, channel, x, COUNT(*) OVER w AS k, SUM(x) OVER w AS sx, SUM(x * x) OVER w AS sxx
    FROM (SELECT date, channel, CAST(SUM(leads) AS BIGINT) AS x FROM f_daily WHERE date <= DATE '{END}' GROUP BY 1, 2) AS d
    WINDOW w AS (PARTITION BY channel ORDER BY date RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)) AS a) AS b) AS c
WHERE date >= DATE '{START}'"""


@query("anomaly_zscore", _z)
def _(spark, sf):
    from pyspark.sql import functions as F

    df = anomaly.evaluate_rules(daily_fact(spark, sf, ("channel",)), START, END, [ZSCORE_RULE])
    df = df.withColumn("z_score", F.round("z_score", 9))
    return edge(df, "rule_id", "date", "dimension_value", "current_value", "baseline_value", "z_score", "skip_reason", "severity")


_summary = f"""SELECT CAST(d.date AS VARCHAR) AS date, CAST(3 AS BIGINT) AS rules_evaluated, CAST(g.n AS BIGINT) AS groups_evaluated,
  COUNT(*) FILTER (WHERE severity = 'warning') AS warning_count, COUNT(*) FILTER (WHERE severity = 'critical') AS critical_count,
  COUNT(*) FILTER (WHERE severity = 'info') AS info_count,
  CAST(g.n - COUNT(*) FILTER (WHERE s.rule_id IS NOT NULL AND COALESCE(skip_reason, '') <> 'no_data') AS BIGINT) AS skipped_no_data_count,
  COUNT(*) FILTER (WHERE skip_reason = 'low_volume') AS skipped_low_volume_count
FROM (SELECT CAST(x AS DATE) AS date FROM GENERATE_SERIES(DATE '{START}', DATE '{END}', INTERVAL 1 DAY) AS t(x)) AS d
CROSS JOIN (SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT channel FROM f_daily) AS a) + (SELECT COUNT(*) FROM (SELECT DISTINCT team FROM f_daily) AS b) + (SELECT COUNT(*) FROM (SELECT DISTINCT product FROM f_daily) AS c) AS n) AS g
LEFT JOIN ({SCAN_ALL}) AS s ON s.date = d.date GROUP BY d.date, g.n"""


@query("anomaly_scan_summary", _summary)
def _(spark, sf):
    scanned = anomaly.scan_rows(scan_fact(spark, sf), START, END, RULES)
    return edge(anomaly.scan_summary(scanned, START, END, RULES))


@query(
    "anomaly_events",
    f"""SELECT rule_id || '|' || CAST(date AS VARCHAR) || '|' || COALESCE(dimension_value, '<NULL>') AS event_id, severity,
  current_value, baseline_value, delta, relative_change, percentage_point_change FROM ({SCAN_ALL}) AS s WHERE severity IS NOT NULL""",
)
def anomaly_events(spark, sf):
    ev = anomaly.events(anomaly.evaluate_rules(scan_fact(spark, sf), START, END, RULES))
    return edge(ev, "event_id", "severity", "current_value", "baseline_value", "delta", "relative_change", "percentage_point_change")


def _by_rule(part) -> str:
    return "CASE rule_id " + " ".join(f"WHEN '{r['id']}' THEN '{part(r)}'" for r in RULES) + " END"


def _percent_sql(c: str, sign: str = "", unit: str = "%") -> str:
    return f"FORMAT('{{:{sign}.2f}}{unit}', ROUND(100 * {c}, 2))"


_SENTENCE = f"""CAST(date AS VARCHAR) || ' ' || {_by_rule(lambda r: r['dimension'])} || '=' || COALESCE(dimension_value, 'None') || '的' || {_by_rule(lambda r: defs.metric(r['metric_id'])['name'])}
  || '为' || {_percent_sql('current_value')} || '，过去7日基线为' || {_percent_sql('baseline_value')} || COALESCE('，相对变化' || {_percent_sql('relative_change', '+')}, '')
  || COALESCE('，百分点变化' || {_percent_sql('percentage_point_change', '+', 'pct')}, '') || '。'"""


@query(
    "anomaly_event_evidence",
    f"""SELECT rule_id || '|' || CAST(date AS VARCHAR) || '|' || COALESCE(dimension_value, '<NULL>') AS event_id,
  {_SENTENCE} AS evidence
FROM ({SCAN_ALL}) AS s WHERE severity IS NOT NULL""",
)
def _(spark, sf):
    ev = anomaly.events(anomaly.evaluate_rules(scan_fact(spark, sf), START, END, RULES))
    return edge(ev, "event_id", "evidence")


# ------------------------------------------------------------------ diagnosis
def diagnosed(spark, sf, filters=None):
    """Diagnosis of every event of the scan, over the whole fact."""
    fact = written(daily_fact(spark, sf))
    events = anomaly.events(anomaly.evaluate_rules(fact, START, END, RULES))
    return diagnosis.diagnose(fact, events, filters=filters)


_EV = f"SELECT rule_id || '|' || CAST(date AS VARCHAR) || '|' || COALESCE(dimension_value, '<NULL>') AS event_id, rule_id, date, dimension_value AS m FROM ({SCAN_ALL}) AS s WHERE severity IS NOT NULL"
# each event with its day and the same day a week before, so that the fact is joined by equality
_EV = f"WITH e0 AS MATERIALIZED ({_EV}) SELECT * FROM e0"
_EV2 = "ev2 AS MATERIALIZED (SELECT *, date AS rd FROM ev WHERE m IS NOT NULL UNION ALL SELECT *, CAST(date - INTERVAL 7 DAY AS DATE) AS rd FROM ev WHERE m IS NOT NULL)"
_PAIRS = (
    ("channel_valid_lead_rate_drop", "channel", ("valid_leads", "leads"), ("business_line", "product", "team", "salesperson")),
    ("team_conversion_rate_drop", "team", ("paid_users", "valid_leads"), ("business_line", "product", "channel", "salesperson")),
    ("product_refund_rate_rise", "product", ("refund_amount", "gross_revenue"), ("channel", "team", "salesperson")),
)


def _observed_sql() -> str:
    out = []
    for rule, dim, parts, _c in _PAIRS:
        for i, p in enumerate(parts, 1):
            out.append(f"""SELECT e.event_id, CAST({i} AS BIGINT) AS position, '{p}' AS metric_id,
  CASE WHEN COUNT(f.{p}) FILTER (WHERE f.date = e.date) > 0 THEN 'available' ELSE 'unavailable_no_data' END AS current_status,
  CASE WHEN COUNT(f.{p}) FILTER (WHERE f.date < e.date) > 0 THEN 'available' ELSE 'unavailable_no_data' END AS baseline_status,
  SUM(f.{p}) FILTER (WHERE f.date = e.date) AS c, SUM(f.{p}) FILTER (WHERE f.date < e.date) AS b
FROM (SELECT * FROM ev2 WHERE rule_id = '{rule}') AS e LEFT JOIN f_daily AS f ON f.{dim} = e.m AND f.date = e.rd GROUP BY 1""")
    union = " UNION ALL ".join(out)
    return f"""SELECT event_id, position, metric_id, current_status, baseline_status, CAST(c AS DOUBLE) AS current_value, CAST(b AS DOUBLE) AS baseline_value,
  CAST(c - b AS DOUBLE) AS delta, CAST(CAST((c - b) * 100 AS HUGEINT) AS DOUBLE) / NULLIF(CAST(CAST(b * 100 AS HUGEINT) AS DOUBLE), 0) AS relative_change,
  CASE WHEN c > b THEN 'increase' WHEN c < b THEN 'decrease' WHEN c = b THEN 'unchanged' END AS direction FROM ({union}) AS u"""


def _with_events(body: str) -> str:
    """The events as a leading table of the query."""
    return f"SELECT * FROM (WITH ev AS MATERIALIZED ({_EV}), {_EV2} {body}) AS q"


@query("diagnosis_observations", _with_events(_observed_sql()))
def _(spark, sf):
    d = diagnosed(spark, sf)
    return edge(
        d.observations, "event_id", "position", "metric_id", "current_status", "baseline_status",
        "current_value", "baseline_value", "delta", "relative_change", "direction",
    )


def _drill_sql() -> str:
    """Segments of every (event, metric, candidate dimension) with their group state."""
    out = []
    for rule, dim, parts, cands in _PAIRS:
        for p in parts:
            for c in cands:
                out.append(f"""SELECT e.event_id, '{p}' AS metric_id, '{c}' AS dimension, f.{c} AS v,
  COUNT(*) FILTER (WHERE f.date = e.date) AS cr, COUNT(f.{p}) FILTER (WHERE f.date = e.date) AS ck, COALESCE(SUM(f.{p}) FILTER (WHERE f.date = e.date), 0) AS c,
  COUNT(*) FILTER (WHERE f.date < e.date) AS br, COUNT(f.{p}) FILTER (WHERE f.date < e.date) AS bk, COALESCE(SUM(f.{p}) FILTER (WHERE f.date < e.date), 0) AS b
FROM (SELECT * FROM ev2 WHERE rule_id = '{rule}') AS e JOIN f_daily AS f ON f.{dim} = e.m AND f.date = e.rd GROUP BY 1, 4""")
    union = " UNION ALL ".join(out)
    return f"""SELECT event_id, metric_id, dimension, v, CAST(c AS DECIMAL(24,2)) AS c, CAST(b AS DECIMAL(24,2)) AS b,
  BOOL_OR((cr > 0 AND ck = 0) OR (br > 0 AND bk = 0)) OVER g AS bad, SUM(ck) OVER g AS ckk, SUM(bk) OVER g AS bkk, BOOL_AND(v IS NULL) OVER g AS unnamed
FROM ({union}) AS u WINDOW g AS (PARTITION BY event_id, metric_id, dimension)"""


_findings = f"""WITH seg AS MATERIALIZED ({_drill_sql()}),
found AS (SELECT *, c - b AS delta FROM seg WHERE NOT bad AND ckk > 0 AND bkk > 0 AND NOT unnamed)
SELECT event_id, metric_id, dimension, kind, CAST(rn AS BIGINT) AS position, v AS dimension_value, CAST(c AS DOUBLE) AS current_value, CAST(b AS DOUBLE) AS baseline_value, CAST(delta AS DOUBLE) AS delta
FROM (SELECT *, 'movement' AS kind, ROW_NUMBER() OVER (PARTITION BY event_id, metric_id, dimension ORDER BY ABS(delta) DESC, v ASC NULLS LAST) AS rn FROM found
UNION ALL SELECT *, 'increase' AS kind, ROW_NUMBER() OVER (PARTITION BY event_id, metric_id, dimension ORDER BY ABS(delta) DESC, v ASC NULLS LAST) AS rn FROM found WHERE delta > 0
UNION ALL SELECT *, 'decrease' AS kind, ROW_NUMBER() OVER (PARTITION BY event_id, metric_id, dimension ORDER BY ABS(delta) DESC, v ASC NULLS LAST) AS rn FROM found WHERE delta < 0) AS r WHERE rn <= 3"""


@query("diagnosis_findings", _with_events(f"SELECT * FROM ({_findings}) AS z"))
def _(spark, sf):
    d = diagnosed(spark, sf)
    return edge(
        d.findings, "event_id", "metric_id", "dimension", "kind", "position", "dimension_value",
        "current_value", "baseline_value", "delta",
    )


SCOPE = {"channel": ["1-URGENT", "2-HIGH"]}
for _blocks in (blocks("dg_", SCAN_ALL, _SENTENCE, RULES, {}), blocks("df_", SCAN_ALL, _SENTENCE, RULES, SCOPE)):
    CTES.update(_blocks)
    ONCE.update(_blocks)


@query("diagnosis_results", "SELECT event_id, status, available_observations, finding_count, CAST(skipped_count AS BIGINT) AS skipped_count FROM dg_results")
def diagnosis_results(spark, sf):
    d = diagnosed(spark, sf)
    return edge(d.results, "event_id", "status", "available_observations", "finding_count", "skipped_count")


@query("diagnosis_skipped_dimensions", "SELECT event_id, metric_id, dimension, reason FROM dg_skipped")
def _(spark, sf):
    return edge(diagnosed(spark, sf).skipped)


@query("diagnosis_scope_with_filters", "SELECT event_id, status, finding_count, skipped_count, reason FROM df_results")
def _(spark, sf):
    d = diagnosed(spark, sf, SCOPE)
    return edge(d.results, "event_id", "status", "finding_count", "skipped_count", "reason")


@query("diagnosis_checks", "SELECT event_id, CAST(position AS BIGINT) AS position, text FROM dg_checks")
def _(spark, sf):
    return edge(diagnosed(spark, sf).checks)


@query("diagnosis_evidence", "SELECT event_id, CAST(position AS BIGINT) AS position, kind, message FROM dg_evidence")
def _(spark, sf):
    return edge(diagnosed(spark, sf).evidence)


@query("diagnosis_event_text", "SELECT event_id, summary FROM dg_text")
def _(spark, sf):
    return edge(diagnosis.event_text(diagnosed(spark, sf)))
