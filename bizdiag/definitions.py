"""Metric, funnel, rule, recipe and policy definitions, with the checks their users rely on.

Everything here is data. The values are fixed: results depend on them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from bizdiag.schema import DIMENSIONS, MEASURES

# ---------------------------------------------------------------- metrics (fixed values)
METRICS: dict[str, dict] = {
    "impressions": {"name": "曝光", "type": "atomic", "field": "impressions", "format": "integer"},
    "leads": {"name": "线索", "type": "atomic", "field": "leads", "format": "integer"},
    "valid_leads": {"name": "有效线索", "type": "atomic", "field": "valid_leads", "format": "integer"},
    "contacted_leads": {"name": "已联系线索", "type": "atomic", "field": "contacted_leads", "format": "integer"},
    "followed_leads": {"name": "已跟进线索", "type": "atomic", "field": "followed_leads", "format": "integer"},
    "paid_users": {"name": "支付用户", "type": "atomic", "field": "paid_users", "format": "integer"},
    "paid_orders": {"name": "支付订单", "type": "atomic", "field": "paid_orders", "format": "integer"},
    "gross_revenue": {"name": "支付金额", "type": "atomic", "field": "gross_revenue", "format": "currency"},
    "refund_users": {"name": "退款用户", "type": "atomic", "field": "refund_users", "format": "integer"},
    "refund_orders": {"name": "退款订单", "type": "atomic", "field": "refund_orders", "format": "integer"},
    "refund_amount": {"name": "退款金额", "type": "atomic", "field": "refund_amount", "format": "currency"},
    "valid_lead_rate": {"name": "有效线索率", "type": "ratio", "parts": ("valid_leads", "leads"), "format": "percentage"},
    "contact_rate": {"name": "联系率", "type": "ratio", "parts": ("contacted_leads", "valid_leads"), "format": "percentage"},
    "follow_rate": {"name": "跟进率", "type": "ratio", "parts": ("followed_leads", "valid_leads"), "format": "percentage"},
    "conversion_rate": {"name": "支付转化率", "type": "ratio", "parts": ("paid_users", "valid_leads"), "format": "percentage"},
    "avg_order_value": {"name": "客单价", "type": "ratio", "parts": ("gross_revenue", "paid_users"), "format": "currency"},
    "refund_rate_amount": {"name": "金额退款率", "type": "ratio", "parts": ("refund_amount", "gross_revenue"), "format": "percentage"},
    "refund_rate_users": {"name": "用户退款率", "type": "ratio", "parts": ("refund_users", "paid_users"), "format": "percentage"},
    "refund_rate_orders": {"name": "订单退款率", "type": "ratio", "parts": ("refund_orders", "paid_orders"), "format": "percentage"},
    "net_revenue": {"name": "净收入", "type": "difference", "parts": ("gross_revenue", "refund_amount"), "format": "currency"},
    "revenue_per_lead": {"name": "单线索收入", "type": "ratio", "parts": ("net_revenue", "leads"), "format": "currency"},
}

# ---------------------------------------------------------------- funnel (fixed values)
FUNNELS: dict[str, dict] = {
    "business_funnel": {
        "name": "经营漏斗",
        "stages": ("impressions", "leads", "valid_leads", "contacted_leads", "followed_leads", "paid_users"),
        "step_rates": (
            ("leads", "impressions"),
            ("valid_leads", "leads"),
            ("contacted_leads", "valid_leads"),
            ("paid_users", "valid_leads"),
        ),
        "outcomes": ("gross_revenue", "refund_amount", "net_revenue"),
    }
}

# ---------------------------------------------------------------- anomaly rules (fixed values)
RULES: tuple[dict, ...] = (
    {
        "id": "channel_valid_lead_rate_drop", "name": "渠道有效线索率下降",
        "metric_id": "valid_lead_rate", "dimension": "channel",
        "method": "comparison", "comparison": "rolling_7d_average", "direction": "decrease",
        "thresholds": {"warning": ("relative_change", -0.12), "critical": ("relative_change", -0.20)},
        "min_denominator": 100,
    },
    {
        "id": "team_conversion_rate_drop", "name": "团队支付转化率下降",
        "metric_id": "conversion_rate", "dimension": "team",
        "method": "comparison", "comparison": "rolling_7d_average", "direction": "decrease",
        "thresholds": {"warning": ("relative_change", -0.15), "critical": ("relative_change", -0.25)},
        "min_denominator": 100,
    },
    {
        "id": "product_refund_rate_rise", "name": "产品退款率上升",
        "metric_id": "refund_rate_amount", "dimension": "product",
        "method": "comparison", "comparison": "rolling_7d_average", "direction": "increase",
        "thresholds": {
            "warning": ("percentage_point_change", 0.04),
            "critical": ("percentage_point_change", 0.08),
        },
        "min_denominator": 1000,
    },
)
SEVERITIES = ("critical", "warning", "info")
RULE_DEFAULTS = {
    "name": "", "dimension": None, "method": "comparison", "comparison": None,
    "min_denominator": None, "min_baseline_value": None,
    "history_window_days": 28, "min_history_days": None, "consecutive_days": 1,
}

# ---------------------------------------------------------------- recipes (fixed values)
RECIPES: dict[str, dict] = {
    "valid_lead_rate": {
        "diagnostic_type": "ratio",
        "components": ("valid_leads", "leads"),
        "contribution_metrics": ("valid_leads", "leads"),
        "contribution_comparison": "previous_week",
        "candidate_dimensions": ("business_line", "product", "team", "salesperson"),
        "suggested_checks": (
            "核对有效线索数量变化", "核对原始线索数量及结构变化", "检查变化幅度较大的产品和承接团队",
        ),
        "top_n": 3,
    },
    "conversion_rate": {
        "diagnostic_type": "ratio",
        "components": ("paid_users", "valid_leads"),
        "contribution_metrics": ("paid_users", "valid_leads"),
        "contribution_comparison": "previous_week",
        "candidate_dimensions": ("business_line", "product", "channel", "salesperson"),
        "suggested_checks": (
            "核对支付用户与有效线索数量变化", "检查变化幅度较大的产品、渠道和人员记录",
        ),
        "top_n": 3,
    },
    "refund_rate_amount": {
        "diagnostic_type": "ratio",
        "components": ("refund_amount", "gross_revenue"),
        "contribution_metrics": ("refund_amount", "gross_revenue"),
        "contribution_comparison": "previous_week",
        "candidate_dimensions": ("channel", "team", "salesperson"),
        "suggested_checks": (
            "核对退款金额与支付金额变化", "检查变化幅度较大的渠道、团队和人员记录",
        ),
        "top_n": 3,
    },
    "net_revenue": {
        "diagnostic_type": "additive",
        "components": ("gross_revenue", "refund_amount"),
        "contribution_metrics": ("net_revenue", "gross_revenue", "refund_amount"),
        "contribution_comparison": "previous_week",
        "candidate_dimensions": ("business_line", "product", "channel", "team"),
        "suggested_checks": (
            "核对支付金额与退款金额变化", "检查净收入变化幅度较大的经营分组",
        ),
        "top_n": 3,
    },
}
DIAGNOSIS_LIMITATION = "当前仅确认数据偏离、指标组成变化和单层算术分布，不能确认具体业务原因或因果影响。"

# ---------------------------------------------------------------- quality (fixed values)
QUALITY_CONFIG = {
    "missing_warning_threshold": 0.05,
    "sample_rows_limit": 10,
    "duplicate_check_enabled": True,
    "consistency_checks_enabled": True,
}
CONSISTENCY_RULES = (
    ("impressions", "leads", "impressions_gte_leads"),
    ("leads", "valid_leads", "leads_gte_valid_leads"),
    ("valid_leads", "contacted_leads", "contacted_leads_lte_valid_leads"),
    ("valid_leads", "followed_leads", "followed_leads_lte_valid_leads"),
    ("valid_leads", "paid_users", "paid_users_lte_valid_leads"),
    ("paid_users", "refund_users", "refund_users_lte_paid_users"),
    ("paid_orders", "refund_orders", "refund_orders_lte_paid_orders"),
    ("gross_revenue", "refund_amount", "refund_amount_lte_gross_revenue"),
)

# ---------------------------------------------------------------- order policy (fixed values)
ORDER_POLICY = {
    "name": "DEFAULT_FILE_INTERNAL_POLICY",
    "status": "USABLE_WITH_LIMITATION",
    "amount_tolerance": 0.011,
    "observed_values": {
        "order_status_raw": ("交易完成", "待收货"),
        "processing_status_raw": (
            "配送完成", "已退款", "药品已出库", "待处理", "订单已接受", "无法配送退款中",
        ),
        "settlement_status_raw": ("已结算", "未结算", "结算中"),
    },
}

# ---------------------------------------------------------------- fact rules (fixed values)
FACT_RULES = {
    "max_core_facts": 5,
    "reconciliation_tolerance": 0.01,
    "loss_concentration_top_n": 5,
    "customer_status_labels": {
        "RETAINED": "两期持续活跃药店",
        "CURRENT_ONLY": "本期活跃、上期未活跃药店",
        "PREVIOUS_ONLY": "上期活跃、本期未活跃药店",
    },
    "product_status_labels": {
        "RETAINED_ACTIVE": "两期持续活跃商品",
        "CURRENT_ONLY_ACTIVE": "本期活跃、上期未活跃商品",
        "PREVIOUS_ONLY_ACTIVE": "上期活跃、本期未活跃商品",
    },
    "limitation": (
        "ORDER_POLICY_AND_PRODUCT_MAPPING_LIMITATION",
        "订单、退款、配送和结算状态的业务语义尚未确认；产品贡献中存在商品映射冲突。"
        "当前结论只描述文件内部进货金额及其观察维度。",
        "ORDER_STATUS_SEMANTICS_UNCONFIRMED;PRODUCT_MAPPING_LIMITATION",
    ),
    "do_not_infer": {
        "FINANCIAL_REVENUE_DECLINE": "当前数据不能推出财务收入下降。",
        "CUSTOMER_PERMANENT_LOSS": "PREVIOUS_ONLY 不能推出客户永久流失。",
        "PRICE_CAUSED_VOLUME_DECLINE": "当前阶段未分析价格，不能推出涨价导致销量下降。",
        "STOCKOUT_CAUSED_PRODUCT_DECLINE": "当前数据不能推出缺货导致商品采购下降。",
        "REFUND_CAUSED_PERFORMANCE_DECLINE": "状态语义尚未确认，不能推出退款导致进货金额下降。",
    },
}


# ---------------------------------------------------------------- checks
def metric(metric_id: str, metrics: Mapping[str, dict] = METRICS) -> dict:
    """One metric definition; unknown ids are rejected."""
    if metric_id not in metrics:
        raise ValueError(f"unknown metric: {metric_id}")
    return metrics[metric_id]


def check_metrics(metrics: Mapping[str, dict]) -> None:
    """Reject unknown types, fields, references and cycles."""
    for mid, d in metrics.items():
        if d.get("type") not in ("atomic", "ratio", "difference"):
            raise ValueError(f"metric {mid}: invalid type")
        if d.get("format") not in ("integer", "currency", "percentage"):
            raise ValueError(f"metric {mid}: invalid format")
        if d["type"] == "atomic":
            if d.get("field") not in MEASURES:
                raise ValueError(f"metric {mid}: not a measure: {d.get('field')}")
        elif len(d.get("parts", ())) != 2:
            raise ValueError(f"metric {mid}: needs two parts")
    for mid in metrics:
        _no_cycle(mid, metrics, ())


def _no_cycle(mid: str, metrics: Mapping[str, dict], path: tuple[str, ...]) -> None:
    if mid in path:
        raise ValueError(f"metric cycle: {' -> '.join((*path, mid))}")
    for part in metric(mid, metrics).get("parts", ()):
        _no_cycle(part, metrics, (*path, mid))


def atomic_fields(metric_ids: Iterable[str]) -> tuple[str, ...]:
    """Measures needed by the given metrics, each once."""
    found: dict[str, None] = {}
    for mid in metric_ids:
        d = metric(mid)
        if d["type"] == "atomic":
            found[d["field"]] = None
        else:
            found.update(dict.fromkeys(atomic_fields(d["parts"])))
    return tuple(found)


def is_additive(metric_id: str) -> bool:
    """True when the metric is a sum, or a difference of additive metrics."""
    d = metric(metric_id)
    return d["type"] == "atomic" or (
        d["type"] == "difference" and all(is_additive(p) for p in d["parts"])
    )


def check_funnel(definition: Mapping) -> None:
    """Reject funnels with wrong keys or unknown metrics."""
    if set(definition) != {"name", "stages", "step_rates", "outcomes"}:
        raise ValueError("funnel: invalid keys")
    for mid in (*definition["stages"], *definition["outcomes"]):
        metric(mid)
    for step in definition["step_rates"]:
        if len(step) != 2:
            raise ValueError("funnel: a step is (numerator, denominator)")
        metric(step[0]), metric(step[1])


def checked_rule(rule: Mapping) -> dict:
    """Rule with defaults filled in; invalid rules are rejected."""
    unknown = set(rule) - set(RULE_DEFAULTS) - {"id", "metric_id", "direction", "thresholds"}
    if unknown:
        raise ValueError(f"rule: unknown keys {sorted(unknown)}")
    r = {**RULE_DEFAULTS, **rule}
    rid, d = r["id"], metric(r["metric_id"])
    if r["dimension"] is not None and r["dimension"] not in DIMENSIONS:
        raise ValueError(f"rule {rid}: invalid dimension")
    if r["method"] == "comparison":
        if r["comparison"] not in ("rolling_7d_average", "previous_week"):
            raise ValueError(f"rule {rid}: invalid comparison")
        measures = {"relative_change", "percentage_point_change"}
    elif r["method"] == "zscore" and r["comparison"] is None:
        measures = {"z_score"}
    else:
        raise ValueError(f"rule {rid}: invalid method or comparison")
    if r["direction"] not in ("increase", "decrease", "both"):
        raise ValueError(f"rule {rid}: invalid direction")
    if not r["thresholds"] or set(r["thresholds"]) - set(SEVERITIES):
        raise ValueError(f"rule {rid}: invalid severities")
    for measure, value in r["thresholds"].values():
        if measure not in measures:
            raise ValueError(f"rule {rid}: invalid measure {measure}")
        if measure == "percentage_point_change" and d["format"] != "percentage":
            raise ValueError(f"rule {rid}: percentage points need a percentage metric")
        if (value > 0) if r["direction"] == "decrease" else (value < 0):
            raise ValueError(f"rule {rid}: threshold sign contradicts direction")
    if r["min_denominator"] is not None and d["type"] != "ratio":
        raise ValueError(f"rule {rid}: min_denominator needs a ratio")
    for key in ("min_denominator", "min_baseline_value"):
        if r[key] is not None and r[key] < 0:
            raise ValueError(f"rule {rid}: {key} must not be negative")
    r["min_history_days"] = r["min_history_days"] or r["history_window_days"]
    if not 2 <= r["min_history_days"] <= r["history_window_days"]:
        raise ValueError(f"rule {rid}: invalid history")
    if r["consecutive_days"] < 1:
        raise ValueError(f"rule {rid}: invalid consecutive_days")
    return r


def select_rules(rules: Iterable[Mapping], rule_ids: Iterable[str] | None = None) -> list[dict]:
    """Checked rules, optionally a named subset; duplicates and unknown ids are rejected."""
    by_id: dict[str, dict] = {}
    for rule in rules:
        if rule["id"] in by_id:
            raise ValueError(f"duplicate rule: {rule['id']}")
        by_id[rule["id"]] = checked_rule(rule)
    if rule_ids is None:
        return list(by_id.values())
    if isinstance(rule_ids, str):
        raise ValueError("rule_ids must be a sequence of ids")
    missing = [i for i in rule_ids if i not in by_id]
    if missing:
        raise ValueError(f"unknown rules: {missing}")
    return [by_id[i] for i in rule_ids]


def checked_recipe(metric_id: str, recipe: Mapping) -> Mapping:
    """Recipe whose references are valid."""
    d = metric(metric_id)
    kind = recipe["diagnostic_type"]
    if kind not in ("ratio", "additive") or (kind == "ratio") != (d["type"] == "ratio"):
        raise ValueError(f"recipe {metric_id}: type does not match the metric")
    for key in ("components", "contribution_metrics", "candidate_dimensions", "suggested_checks"):
        if not recipe[key] or len(set(recipe[key])) != len(recipe[key]):
            raise ValueError(f"recipe {metric_id}: {key} must be non-empty and distinct")
    if not all(is_additive(m) for m in recipe["contribution_metrics"]):
        raise ValueError(f"recipe {metric_id}: contribution metrics must be additive")
    if kind == "ratio":
        if set(d["parts"]) - set(recipe["components"]):
            raise ValueError(f"recipe {metric_id}: components must cover both parts")
        if not all(is_additive(m) for m in recipe["components"]):
            raise ValueError(f"recipe {metric_id}: components must be additive")
    if recipe["contribution_comparison"] not in ("previous_period", "previous_week"):
        raise ValueError(f"recipe {metric_id}: unsupported comparison")
    if set(recipe["candidate_dimensions"]) - set(DIMENSIONS):
        raise ValueError(f"recipe {metric_id}: invalid dimension")
    if not isinstance(recipe["top_n"], int) or recipe["top_n"] < 1:
        raise ValueError(f"recipe {metric_id}: invalid top_n")
    return recipe


check_metrics(METRICS)
