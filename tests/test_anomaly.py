"""Rule evaluation, streaks, z-scores, summaries and diagnosis on small frames."""

from datetime import date, timedelta

import pytest

from bizdiag import definitions as defs
from bizdiag.operators import anomaly, diagnosis

RULE = {
    "id": "r", "name": "r", "metric_id": "leads", "dimension": None, "method": "comparison",
    "comparison": "rolling_7d_average", "direction": "decrease",
    "thresholds": {"warning": ("relative_change", -0.08), "critical": ("relative_change", -0.25)},
}
ZSCORE = {
    "id": "z", "name": "z", "metric_id": "leads", "dimension": None, "method": "zscore", "direction": "increase",
    "thresholds": {"warning": ("z_score", 3), "critical": ("z_score", 4.5)},
}

DAY = [date(2024, 3, 4) + timedelta(days=i) for i in range(40)]


def days(values, **more):
    return [dict(date=DAY[i], leads=v, **more) for i, v in enumerate(values)]


def scan(df, day, rule):
    return anomaly.evaluate_rules(df, day, day, [rule]).collect()


@pytest.mark.parametrize("today,severity", [(352, "warning"), (368, "warning"), (300, "critical"), (369, None), (612, None)])
def test_rolling_rule(fact, today, severity):
    row = scan(fact(days([370, 430, 400, 395, 405, 410, 390, today])), DAY[7], RULE)[0]
    assert row.severity == severity and row.baseline_value == 400
    assert row.relative_change == (today - 400) / 400


def test_directions_and_percentage_points(fact):
    both = {**RULE, "direction": "both", "thresholds": {"info": ("relative_change", 0.2)}}
    assert scan(fact(days([400] * 7 + [310])), DAY[7], both)[0].severity == "info"
    assert scan(fact(days([400] * 7 + [490])), DAY[7], both)[0].severity == "info"
    rate = {**RULE, "metric_id": "valid_lead_rate", "thresholds": {"warning": ("percentage_point_change", -0.25)}}
    rows = [dict(r, valid_leads=300 if i < 7 else 200) for i, r in enumerate(days([400] * 8))]
    assert scan(fact(rows), DAY[7], rate)[0].severity == "warning"


def test_volume_gates(fact):
    df = fact(days([400] * 7 + [90]))
    assert scan(df, DAY[7], {**RULE, "min_baseline_value": 401})[0].skip_reason == "low_volume"
    assert scan(df, DAY[7], {**RULE, "min_baseline_value": 400})[0].severity == "critical"
    rate = {**RULE, "metric_id": "conversion_rate", "min_denominator": 25}
    rows = [dict(date=DAY[i], valid_leads=24, paid_users=6) for i in range(8)]
    assert scan(fact(rows), DAY[7], rate)[0].skip_reason == "low_volume"


def test_streak_needs_all_days(fact):
    rule = {**RULE, "comparison": "previous_week", "consecutive_days": 3}
    low = [500, 520, 480, 510, 505, 495, 515, 430, 440, 410]
    df = fact(days(low))
    assert not scan(df, DAY[8], rule)[0].is_event
    assert scan(df, DAY[9], rule)[0].is_event
    holed = fact([r for r in days(low) if r["date"] != DAY[8]])
    assert not scan(holed, DAY[9], rule)[0].is_event
    info = {**rule, "thresholds": {"info": ("relative_change", -0.1)}}
    assert not scan(df, DAY[9], info)[0].is_event


def test_zscore(fact):
    history = [48, 56] * 14  # mean 52, deviation 4
    row = scan(fact(days(history + [70])), DAY[28], ZSCORE)[0]
    assert (row.severity, row.z_score, row.baseline_value) == ("critical", 4.5, 52.0)
    assert scan(fact(days(history + [64])), DAY[28], ZSCORE)[0].severity == "warning"
    assert scan(fact(days(history + [53])), DAY[28], ZSCORE)[0].severity is None
    assert scan(fact(days([7] * 28 + [9])), DAY[28], ZSCORE)[0].skip_reason == "no_data"
    holed = fact(days(history[:5] + [None] + history[6:] + [90]))
    assert scan(holed, DAY[28], ZSCORE)[0].skip_reason == "no_data"
    assert scan(holed, DAY[28], {**ZSCORE, "min_history_days": 27})[0].severity == "critical"


def test_zscore_of_ratio(fact):
    rows = [dict(date=DAY[i], leads=5, valid_leads=1 + 2 * (i % 2)) for i in range(28)]
    rows.append(dict(date=DAY[28], leads=2, valid_leads=2))
    row = scan(fact(rows), DAY[28], {**ZSCORE, "metric_id": "valid_lead_rate"})[0]
    assert row.z_score == pytest.approx(3.0, abs=1e-6)  # mean 0.4, deviation 0.2


@pytest.mark.parametrize("unit", [10**7, 10**9, 10**11])
def test_zscore_of_large_ratios(fact, unit):
    """Fine sums do not fit: mean 6 and deviation 1 in units, judged all the same."""
    rows = [dict(date=DAY[i], leads=1, gross_revenue=f"{unit * (5 + i % 2 * 2)}", refund_amount="0") for i in range(28)]
    rows.append(dict(date=DAY[28], leads=1, gross_revenue=f"{unit * 12}", refund_amount="0"))
    row = scan(fact(rows), DAY[28], {**ZSCORE, "metric_id": "revenue_per_lead"})[0]
    assert (row.skip_reason, row.severity) == (None, "critical")
    assert row.z_score == pytest.approx(6.0, abs=1e-9) and row.baseline_value == 6.0 * unit


def test_zscore_beyond_all_sums_says_so(fact):
    rows = [dict(date=DAY[i], leads=1, gross_revenue=f"{10**15 + i}", refund_amount="0") for i in range(29)]
    row = scan(fact(rows), DAY[28], {**ZSCORE, "metric_id": "revenue_per_lead"})[0]
    assert (row.severity, row.skip_reason) == (None, "out_of_range")


def test_summary_counts_members_without_data(fact):
    rule = {**RULE, "dimension": "channel"}
    rows = days([33] * 7 + [22], channel="web") + [dict(date=DAY[2], channel="shop", leads=4)]
    scanned = anomaly.scan_rows(fact(rows), DAY[7], DAY[8], [rule])
    got = anomaly.scan_summary(scanned, DAY[7], DAY[8], [rule]).orderBy("date").collect()
    assert [(r.groups_evaluated, r.critical_count, r.skipped_no_data_count) for r in got] == [(2, 1, 1), (2, 0, 2)]


def test_event_text_has_no_causal_words(fact):
    ev = anomaly.events(anomaly.evaluate_rules(fact(days([64] * 7 + [40])), DAY[7], DAY[7], [RULE])).first()
    assert ev.evidence == "2024-03-11 整体的线索为40.00，过去7日基线为64.00，相对变化-37.50%。"
    assert not any(w in ev.evidence for w in ("导致", "因为", "造成"))


def diagnosable(fact):
    """One channel, three routes; on the last day one route loses half, one gains, one stays."""
    routes = (("alpha", "north", "kim", 90, 45), ("beta", "south", "lee", 60, 70), ("gamma", "south", "ray", 30, 30))
    rows = []
    for i in range(8):
        for product, team, person, usual, last in routes:
            rows.append(dict(date=DAY[i], business_line="retail", channel="web", product=product, team=team, salesperson=person,
                             leads=120, valid_leads=last if i == 7 else usual, paid_users=11, gross_revenue=640, refund_amount=32))
    return fact(rows)


CHANNEL = {**defs.RULES[0], "min_denominator": 10}


def test_diagnosis_of_one_event(fact):
    df = diagnosable(fact)
    ev = anomaly.events(anomaly.evaluate_rules(df, DAY[7], DAY[7], [CHANNEL]))
    d = diagnosis.diagnose(df, ev, filters={"business_line": "retail"})
    assert d.results.first().status == "complete"
    seen = {r.metric_id: r for r in d.observations.collect()}
    assert (seen["valid_leads"].current_value, seen["valid_leads"].baseline_value) == (145, 180)
    assert (seen["valid_leads"].relative_change, seen["valid_leads"].direction) == (pytest.approx(-35 / 180), "decrease")
    assert seen["leads"].delta == 0
    found = d.findings.where("kind = 'movement' and metric_id = 'valid_leads' and dimension = 'product'").orderBy("position").collect()
    assert [(r.dimension_value, r.delta) for r in found] == [("alpha", -45), ("beta", 10), ("gamma", 0)]
    assert {r.dimension: r.reason for r in d.skipped.collect()} == {"business_line": "dimension fixed by scope filter"}
    kinds = [r.kind for r in d.evidence.orderBy("position").collect()]
    assert kinds[0] == "FACT" and kinds[-1] == "RECOMMENDATION" and kinds == sorted(kinds, key=("FACT", "DIAGNOSTIC", "RECOMMENDATION").index)
    assert d.checks.count() == 3 + 3
    text = diagnosis.event_text(d).first().summary
    assert text.startswith("诊断状态：complete") and text.endswith(defs.DIAGNOSIS_LIMITATION)
    assert "- 有效线索：current=145，baseline=180，delta=-35" in text


def test_diagnosis_without_an_open_dimension(fact):
    df = diagnosable(fact)
    ev = anomaly.events(anomaly.evaluate_rules(df, DAY[7], DAY[7], [CHANNEL]))
    first = df.first()
    fixed = {d: first[d] for d in defs.RECIPES[CHANNEL["metric_id"]]["candidate_dimensions"]}
    d = diagnosis.diagnose(df, ev, filters=fixed)
    assert d.results.count() == ev.count() and d.findings.count() == 0
    assert {r.reason for r in d.skipped.collect()} == {"dimension fixed by scope filter"}
    assert d.observations.select("metric_id").distinct().count() == 2 and d.evidence.count() > 0


def test_batch_equals_one_by_one(fact):
    df = diagnosable(fact)
    team = {**defs.RULES[1], "direction": "both", "thresholds": {"info": ("relative_change", 0.01)}, "min_denominator": 1}
    rules = [CHANNEL, team]
    ev = anomaly.events(anomaly.evaluate_rules(df, DAY[7], DAY[7], rules))
    together = diagnosis.diagnose(df, ev).findings.collect()
    alone = []
    for r in ev.select("event_id").collect():
        alone += diagnosis.diagnose(df, ev.where(ev.event_id == r.event_id)).findings.collect()
    assert sorted(map(str, together)) == sorted(map(str, alone)) and len(together) > 10


def test_diagnosis_scope_problems(fact):
    df = fact(days([70] * 8, channel=None, valid_leads=49) + [dict(date=DAY[7], leads=700, valid_leads=7)])
    ev = anomaly.events(anomaly.evaluate_rules(df, DAY[7], DAY[7], [CHANNEL]))
    row = diagnosis.diagnose(df, ev).results.first()
    assert row.status == "insufficient_data" and row.reason.startswith("NULL anomaly")
    df = diagnosable(fact)
    ev = anomaly.events(anomaly.evaluate_rules(df, DAY[7], DAY[7], [CHANNEL]))
    row = diagnosis.diagnose(df, ev, filters={"channel": "phone"}).results.first()
    assert row.status == "insufficient_data" and "conflicts" in row.reason


def test_any_event_with_a_recipe_is_diagnosed(fact):
    """Also events of metrics and dimensions that no shipped rule has, and of the whole."""
    routes = (("web", "alpha", 900, 400), ("web", "beta", 300, 350), ("shop", "alpha", 200, 210))
    rows = [
        dict(date=DAY[i], business_line="retail", channel=c, product=p, team="north", leads=9, gross_revenue=last if i == 7 else usual, refund_amount=10)
        for i in range(8) for c, p, usual, last in routes
    ]
    df = fact(rows)
    drop = {**RULE, "metric_id": "net_revenue", "comparison": "previous_week"}
    ev = anomaly.events(anomaly.evaluate_rules(df, DAY[7], DAY[7], [drop, {**drop, "id": "by_channel", "dimension": "channel"}]))
    d = diagnosis.diagnose(df, ev)
    got = {r.event_id: r for r in d.results.collect()}
    assert len(got) == 2 and all(r.status in ("complete", "partial") and r.finding_count > 0 for r in got.values())
    whole = next(k for k in got if k.startswith("r|"))
    top = d.findings.where(d.findings.event_id == whole).where("kind = 'movement' and metric_id = 'net_revenue' and dimension = 'channel'")
    assert [(r.dimension_value, r.delta) for r in top.orderBy("position").collect()] == [("web", -450), ("shop", 10)]
    assert diagnosis.diagnose(df, ev.limit(0)).results.count() == 0


def test_definitions_reject_bad_rules():
    bad = [
        {"dimension": "date"}, {"method": "magic"}, {"comparison": "previous_period"}, {"direction": "up"}, {"thresholds": {}},
        {"thresholds": {"fatal": ("relative_change", -1)}}, {"thresholds": {"warning": ("z_score", -1)}},
        {"thresholds": {"warning": ("relative_change", 0.1)}}, {"thresholds": {"warning": ("percentage_point_change", -0.1)}},
        {"min_denominator": 5}, {"min_baseline_value": -1}, {"consecutive_days": 0}, {"formula": "x"}, {"metric_id": "nope"},
    ]
    for change in bad:
        with pytest.raises(ValueError):
            defs.checked_rule({**RULE, **change})
    with pytest.raises(ValueError):
        defs.select_rules([RULE, RULE])
    with pytest.raises(ValueError):
        defs.select_rules([RULE], ["other"])
    with pytest.raises(ValueError):
        defs.check_metrics({"a": {"type": "difference", "parts": ("a", "a"), "format": "integer"}})
    for mid, recipe in defs.RECIPES.items():
        defs.checked_recipe(mid, recipe)
    with pytest.raises(ValueError):
        defs.checked_recipe("valid_lead_rate", {**defs.RECIPES["valid_lead_rate"], "contribution_metrics": ("valid_lead_rate",)})
