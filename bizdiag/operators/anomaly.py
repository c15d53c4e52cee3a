"""Rule scans over daily metrics: baselines, z-scores, severities, streaks, events, summaries.

Only (day, member) pairs which have data are evaluated; pairs without data can never alert, and
the summary counts them by arithmetic (members x days less evaluated pairs), so no dense
day x member grid is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizdiag import definitions as defs
from bizdiag.functions.text import fixed, percent
from bizdiag.operators.metrics import (
    NULL_NUMBER, Filters, Result, as_date, averaged, change_columns, daily_parts, in_scope, quotient,
    result_of, sums, whole,
)
from bizdiag.operators.trend import calendar, day_number
from bizdiag.schema import AVAILABLE, NO_DATA

LOOKBACK = 7
#: Decimals of the coarser sums of a ratio's history, used where those of nine decimals do not fit.
COARSE = 2


def _lookback(rule: Mapping) -> int:
    return LOOKBACK if rule["method"] == "comparison" else rule["history_window_days"]


def _daily(
    df: DataFrame, dimensions: Sequence[str | None], fields: Iterable[str]
) -> DataFrame:
    """Daily sums per (dimension, member) of all dimensions in one pass.

    The overall series is the member NULL of the dimension NULL.
    """
    cuts = [
        F.struct(
            F.lit(d).cast("string").alias("dimension"),
            (F.lit(None).cast("string") if d is None else F.col(d)).alias("dimension_value"),
        )
        for d in dimensions
    ]
    fields = list(fields)
    return (
        df.select("date", *fields, F.inline(F.array(*cuts)))
        .groupBy("date", "dimension", "dimension_value")
        .agg(*sums(fields))
    )


def scan_rows(
    df: DataFrame,
    start: date | str,
    end: date | str,
    rules: Sequence[Mapping] = defs.RULES,
    rule_ids: Sequence[str] | None = None,
    filters: Filters | None = None,
    available: Iterable[str] | None = None,
) -> DataFrame:
    """Evaluations of all rules, with the look-back days (``in_range`` is false there).

    One scan of the fact, one shuffle to daily sums and one to the members' windows serve all
    rules. ``first_seen`` marks the first day of a member in the widened range of its rule.
    """
    first, last = as_date(start), as_date(end)
    if first > last:
        raise ValueError("start is after end")
    chosen = defs.select_rules(rules, rule_ids)
    fields = defs.atomic_fields(r["metric_id"] for r in chosen)
    earliest = min(_query_start(r, first) for r in chosen)
    dimensions = list(dict.fromkeys(r["dimension"] for r in chosen))
    rows = _daily(in_scope(df, earliest, last, filters), dimensions, fields)
    by_member = Window.partitionBy("dimension", "dimension_value").orderBy(day_number())

    keep = ["date", "dimension", "dimension_value"]
    base_columns = []
    for i, rule in enumerate(chosen):
        cur = result_of(rule["metric_id"], available)
        parts = {
            "c_status": cur.status, "c_num": cur.num, "c_den": cur.den, "c_denominator": cur.denominator,
            **{f"d_{n}": c for n, c in daily_parts(rule["metric_id"], available).items()},
        }
        base_columns += [F.expr(c).alias(f"r{i}_{n}") for n, c in parts.items()]
    rows = rows.select(*keep, *base_columns)
    for i, rule in enumerate(chosen):
        if rule["method"] == "zscore":
            rows = rows.withColumns(_values_for_history(rule, i))
    windows = [c for i, r in enumerate(chosen) for c in _window_columns(r, i, by_member, first)]
    rows = rows.select("*", *windows)
    rows = rows.select(
        *keep, *[F.struct(*_judged(r, i)).alias(f"r{i}") for i, r in enumerate(chosen)],
        *[f"r{i}_first_seen" for i in range(len(chosen))],
    )
    rows = rows.select("*", *[_severity(r, f"r{i}").alias(f"r{i}_severity") for i, r in enumerate(chosen)])
    out = []
    for i, rule in enumerate(chosen):
        k, level = rule["consecutive_days"], F.col(f"r{i}_severity")
        flagged = F.coalesce(level.isin("warning", "critical"), F.lit(False))
        # a streak may not reach back before the first evaluated day
        flagged = flagged & (F.col("date") >= F.lit(first - timedelta(days=k - 1)))
        streak = F.count_if(flagged).over(by_member.rangeBetween(-(k - 1), 0))
        rows = rows.withColumn(
            f"r{i}_event", F.coalesce(level.isNotNull() if k == 1 else streak == k, F.lit(False))
        )
        mid = rule["metric_id"]
        out.append(
            F.struct(
                F.lit(rule["id"]).alias("rule_id"), F.lit(rule["name"]).alias("rule_name"),
                F.lit(rule["dimension"]).cast("string").alias("rule_dimension"),
                F.lit(mid).alias("metric_id"), F.lit(defs.metric(mid)["name"]).alias("metric_name"),
                F.lit(defs.metric(mid)["format"]).alias("format"),
                F.lit(rule["comparison"] or "zscore").alias("comparison_type"),
                *[F.col(f"r{i}.{c}").alias(c) for c in _JUDGED],
                level.alias("severity"), F.col(f"r{i}_event").alias("is_event"),
                F.col(f"r{i}_first_seen").alias("first_seen"),
            )
        )
    return (
        rows.select(*keep, F.inline(F.array(*out)))
        .where(F.col("rule_dimension").eqNullSafe(F.col("dimension")))
        .drop("rule_dimension")
        .withColumn("in_range", F.col("date") >= F.lit(first))
    )


_JUDGED = (
    "current_value", "current_status", "current_denominator", "baseline_value", "baseline_status",
    "delta", "relative_change", "percentage_point_change", "z_score", "skip_reason",
)


def _query_start(rule: Mapping, start: date) -> date:
    return start - timedelta(days=rule["consecutive_days"] - 1 + _lookback(rule))


def _values_for_history(rule: Mapping, i: int) -> dict[str, Column]:
    """Available value as an exact decimal: a ratio rounded to nine decimals, and as ``y`` to ``COARSE`` ones.

    NULL where the value does not fit. A history is judged by the finer sums if all of its values and their
    squares fit, else by the coarser ones (ratios up to 1e12 or so); beyond, it is skipped as ``out_of_range``.
    """
    ok, num, den = f"r{i}_c_status = '{AVAILABLE}'", f"r{i}_c_num", f"r{i}_c_den"
    if defs.metric(rule["metric_id"])["type"] == "ratio":
        value = lambda scale: F.expr(
            f"TRY_CAST(CASE WHEN {ok} THEN round({quotient(num, den)}, {scale}) END AS DECIMAL(18,{scale}))"
        )
        return {f"r{i}_x": value(_scale(rule)), f"r{i}_y": value(COARSE)}
    return {f"r{i}_x": F.expr(f"TRY_CAST(CASE WHEN {ok} THEN {num} / CAST(100 AS DECIMAL(3,0)) END AS DECIMAL(20,2))")}


def _window_columns(rule: Mapping, i: int, by_member, start: date) -> list[Column]:
    """Baseline or history of a rule; all rules share one partitioning and ordering."""
    p = f"r{i}_"
    inside = F.col("date") >= F.lit(_query_start(rule, start))
    seen = F.count_if(inside).over(by_member.rowsBetween(Window.unboundedPreceding, 0))
    out = [(inside & (seen == 1)).alias(f"{p}first_seen")]
    if rule["method"] == "zscore":
        back = by_member.rangeBetween(-rule["history_window_days"], -1)
        out.append(F.count_if(F.expr(f"{p}c_status = '{AVAILABLE}'")).over(back).alias(f"{p}n"))
        for name, scale in (("x", _scale(rule)), *([("y", COARSE)] if _scale(rule) > COARSE else [])):
            x = F.col(f"{p}{name}")
            square = (x * x).try_cast(f"decimal(38,{2 * scale})")
            out += [
                F.count(square).over(back).alias(f"{p}n{name}"),
                F.sum(x).over(back).alias(f"{p}s{name}"),
                F.sum(square).over(back).alias(f"{p}s{name}{name}"),
            ]
        return out
    if rule["comparison"] == "previous_week":
        back = by_member.rangeBetween(-LOOKBACK, -LOOKBACK)
        return out + [
            F.coalesce(F.max(f"{p}c_status").over(back), F.lit(NO_DATA)).alias(f"{p}b_status"),
            F.max(f"{p}c_num").over(back).alias(f"{p}b_num"),
            F.max(f"{p}c_den").over(back).alias(f"{p}b_den"),
        ]
    back = by_member.rangeBetween(-LOOKBACK, -1)
    return out + [
        F.sum(f"{p}d_ok").over(back).alias(f"{p}b_ok"),
        F.sum(f"{p}d_num").over(back).alias(f"{p}b_num"),
        F.sum(f"{p}d_den").over(back).alias(f"{p}b_den"),
        F.first(f"{p}d_bad", ignorenulls=True).over(back).alias(f"{p}b_bad"),
    ]


def _scale(rule: Mapping) -> int:
    """Decimals kept of a value in a z-score history."""
    return 9 if defs.metric(rule["metric_id"])["type"] == "ratio" else 2


def _judged(rule: Mapping, i: int) -> list[Column]:
    """Values, changes and skip reason of one rule."""
    p, mid = f"r{i}_", rule["metric_id"]
    cur = Result(f"{p}c_status", f"{p}c_num", f"{p}c_den", denominator=f"{p}c_denominator")
    z, moves, unfit = NULL_NUMBER, "true", "false"
    if rule["method"] == "zscore":
        # widths are chosen so that the products keep all their decimals
        n, steps = f"{p}n", []
        for name, scale in (("x", _scale(rule)), *([("y", COARSE)] if _scale(rule) > COARSE else [])):
            sx = f"TRY_CAST({p}s{name} AS DECIMAL(18,{scale}))"
            sxx = f"TRY_CAST({p}s{name}{name} AS DECIMAL(33,{2 * scale}))"
            unit = f"CAST({10**scale} AS DECIMAL(10,0))"
            fits = f"({p}n{name} = {n} AND {sx} IS NOT NULL AND {sxx} IS NOT NULL)"
            steps.append((
                fits, f"CAST(CAST({n} AS DECIMAL(4,0)) * {sxx} - {sx} * {sx} AS DOUBLE)",
                whole(f"{sx} * {unit}"), whole(f"CAST({n} AS DECIMAL(10,0)) * {unit}"),
            ))
        # the finest sums that fit
        finest = lambda k: "CASE " + " ".join(f"WHEN {t[0]} THEN {t[k]}" for t in steps) + " END"
        enough = f"({n} >= {rule['min_history_days']} AND ({' OR '.join(t[0] for t in steps)}))"
        unfit = f"({n} >= {rule['min_history_days']} AND NOT {enough})"
        spread = finest(1)
        moves = f"coalesce({spread} > 0, false)"
        base = Result(
            f"CASE WHEN {enough} THEN '{AVAILABLE}' ELSE '{NO_DATA}' END",
            f"CASE WHEN {enough} THEN {finest(2)} END",
            f"CASE WHEN {enough} THEN {finest(3)} END",
            available=enough,
        )
        delta = change_columns(mid, cur, base)["delta"]
        deviation = f"(sqrt(greatest({spread}, 0D)) / CAST({n} AS DOUBLE))"
        z = f"CASE WHEN {enough} AND {moves} THEN ({delta}) / {deviation} END"
    elif rule["comparison"] == "previous_week":
        base = Result(f"{p}b_status", f"{p}b_num", f"{p}b_den")
    else:
        base = averaged(mid, f"{p}b_ok", f"{p}b_num", f"{p}b_den", f"{p}b_bad")
    changes = change_columns(mid, cur, base)
    ready = f"coalesce({cur.ok} AND {base.ok} AND {moves}, false)"
    low = _low_volume(rule, cur.denominator, base.value)
    used = f"{ready} AND NOT ({low})"
    out = {
        "current_value": cur.value, "current_status": cur.status, "current_denominator": cur.denominator,
        "baseline_value": base.value, "baseline_status": base.status,
        **{
            name: f"CASE WHEN {used} THEN {c} END"
            for name, c in {**changes, "z_score": z}.items()
            if name != "comparison_status"
        },
        "skip_reason": f"CASE WHEN {cur.ok} AND {unfit} THEN 'out_of_range' WHEN NOT {ready} THEN 'no_data' WHEN {low} THEN 'low_volume' END",
    }
    return [F.expr(c).alias(name) for name, c in out.items()]


def _low_volume(rule: Mapping, denominator: str, baseline: str) -> str:
    low = "false"
    if rule["min_denominator"] is not None:
        low += f" OR coalesce({denominator} < {float(rule['min_denominator'])!r}D, true)"
    if rule["min_baseline_value"] is not None:
        low += f" OR coalesce(abs({baseline}) < {float(rule['min_baseline_value'])!r}D, true)"
    return low


def _severity(rule: Mapping, judged: str) -> Column:
    """First severity whose threshold is met: critical, then warning, then info."""
    out = f"CASE WHEN {judged}.skip_reason IS NOT NULL THEN NULL"
    for severity in defs.SEVERITIES:
        if severity not in rule["thresholds"]:
            continue
        measure, limit = rule["thresholds"][severity]
        seen, value = f"{judged}.{measure}", f"{float(limit)!r}D"
        met = {
            "decrease": f"{seen} <= {value}", "increase": f"{seen} >= {value}", "both": f"abs({seen}) >= {value}",
        }[rule["direction"]]
        out += f" WHEN {met} THEN '{severity}'"
    return F.expr(f"{out} END")


def evaluate_rules(df: DataFrame, start: date | str, end: date | str, *args, **kwargs) -> DataFrame:
    """One row per rule, day and member with data; arguments as for :func:`scan_rows`."""
    rows = scan_rows(df, start, end, *args, **kwargs)
    return rows.where("in_range").drop("in_range", "first_seen")


def events(evaluations: DataFrame) -> DataFrame:
    """Alerting evaluations with their evidence sentence."""
    return (
        evaluations.where("is_event")
        .withColumn("evidence", evidence_text())
        .withColumn(
            "event_id",
            F.concat_ws("|", "rule_id", F.date_format("date", "yyyy-MM-dd"),
                        F.coalesce("dimension_value", F.lit("<NULL>"))),
        )
        .drop("skip_reason", "is_event", "current_denominator")
    )


def evidence_text() -> Column:
    """One sentence per event: values, changes and z-score."""
    def shown(c: str) -> Column:
        return F.when(F.col("format") == "percentage", percent(c, 2)).otherwise(fixed(c, 2))

    subject = F.when(F.col("dimension").isNull(), "整体").otherwise(
        F.concat(F.col("dimension"), F.lit("="), F.coalesce("dimension_value", F.lit("None")))
    )
    label = (
        F.when(F.col("comparison_type") == "rolling_7d_average", "过去7日基线")
        .when(F.col("comparison_type") == "previous_week", "上周同期基线")
        .otherwise("历史均值")
    )
    return F.concat(
        F.date_format("date", "yyyy-MM-dd"), F.lit(" "), subject, F.lit("的"), F.col("metric_name"),
        F.lit("为"), shown("current_value"), F.lit("，"), label, F.lit("为"), shown("baseline_value"),
        F.coalesce(F.concat(F.lit("，相对变化"), percent("relative_change", 2, True)), F.lit("")),
        F.coalesce(
            F.concat(F.lit("，百分点变化"), fixed(F.col("percentage_point_change") * 100, 2, True), F.lit("pct")),
            F.lit(""),
        ),
        F.coalesce(F.concat(F.lit("，z-score为"), fixed("z_score", 2, True)), F.lit("")),
        F.lit("。"),
    )


def scan_summary(
    scanned: DataFrame,
    start: date | str,
    end: date | str,
    rules: Sequence[Mapping] = defs.RULES,
    rule_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Per calendar day: rules, evaluated groups, events by severity and skipped groups.

    ``scanned`` comes from :func:`scan_rows`. Every member seen in the widened range is an
    evaluated group of every day; those without data on a day are skipped groups.
    """
    chosen = defs.select_rules(rules, rule_ids)
    overall = sum(r["dimension"] is None for r in chosen)
    event = F.col("in_range") & F.col("is_event")
    hit = lambda level: F.count_if(event & (F.col("severity") == level))
    has_reason = F.col("skip_reason").isNotNull()
    per_day = scanned.groupBy("date").agg(
        hit("warning").alias("warning_count"),
        hit("critical").alias("critical_count"),
        hit("info").alias("info_count"),
        F.count_if(has_reason & (F.col("skip_reason") == "low_volume")).alias("low"),
        F.count_if(~has_reason | (F.col("skip_reason") != "no_data")).alias("with_data"),
        F.count_if(F.col("first_seen") & F.col("dimension").isNotNull()).alias("new_members"),
    )
    # one row per day: the total over all days is a window over the calendar, not over the data
    everything = Window.partitionBy(F.lit(1))
    groups = F.sum(F.coalesce("new_members", F.lit(0))).over(everything) + overall
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    days = calendar(scanned.sparkSession, start, end)
    return (
        days.join(per_day, "date", "full")
        .withColumn("groups_evaluated", groups)
        .where(F.col("date").between(F.lit(as_date(start)), F.lit(as_date(end))))
        .select(
            "date",
            F.lit(len(chosen)).alias("rules_evaluated"),
            "groups_evaluated",
            *[zero(c).alias(c) for c in ("warning_count", "critical_count", "info_count")],
            (F.col("groups_evaluated") - zero("with_data")).alias("skipped_no_data_count"),
            zero("low").alias("skipped_low_volume_count"),
        )
    )
