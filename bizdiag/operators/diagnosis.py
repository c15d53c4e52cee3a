"""Diagnosis of all events in one job: component changes, one-level drill-down, graded evidence.

Per (metric, trigger dimension) the fact is cut to the days and members of the events by a semi
join, collapsed to ``day x member x candidate dimension x value`` sums, and only then joined with
the events. Events and these sums are read by several steps, so each is written once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizdiag import definitions as defs
from bizdiag.functions.lineage import written
from bizdiag.operators.contribution import NO_CHANGE, direction_of, exact_value
from bizdiag.operators.metrics import Filters, change_columns, in_scope, result_of
from bizdiag.schema import AVAILABLE, NO_DATA, require_dimension

WHOLE = "<all>"
SHIFT = {"previous_period": 1, "previous_week": 7}

# Skip reasons.
TRIGGER = "trigger dimension excluded"
FIXED = "dimension fixed by scope filter"
NO_COMPONENT = "component current or baseline is unavailable"
UNCLASSIFIED = "candidate dimension has no classified values"


@dataclass(frozen=True)
class Diagnosis:
    """DataFrames of a diagnosis, all keyed by ``event_id``."""

    results: DataFrame
    observations: DataFrame
    findings: DataFrame
    skipped: DataFrame
    checks: DataFrame
    evidence: DataFrame


def scoped_events(
    events: DataFrame, recipes: Mapping[str, Mapping], filters: Filters | None
) -> DataFrame:
    """Events with their scope problem, if any: no recipe, NULL member, or a filter conflict."""
    wanted = {k: [v] if isinstance(v, str) else list(v) for k, v in (filters or {}).items()}
    conflict = F.lit(False)
    for field, values in wanted.items():
        require_dimension(field)
        conflict = conflict | (
            (F.col("dimension") == field) & ~F.col("dimension_value").isin(values)
        )
    no_recipe = ~F.col("metric_id").isin(list(recipes))
    null_member = F.col("dimension").isNotNull() & F.col("dimension_value").isNull()
    conflict = F.coalesce(conflict, F.lit(False))
    return events.withColumn(
        "blocked",
        F.when(no_recipe, "unsupported").when(null_member | conflict, "insufficient_data"),
    ).withColumn(
        "blocked_reason",
        F.when(no_recipe, F.concat(F.lit("No diagnostic recipe is configured for "), F.col("metric_id")))
        .when(null_member, "NULL anomaly dimension cannot be represented by the current filter API")
        .when(conflict, F.concat(F.lit("Anomaly scope conflicts with filter "), F.col("dimension"))),
    )


def _measured(
    df: DataFrame, events: DataFrame, metric_id: str, trigger: str | None, recipe: Mapping,
    candidates: Sequence[str], filters: Filters | None,
) -> tuple[DataFrame, DataFrame]:
    """(events of the pair, sums per event x candidate dimension x value for both days)."""
    mine = F.col("blocked").isNull() & (F.col("metric_id") == metric_id)
    mine = mine & (F.col("dimension").isNull() if trigger is None else F.col("dimension") == trigger)
    ev = events.where(mine).select(
        "event_id", F.col("date").alias("event_date"),
        F.coalesce("dimension_value", F.lit(WHOLE)).alias("member"),
    )
    shift = SHIFT[recipe["contribution_comparison"]]
    roles = ev.select(
        "event_id", "member",
        F.inline(
            F.array(
                F.struct(F.lit(True).alias("is_current"), F.col("event_date").alias("day")),
                F.struct(F.lit(False).alias("is_current"), F.date_sub("event_date", shift).alias("day")),
            )
        ),
    )
    fields = defs.atomic_fields((*recipe["components"], *recipe["contribution_metrics"]))
    member = F.lit(WHOLE) if trigger is None else F.col(trigger)
    fact = in_scope(df, filters=filters).select(
        F.col("date").alias("day"), member.alias("member"), *candidates, *fields
    )
    fact = fact.join(roles.select("day", "member").distinct(), ["day", "member"], "left_semi")
    cuts = [F.struct(F.lit(WHOLE).alias("dimension"), F.lit(None).cast("string").alias("value"))]
    cuts += [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in candidates]
    sums = []
    for f in fields:
        sums += [F.count(f).alias(f"n_{f}"), F.sum(f).alias(f"s_{f}")]
    cut = (
        fact.select("day", "member", *fields, F.inline(F.array(*cuts)))
        .groupBy("day", "member", "dimension", "value")
        .agg(F.count("*").alias("rows"), *sums)
    )
    both = []
    for tag, role in (("c_", F.col("is_current")), ("b_", ~F.col("is_current"))):
        both.append(F.coalesce(F.sum(F.when(role, F.col("rows"))), F.lit(0)).alias(f"{tag}rows"))
        for f in fields:
            both += [
                F.sum(F.when(role, F.col(f"n_{f}"))).alias(f"{tag}n_{f}"),
                F.sum(F.when(role, F.col(f"s_{f}"))).alias(f"{tag}s_{f}"),
            ]
    measured = (
        roles.join(cut, ["day", "member"]).groupBy("event_id", "dimension", "value").agg(*both)
    )
    return ev, measured


def _observations(
    ev: DataFrame, measured: DataFrame, recipe: Mapping, available: Iterable[str] | None
) -> DataFrame:
    whole = measured.where(F.col("dimension") == WHOLE).drop("dimension", "value")
    rows = ev.select("event_id").join(whole, "event_id", "left")
    out = []
    for i, mid in enumerate(recipe["components"], 1):
        cur, base = result_of(mid, available, "c_"), result_of(mid, available, "b_")
        changes = change_columns(mid, cur, base)
        out.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(mid).alias("metric_id"),
                F.lit(defs.metric(mid)["name"]).alias("metric_name"),
                F.lit(defs.metric(mid)["format"]).alias("format"),
                F.expr(cur.value).alias("current_value"), F.expr(base.value).alias("baseline_value"),
                F.expr(changes["delta"]).alias("delta"),
                F.expr(changes["relative_change"]).alias("relative_change"),
                F.expr(cur.status).alias("current_status"), F.expr(base.status).alias("baseline_status"),
                F.lit(recipe["contribution_comparison"]).alias("comparison_type"),
                direction_of(F.expr(changes["delta"])).alias("direction"),
            )
        )
    return rows.select("event_id", F.inline(F.array(*out)))


def _segments(
    measured: DataFrame, recipe: Mapping, available: Iterable[str] | None
) -> DataFrame:
    """Long segments: event x contribution metric x dimension (or the whole) x value."""
    zero = F.lit(0).cast("decimal(24,2)")
    out = []
    for i, mid in enumerate(recipe["contribution_metrics"], 1):
        cs, cv = exact_value(mid, available, "c_")
        bs, bv = exact_value(mid, available, "b_")
        state = lambda rows, s: F.when(F.col(rows) == 0, F.when(s.isin(AVAILABLE, NO_DATA), AVAILABLE).otherwise(s)).otherwise(s)
        out.append(
            F.struct(
                F.lit(i).alias("metric_no"), F.lit(mid).alias("metric_id"),
                state("c_rows", cs).alias("c_state"), state("b_rows", bs).alias("b_state"),
                F.when(F.col("c_rows") > 0, cv).otherwise(zero).alias("current_value"),
                F.when(F.col("b_rows") > 0, bv).otherwise(zero).alias("baseline_value"),
            )
        )
    return measured.select("event_id", "dimension", "value", F.inline(F.array(*out))).withColumn(
        "delta", (F.col("current_value") - F.col("baseline_value")).cast("decimal(24,2)")
    )


def diagnose(
    df: DataFrame,
    events: DataFrame,
    recipes: Mapping[str, Mapping] = defs.RECIPES,
    filters: Filters | None = None,
    available: Iterable[str] | None = None,
) -> Diagnosis:
    """Diagnose every event whose metric has a recipe, whatever rule found it. Runs jobs when called.

    The (metric, dimension) pairs are taken from the events: at most one for each recipe and dimension.
    """
    events = written(scoped_events(events, recipes, filters))
    seen = events.where(F.col("metric_id").isin(list(recipes))).select("metric_id", "dimension").distinct().collect()
    # without any event one pair gives the empty tables their columns
    pairs = sorted(((r[0], r[1]) for r in seen), key=lambda p: (list(recipes).index(p[0]), p[1] or "")) or [(next(iter(recipes)), None)]
    observations, findings, skipped, tops = [], [], [], []
    for mid, trigger in pairs:
        recipe = defs.checked_recipe(mid, recipes[mid])
        fixed = set(filters or {})
        open_dims = [d for d in recipe["candidate_dimensions"] if d != trigger and d not in fixed]
        ev, measured = _measured(df, events, mid, trigger, recipe, open_dims, filters)
        measured = written(measured)
        seen = _observations(ev, measured, recipe, available)
        observations.append(seen)
        for d in recipe["candidate_dimensions"]:
            if d not in open_dims:
                why = TRIGGER if d == trigger else FIXED
                skipped.append(_skip(ev, mid, d, F.lit(why)).withColumn("failed", F.lit(False)))
        if open_dims:
            attempts = _attempts(ev, seen, recipe, open_dims)
            states, top = _findings(measured, attempts, recipe, available)
            skipped.append(
                states.where(F.col("reason").isNotNull())
                .select("event_id", "metric_id", "dimension", "reason", F.lit(True).alias("failed"))
            )
            findings.append(states.where(F.col("reason").isNull()).drop("reason"))
            tops.append(top)
    empty = events.where(F.lit(False))
    observations = _union(observations, _observations_empty(empty))
    if not findings:  # every event's dimensions are fixed or its trigger: observations, and no findings
        mid = pairs[0][0]
        recipe = defs.checked_recipe(mid, recipes[mid])
        dims = recipe["candidate_dimensions"]
        ev, none = _measured(df.where(F.lit(False)), events.where(F.lit(False)), mid, None, recipe, dims, None)
        states, top = _findings(none, _attempts(ev, _observations(ev, none, recipe, available), recipe, dims), recipe, available)
        findings.append(states.drop("reason"))
        tops.append(top)
    findings, tops = _union(findings, None), _union(tops, None)
    skipped = _union(skipped, None)
    results = _results(events, observations, findings, skipped, recipes)
    checks = _checks(results, tops, recipes)
    evidence = _evidence(events, observations, findings, tops, checks)
    return Diagnosis(results, observations, _finding_rows(findings, tops), skipped.drop("failed"), checks, evidence)


def _union(parts: list[DataFrame], empty: DataFrame | None) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else empty


def _observations_empty(events: DataFrame) -> DataFrame:
    text, number = "string", "double"
    kinds = {
        "position": "int", "metric_id": text, "metric_name": text, "format": text,
        "current_value": number, "baseline_value": number, "delta": number,
        "relative_change": number, "current_status": text, "baseline_status": text,
        "comparison_type": text, "direction": text,
    }
    return events.select("event_id", *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()])


def _skip(ev: DataFrame, metric_id: str, dimension: str, reason: Column) -> DataFrame:
    return ev.select(
        "event_id", F.lit(metric_id).alias("metric_id"), F.lit(dimension).alias("dimension"),
        reason.alias("reason"),
    )


def _attempts(ev: DataFrame, seen: DataFrame, recipe: Mapping, dims: Sequence[str]) -> DataFrame:
    """Event x contribution metric x open dimension, with whether its component is available."""
    ok = (F.col("current_status") == AVAILABLE) & (F.col("baseline_status") == AVAILABLE)
    flags = seen.groupBy("event_id").agg(
        F.bool_or(ok).alias("any_ok"),
        *[
            F.bool_or(ok & (F.col("metric_id") == m)).alias(f"ok_{m}")
            for m in recipe["components"]
        ],
    )
    tries = []
    for i, m in enumerate(recipe["contribution_metrics"], 1):
        usable = F.col("any_ok")
        if m in recipe["components"]:
            usable = usable & F.col(f"ok_{m}")
        for j, d in enumerate(dims, 1):
            tries.append(
                F.struct(
                    F.lit(m).alias("metric_id"), F.lit(d).alias("dimension"),
                    F.lit(i * 100 + j).alias("finding_no"), usable.alias("usable"),
                )
            )
    return flags.select("event_id", F.inline(F.array(*tries)))


def _findings(
    measured: DataFrame, attempts: DataFrame, recipe: Mapping, available: Iterable[str] | None
) -> tuple[DataFrame, DataFrame]:
    """(state per attempt, top rows per kind) of all drill-downs of one pair."""
    segments = _segments(measured, recipe, available)
    key = ["event_id", "metric_id", "dimension"]
    cuts = segments.where(F.col("dimension") != WHOLE)
    per = cuts.groupBy(*key).agg(
        F.bool_or((F.col("c_state") != AVAILABLE) | (F.col("b_state") != AVAILABLE)).alias("bad"),
        F.bool_and(F.col("value").isNull()).alias("unnamed"),
        F.sum(F.abs("delta")).alias("moved"),
        F.sum("delta").alias("segment_delta"),
    )
    whole = segments.where(F.col("dimension") == WHOLE).select(
        "event_id", "metric_id", "c_state", "b_state", F.col("delta").alias("overall_delta")
    )
    tolerance = F.when(
        F.col("metric_id").isin([m for m in recipe["contribution_metrics"] if defs.metric(m)["format"] == "currency"]),
        F.lit(0.01),
    ).otherwise(F.lit(0.0))
    zero = F.lit(0).cast("decimal(24,2)")
    status = F.when(
        (F.coalesce("overall_delta", zero) == 0) & (F.coalesce("moved", zero) == 0), NO_CHANGE
    ).otherwise(AVAILABLE)
    states = (
        attempts.join(per, key, "left")
        .join(whole, ["event_id", "metric_id"], "left")
        .select(
            *key, "finding_no",
            F.coalesce("overall_delta", zero).alias("overall_delta"),
            status.alias("reconciliation_status"),
            F.lit(recipe["contribution_comparison"]).alias("comparison_type"),
            F.when(~F.col("usable"), NO_COMPONENT)
            .when(F.col("c_state") != AVAILABLE,
                  F.concat(F.lit("current metric is unavailable: "), F.col("c_state")))
            .when(F.col("b_state") != AVAILABLE,
                  F.concat(F.lit("baseline metric is unavailable: "), F.col("b_state")))
            .when(F.col("bad"), "a segment is unavailable")
            .when(F.abs(F.col("segment_delta") - F.col("overall_delta")) > tolerance,
                  "Segment sums do not reconcile to overall values")
            .when(F.col("unnamed"), UNCLASSIFIED)
            .alias("reason"),
        )
    )
    group = Window.partitionBy(*key)
    size, name = F.abs("delta").desc(), F.col("value").asc_nulls_last()
    kinds = (("movement", F.lit(True)), ("increase", F.col("delta") > 0), ("decrease", F.col("delta") < 0))
    best = []
    for kind, cond in kinds:
        ranked = cuts.where(cond).withColumn("position", F.row_number().over(group.orderBy(size, name)))
        best.append(ranked.where(F.col("position") <= recipe["top_n"]).withColumn("kind", F.lit(kind)))
    good = states.where(F.col("reason").isNull()).select(*key, "finding_no")
    top = reduce(DataFrame.unionByName, best).join(good, key).select(
        *key, "finding_no", "kind", "position", F.col("value").alias("dimension_value"),
        "current_value", "baseline_value", "delta",
    )
    return states, top


def _finding_rows(findings: DataFrame, tops: DataFrame) -> DataFrame:
    key = ["event_id", "metric_id", "dimension", "finding_no"]
    return findings.join(tops, key, "left").drop("finding_no")


def _results(
    events: DataFrame, observations: DataFrame, findings: DataFrame, skipped: DataFrame,
    recipes: Mapping[str, Mapping],
) -> DataFrame:
    ok = (F.col("current_status") == AVAILABLE) & (F.col("baseline_status") == AVAILABLE)
    obs = observations.groupBy("event_id").agg(
        F.count("*").alias("n_obs"), F.count_if(ok).alias("n_ok")
    )
    found = findings.groupBy("event_id").agg(F.count("*").alias("n_findings"))
    missed = skipped.groupBy("event_id").agg(
        F.bool_or("failed").alias("failed"), F.count("*").alias("n_skipped")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    failed = F.coalesce("failed", F.lit(False))
    status = (
        F.when(F.col("blocked").isNotNull(), F.col("blocked"))
        .when((zero("n_ok") == 0) & (zero("n_findings") == 0), "insufficient_data")
        .when((zero("n_ok") != zero("n_obs")) | failed | (zero("n_findings") == 0), "partial")
        .otherwise("complete")
    )
    comparison = F.lit(None).cast("string")
    for mid, recipe in recipes.items():
        comparison = F.when(F.col("metric_id") == mid, recipe["contribution_comparison"]).otherwise(comparison)
    return (
        events.join(obs, "event_id", "left").join(found, "event_id", "left").join(missed, "event_id", "left")
        .withColumn("status", status)
        .select(
            "event_id", "rule_id", "metric_id", "date", "dimension", "dimension_value", "severity",
            "status",
            F.col("comparison_type").alias("anomaly_comparison_type"),
            comparison.alias("diagnostic_comparison_type"),
            zero("n_ok").alias("available_observations"),
            zero("n_findings").alias("finding_count"),
            zero("n_skipped").alias("skipped_count"),
            F.when(F.col("blocked").isNotNull(), F.col("blocked_reason"))
            .when(F.col("status") == "partial", "Some configured observations or drilldowns were unavailable")
            .when(F.col("status") == "insufficient_data", "No component observation or drilldown had sufficient data")
            .alias("reason"),
        )
    )


def _checks(results: DataFrame, tops: DataFrame, recipes: Mapping[str, Mapping]) -> DataFrame:
    """Suggested checks of the recipe, then one per first finding (three at most)."""
    suggested = F.lit(None).cast("array<string>")
    for mid, recipe in recipes.items():
        listed = F.array(*[F.lit(t) for t in recipe["suggested_checks"]])
        suggested = F.when(F.col("metric_id") == mid, listed).otherwise(suggested)
    open_event = ~F.col("status").isin("unsupported") & F.coalesce(
        ~F.col("reason").startswith("NULL anomaly") & ~F.col("reason").startswith("Anomaly scope"),
        F.lit(True),
    )
    fixed = results.where(open_event).select("event_id", F.posexplode(suggested).alias("position", "text"))
    first = tops.where("kind = 'movement' and position = 1")
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy("finding_no"))
    derived = (
        first.withColumn("nth", nth)
        .where(F.col("nth") <= 3)
        .select(
            "event_id", (F.col("nth") + 1000).alias("position"),
            F.concat(
                F.lit("优先核对 "), F.col("dimension"), F.lit("="),
                F.coalesce("dimension_value", F.lit("None")),
                F.lit(" 的 "), F.col("metric_id"), F.lit(" 数据记录与口径变化"),
            ).alias("text"),
        )
    )
    return fixed.unionByName(derived)


def _amount(value: Column) -> Column:
    """Whole numbers without decimals, other values with two."""
    v = value.cast("decimal(24,2)")
    return F.when(F.col("format") == "integer", v.cast("decimal(22,0)").cast("string")).otherwise(
        v.cast("string")
    )


def _evidence(events, observations, findings, tops, checks) -> DataFrame:
    """FACT, DIAGNOSTIC and RECOMMENDATION rows in order."""
    fact0 = events.select(
        "event_id", F.lit(0).alias("position"), F.lit("FACT").alias("kind"),
        F.concat(F.lit("异常事件记录："), F.col("evidence")).alias("message"),
    )
    seen = observations.select(
        "event_id", F.col("position").alias("position"), F.lit("FACT").alias("kind"),
        F.when(
            F.col("delta").isNull(),
            F.concat(F.col("metric_name"), F.lit("在诊断基准"), F.col("comparison_type"), F.lit("下不可用。")),
        )
        .otherwise(
            F.concat(
                F.lit("诊断基准"), F.col("comparison_type"), F.lit("下，"), F.col("metric_name"),
                F.lit("当前值为"), _amount(F.col("current_value")),
                F.lit("，基线值为"), _amount(F.col("baseline_value")),
                F.lit("，变化量为"), _amount(F.col("delta")), F.lit("。"),
            )
        )
        .alias("message"),
    )
    drill = _movers(findings, tops).select(
        "event_id", (F.col("finding_no") + 10000).alias("position"), F.lit("DIAGNOSTIC").alias("kind"),
        F.concat(
            F.lit("按"), F.col("dimension"), F.lit("观察"), F.col("metric_id"),
            F.lit("，变化幅度较大的分组包括"), F.col("movers"), F.lit("。"),
        ).alias("message"),
    )
    advice = checks.select(
        "event_id", (F.col("position") + 100000).alias("position"),
        F.lit("RECOMMENDATION").alias("kind"), F.col("text").alias("message"),
    )
    return fact0.unionByName(seen).unionByName(drill).unionByName(advice)


def _movers(findings: DataFrame, tops: DataFrame) -> DataFrame:
    """Names of the top movements of a finding in one text (at most top_n names)."""
    names = tops.where("kind = 'movement'").groupBy("event_id", "finding_no").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", F.coalesce("dimension_value", F.lit("None")).alias("v")))),
                lambda s: s["v"],
            ),
            "、",
        ).alias("movers")
    )
    return findings.join(names, ["event_id", "finding_no"], "left").withColumn(
        "movers", F.coalesce("movers", F.lit("无"))
    )


def event_text(d: Diagnosis) -> DataFrame:
    """One multi-line summary per event; the number of lines is bounded by the recipe."""
    head = d.results.select(
        "event_id",
        F.inline(
            F.array(
                _line(0, F.concat(F.lit("诊断状态："), F.col("status"))),
                _line(1, F.concat(F.lit("异常基准："), F.col("anomaly_comparison_type"))),
                _line(2, F.concat(F.lit("诊断基准："), F.coalesce("diagnostic_comparison_type", F.lit("未配置")))),
                _line(3, F.lit("组成观察：")),
                _line(20000, F.lit("单层观察：")),
                _line(40000, F.lit("建议检查：")),
                _line(900000, F.lit(f"限制：{defs.DIAGNOSIS_LIMITATION}")),
            )
        ),
    )
    seen = d.observations.select(
        "event_id", (F.col("position") + 10000).alias("ord"),
        F.concat(
            F.lit("- "), F.col("metric_name"),
            F.when(
                F.col("delta").isNull(),
                F.concat(F.lit("：不可用（current="), F.col("current_status"), F.lit(", baseline="),
                         F.col("baseline_status"), F.lit("）")),
            ).otherwise(
                F.concat(F.lit("：current="), _amount(F.col("current_value")), F.lit("，baseline="),
                         _amount(F.col("baseline_value")), F.lit("，delta="), _amount(F.col("delta")))
            ),
        ).alias("line"),
    )
    drill = d.evidence.where("kind = 'DIAGNOSTIC'").select(
        "event_id", (F.col("position") + 11000).alias("ord"),
        F.concat(
            F.lit("- "), F.regexp_extract("message", "观察(.*?)，", 1), F.lit(" 按 "),
            F.regexp_extract("message", "^按(.*?)观察", 1), F.lit("：变化幅度较大的分组为 "),
            F.regexp_extract("message", "分组包括(.*)。$", 1),
        ).alias("line"),
    )
    advice = d.checks.select(
        "event_id", (F.col("position") + 40001).alias("ord"),
        F.concat(F.lit("- "), F.col("text")).alias("line"),
    )
    lines = head.unionByName(seen).unionByName(drill).unionByName(advice)
    return lines.groupBy("event_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda s: s["line"]),
            "\n",
        ).alias("summary")
    )


def _line(ord_: int, text: Column) -> Column:
    return F.struct(F.lit(ord_).alias("ord"), text.alias("line"))
