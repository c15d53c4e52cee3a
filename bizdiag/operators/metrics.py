"""Metrics over the daily fact: statuses, ratios rebuilt from sums, comparisons, funnel.

Every metric is a fraction of two exact whole numbers (hundredths). Values and changes come from
whole-number products and one final division, so a threshold met exactly is met here too.

Derived expressions are composed as SQL text and handed to Spark with ``expr``: one call per
column instead of one per operator.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizdiag import definitions as defs
from bizdiag.schema import (
    AVAILABLE, COLUMNS, DEPENDENCY, DIMENSIONS, MISSING_FIELD, NO_DATA,
    UNAVAILABLE_BASELINE, UNAVAILABLE_CURRENT, ZERO_DENOMINATOR, require_dimension,
)

Filters = Mapping[str, str | Sequence[str]]
COMPARISONS = ("previous_period", "previous_week", "rolling_7d_average")


# ------------------------------------------------------------------ scope
def as_date(value: date | str) -> date:
    """Date from a date or an ISO text."""
    return date.fromisoformat(value) if isinstance(value, str) else value


def in_scope(
    df: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    filters: Filters | None = None,
) -> DataFrame:
    """Rows of an inclusive date range whose dimensions match all filters; NULL never matches."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(as_date(start)))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(as_date(end)))
    for field, wanted in (filters or {}).items():
        require_dimension(field)
        values = [wanted] if isinstance(wanted, str) else list(wanted)
        if not values or not all(isinstance(v, str) for v in values):
            raise ValueError(f"filter {field} needs one or more texts")
        df = df.where(F.col(field).isin(values))
    return df


# ------------------------------------------------------------------ aggregates and results
def sums(fields: Iterable[str], when: Column | None = None, tag: str = "") -> list[Column]:
    """Per field: non-NULL count and exact sum; with a condition, of the rows meeting it."""
    aggs = []
    for f in fields:
        c = F.col(f) if when is None else F.when(when, F.col(f))
        aggs += [F.count(c).alias(f"{tag}n_{f}"), F.sum(c).alias(f"{tag}s_{f}")]
    return aggs


NULL_NUMBER, NULL_TEXT = "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)"
ONE = "CAST(100 AS DECIMAL(38,0))"  # the number one in hundredths


@dataclass(frozen=True)
class Result:
    """SQL text of one metric result over aggregated rows."""

    status: str
    num: str  # whole hundredths; value = num / den
    den: str
    numerator: str = NULL_NUMBER  # the parts as they are reported
    denominator: str = NULL_NUMBER
    reason: str = NULL_TEXT
    available: str = ""

    @property
    def ok(self) -> str:
        return f"({self.available or f"{self.status} = '{AVAILABLE}'"})"

    @property
    def value(self) -> str:
        return f"CASE WHEN {self.ok} THEN {quotient(self.num, self.den)} END"


def text(value: str) -> str:
    """SQL text literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hundredths(c: str) -> str:
    """Exact whole number of hundredths."""
    return f"CAST(CAST({c} AS DECIMAL(22,2)) * CAST(100 AS DECIMAL(3,0)) AS DECIMAL(38,0))"


def whole(c: str) -> str:
    """Whole number of any size."""
    return f"CAST({c} AS DECIMAL(38,0))"


def quotient(num: str, den: str) -> str:
    """One double division; NULL when the divisor is 0."""
    return f"(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0D))"


def result_of(metric_id: str, available: Iterable[str] | None = None, tag: str = "") -> Result:
    """Result of a metric over the aggregates made by :func:`sums`.

    ``available`` lists the mapped fields (all when not given).
    """
    mapped = set(COLUMNS if available is None else available)
    d = defs.metric(metric_id)
    if d["type"] == "atomic":
        f = d["field"]
        if f not in mapped:
            return Result(
                text(MISSING_FIELD), "CAST(NULL AS DECIMAL(38,0))", ONE, available="false",
                reason=text(f"{f} is unavailable in current dataset"),
            )
        has = f"coalesce({tag}n_{f}, 0) > 0"
        return Result(
            f"CASE WHEN {has} THEN '{AVAILABLE}' ELSE '{NO_DATA}' END",
            f"CASE WHEN {has} THEN {hundredths(f'{tag}s_{f}')} END", ONE, available=has,
            reason=f"CASE WHEN NOT ({has}) THEN {text(f'{f} has no data for the current selection')} END",
        )
    a_id, b_id = d["parts"]
    a, b = result_of(a_id, mapped, tag), result_of(b_id, mapped, tag)
    ratio = d["type"] == "ratio"
    status, reason = "CASE", "CASE"
    for pid, part in ((a_id, a), (b_id, b)):  # the first part is checked first
        passed = part.status if defs.metric(pid)["type"] == "atomic" else text(DEPENDENCY)
        status += f" WHEN NOT {part.ok} THEN {passed}"
        reason += f" WHEN NOT {part.ok} THEN concat({text(f'Dependency {pid} is unavailable: ')}, {part.status})"
    ok = f"{a.ok} AND {b.ok}"
    if ratio:
        status += f" WHEN {b.num} = 0 THEN '{ZERO_DENOMINATOR}'"
        reason += f" WHEN {b.num} = 0 THEN {text(f'{b_id} aggregates to zero')}"
    # a part is a plain sum or difference, so its own denominator is one
    num, den = (a.num, b.num) if ratio else (whole(f"{a.num} - {b.num}"), ONE)
    return Result(
        f"{status} ELSE '{AVAILABLE}' END",
        f"CASE WHEN {ok} THEN {num} END", f"CASE WHEN {ok} THEN {den} END",
        f"CASE WHEN {ok} THEN {quotient(a.num, ONE)} END", f"CASE WHEN {ok} THEN {quotient(b.num, ONE)} END",
        f"{reason} END",
        f"{ok} AND {b.num} <> 0" if ratio else ok,
    )


def _row(**fields: str) -> str:
    """SQL struct of named texts."""
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


def _result_struct(metric_id: str, available: Iterable[str] | None) -> str:
    r, d = result_of(metric_id, available), defs.metric(metric_id)
    return _row(
        metric_id=text(metric_id), name=text(d["name"]), format=text(d["format"]), status=r.status, value=r.value,
        numerator_value=r.numerator, denominator_value=r.denominator, reason=r.reason,
    )


def metrics_by(
    df: DataFrame,
    metric_ids: Sequence[str],
    keys: Sequence[str],
    available: Iterable[str] | None = None,
    *,
    start: date | str | None = None,
    end: date | str | None = None,
    filters: Filters | None = None,
) -> DataFrame:
    """One row per group and metric, from one aggregate. NULL members are groups of their own.

    Legal groupings: none, one dimension, ``date``, or ``date`` and one dimension.
    """
    if tuple(keys) not in [(), ("date",), *[(d,) for d in DIMENSIONS], *[("date", d) for d in DIMENSIONS]]:
        raise ValueError(f"illegal grouping: {tuple(keys)}")
    fields = defs.atomic_fields(metric_ids)
    grouped = in_scope(df, start, end, filters).groupBy(*keys).agg(*sums(fields))
    rows = ", ".join(_result_struct(m, available) for m in metric_ids)
    return grouped.select(*keys, F.expr(f"inline(array({rows}))"))


def metrics(
    df: DataFrame, metric_ids: Sequence[str], available: Iterable[str] | None = None, **scope
) -> DataFrame:
    """Overall metric results in long form; one scan for all of them."""
    return metrics_by(df, metric_ids, (), available, **scope)


# ------------------------------------------------------------------ comparisons
def comparison_period(
    start: date | str, end: date | str, comparison: str
) -> tuple[date, date, date, date]:
    """Current and baseline bounds of a comparison."""
    first, last = as_date(start), as_date(end)
    if first > last:
        raise ValueError("start is after end")
    if comparison == "previous_period":
        shift = (last - first).days + 1
        return first, last, first - timedelta(days=shift), first - timedelta(days=1)
    if comparison == "previous_week":
        return first, last, first - timedelta(days=7), last - timedelta(days=7)
    if comparison == "rolling_7d_average":
        if first != last:
            raise ValueError("rolling_7d_average compares a single day")
        return first, last, first - timedelta(days=7), first - timedelta(days=1)
    raise ValueError(f"unsupported comparison: {comparison}")


def change_columns(metric_id: str, cur: Result, base: Result) -> dict[str, str]:
    """SQL text of delta, relative and percentage-point change with their status."""
    status = (
        f"CASE WHEN NOT {cur.ok} THEN '{UNAVAILABLE_CURRENT}' WHEN NOT {base.ok} THEN '{UNAVAILABLE_BASELINE}' "
        f"ELSE '{AVAILABLE}' END"
    )
    both = f"{cur.ok} AND {base.ok}"
    # cn/cd - bn/bd over one denominator
    moved = whole(f"({cur.num}) * ({base.den}) - ({base.num}) * ({cur.den})")
    delta = f"CASE WHEN {both} THEN {quotient(moved, whole(f'({cur.den}) * ({base.den})'))} END"
    relative = f"CASE WHEN {both} THEN {quotient(moved, whole(f'({cur.den}) * ({base.num})'))} END"
    percentage = defs.metric(metric_id)["format"] == "percentage"
    return {
        "delta": delta,
        "relative_change": relative,
        "percentage_point_change": delta if percentage else NULL_NUMBER,
        "comparison_status": status,
    }


def daily_parts(metric_id: str, available: Iterable[str] | None = None, tag: str = "") -> dict[str, str]:
    """What a seven-day average needs of one day: flags and exact parts."""
    r = result_of(metric_id, available, tag)
    ratio = defs.metric(metric_id)["type"] == "ratio"
    # the parts of a ratio are there on available and on zero-denominator days
    den = r.den if ratio else f"CASE WHEN {r.ok} THEN CAST(1 AS DECIMAL(38,0)) END"
    return {
        "ok": f"CAST({r.ok} AS INT)",
        "num": r.num,
        "den": den,
        "bad": f"nullif(nullif({r.status}, '{AVAILABLE}'), '{NO_DATA}')",
    }


def averaged(metric_id: str, n_ok: str, num: str, den: str, first_bad: str) -> Result:
    """Average of daily results: summed parts for a ratio, else the mean of available days."""
    has = f"coalesce({n_ok}, 0) > 0"
    none = f"coalesce({first_bad}, '{NO_DATA}')"
    gap = f"WHEN NOT ({has}) AND {first_bad} IS NULL THEN 'No data exists for this calendar date'"
    if defs.metric(metric_id)["type"] == "ratio":
        return Result(
            f"CASE WHEN NOT ({has}) THEN {none} WHEN {den} = 0 THEN '{ZERO_DENOMINATOR}' ELSE '{AVAILABLE}' END",
            f"CASE WHEN {has} THEN {whole(num)} END", f"CASE WHEN {has} THEN {whole(den)} END",
            f"CASE WHEN {has} THEN {quotient(num, ONE)} END", f"CASE WHEN {has} THEN {quotient(den, ONE)} END",
            f"CASE {gap} WHEN {has} AND {den} = 0 THEN 'Rolling denominator aggregates to zero' END",
            f"{has} AND {den} <> 0",
        )
    return Result(
        f"CASE WHEN {has} THEN '{AVAILABLE}' ELSE {none} END",
        f"CASE WHEN {has} THEN {whole(num)} END",
        f"CASE WHEN {has} THEN {whole(f'{den} * 100')} END",  # den counts days; in hundredths
        reason=f"CASE WHEN {has} THEN concat('Average of ', {n_ok}, ' available daily value(s)') {gap} END",
        available=has,
    )


def compare(
    df: DataFrame,
    metric_id: str,
    start: date | str,
    end: date | str,
    comparison: str = "previous_period",
    keys: Sequence[str] = (),
    available: Iterable[str] | None = None,
    filters: Filters | None = None,
) -> DataFrame:
    """Current period against a baseline, overall or per member, in one pass over both ranges."""
    c0, c1, b0, b1 = comparison_period(start, end, comparison)
    fields = defs.atomic_fields([metric_id])
    rows = in_scope(df, min(b0, c0), max(b1, c1), filters)
    current = F.col("date").between(F.lit(c0), F.lit(c1))
    before = F.col("date").between(F.lit(b0), F.lit(b1))
    rows = rows.where(current | before)
    if comparison == "rolling_7d_average":
        daily = rows.groupBy("date", *keys).agg(*sums(fields))
        parts = daily_parts(metric_id, available)
        daily = daily.select(
            "*", *[F.expr(c).alias(f"d_{name}") for name, c in parts.items()]
        )
        agg = daily.groupBy(*keys).agg(
            *[
                F.max(F.when(current, F.col(f"{p}_{f}"))).alias(f"c_{p}_{f}")
                for f in fields
                for p in ("n", "s")
            ],
            F.sum(F.when(before, F.col("d_ok"))).alias("b_ok"),
            F.sum(F.when(before, F.col("d_num"))).alias("b_num"),
            F.sum(F.when(before, F.col("d_den"))).alias("b_den"),
            F.min_by("d_bad", F.when(before & F.col("d_bad").isNotNull(), F.col("date"))).alias("b_bad"),
        )
        base = averaged(metric_id, "b_ok", "b_num", "b_den", "b_bad")
    else:
        agg = rows.groupBy(*keys).agg(*sums(fields, current, "c_"), *sums(fields, before, "b_"))
        base = result_of(metric_id, available, "b_")
    cur = result_of(metric_id, available, "c_")
    changes = change_columns(metric_id, cur, base)
    return agg.select(
        *keys,
        F.lit(metric_id).alias("metric_id"),
        F.lit(comparison).alias("comparison_type"),
        F.lit(c0).alias("current_start"), F.lit(c1).alias("current_end"),
        F.lit(b0).alias("baseline_start"), F.lit(b1).alias("baseline_end"),
        F.expr(cur.value).alias("current_value"), F.expr(cur.status).alias("current_status"),
        F.expr(base.value).alias("baseline_value"), F.expr(base.status).alias("baseline_status"),
        *[F.expr(c).alias(name) for name, c in changes.items()],
    )


# ------------------------------------------------------------------ funnel
def funnel(
    df: DataFrame,
    definition: Mapping | None = None,
    available: Iterable[str] | None = None,
    **scope,
) -> DataFrame:
    """Stages, step rates and outcomes of a funnel as rows, from one scan."""
    d = defs.FUNNELS["business_funnel"] if definition is None else definition
    defs.check_funnel(d)
    wanted = dict.fromkeys((*d["stages"], *[m for s in d["step_rates"] for m in s], *d["outcomes"]))
    grouped = in_scope(df, **scope).groupBy().agg(*sums(defs.atomic_fields(wanted)))
    rows = []
    for section in ("stages", "outcomes"):
        for i, mid in enumerate(d[section], 1):
            r = result_of(mid, available)
            rows.append(
                _row(
                    section=text(section), position=str(i), metric_id=text(mid), from_stage=NULL_TEXT, value=r.value,
                    status=r.status, numerator_value=r.numerator, denominator_value=r.denominator, reason=r.reason,
                )
            )
    for i, (top, bottom) in enumerate(d["step_rates"], 1):
        a, b = result_of(top, available), result_of(bottom, available)
        failed = f"WHEN NOT {a.ok} THEN {{}} WHEN NOT {b.ok} THEN {{}} WHEN {b.num} = 0 THEN {{}}"
        status = f"CASE {failed.format(a.status, b.status, text(ZERO_DENOMINATOR))} ELSE '{AVAILABLE}' END"
        why = (f"Dependency {top} is unavailable", f"Dependency {bottom} is unavailable", f"{bottom} aggregates to zero")
        # value = (an/ad) / (bn/bd)
        value = quotient(whole(f"({a.num}) * ({b.den})"), whole(f"({a.den}) * ({b.num})"))
        both = f"{a.ok} AND {b.ok}"
        rows.append(
            _row(
                section="'step_rates'", position=str(i), metric_id=text(top), from_stage=text(bottom),
                value=f"CASE WHEN {both} AND {b.num} <> 0 THEN {value} END", status=status,
                numerator_value=f"CASE WHEN {both} THEN {quotient(a.num, a.den)} END",
                denominator_value=f"CASE WHEN {both} THEN {quotient(b.num, b.den)} END",
                reason=f"CASE {failed.format(*map(text, why))} END",
            )
        )
    return grouped.select(F.expr(f"inline(array({', '.join(rows)}))"))
