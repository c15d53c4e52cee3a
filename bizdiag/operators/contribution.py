"""Which members carry an additive change between two periods, reconciled to the total."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizdiag import definitions as defs
from bizdiag.functions.lineage import written
from bizdiag.functions.ordering import with_order_number
from bizdiag.operators.metrics import Filters, comparison_period, in_scope, result_of, sums
from bizdiag.schema import AVAILABLE, NO_DATA, require_dimension

NO_CHANGE = "available_no_change"
UNAVAILABLE = "unavailable"
FAILED = "reconciliation_failed"


class UnsupportedMetric(ValueError):
    """The metric is not additive."""


class UnsupportedComparison(ValueError):
    """The comparison has no additive meaning."""


def exact_value(metric_id: str, available: Iterable[str] | None, tag: str) -> tuple[Column, Column]:
    """(status, exact decimal value) of an additive metric over tagged sums."""
    r = result_of(metric_id, available, tag)
    return F.expr(r.status), F.expr(f"CAST({r.num} / CAST(100 AS DECIMAL(3,0)) AS DECIMAL(24,2))")


def direction_of(delta: Column) -> Column:
    """increase, decrease or unchanged; NULL stays NULL."""
    return F.when(delta > 0, "increase").when(delta < 0, "decrease").when(delta == 0, "unchanged")


def contribution(
    df: DataFrame,
    metric_id: str,
    start: date | str,
    end: date | str,
    dimension: str,
    comparison: str = "previous_period",
    available: Iterable[str] | None = None,
    filters: Filters | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(segments, header). One scan of both periods; a member absent on one side counts as 0."""
    if not defs.is_additive(metric_id):
        raise UnsupportedMetric(f"{metric_id} is not additive")
    if comparison not in ("previous_period", "previous_week"):
        raise UnsupportedComparison(comparison)
    require_dimension(dimension)
    c0, c1, b0, b1 = comparison_period(start, end, comparison)
    current = F.col("date").between(F.lit(c0), F.lit(c1))
    before = F.col("date").between(F.lit(b0), F.lit(b1))
    fields = defs.atomic_fields([metric_id])
    rows = in_scope(df, b0, c1, filters).where(current | before)

    def aggregates():
        return [
            F.count_if(current).alias("c_rows"), F.count_if(before).alias("b_rows"),
            *sums(fields, current, "c_"), *sums(fields, before, "b_"),
        ]

    cs, cv = exact_value(metric_id, available, "c_")
    bs, bv = exact_value(metric_id, available, "b_")
    zero = F.lit(0).cast("decimal(24,2)")
    # the members and the total of each, in one scan; all that follows reads this small table
    raw = [F.grouping(dimension).alias("_total"), *aggregates()]
    sides = written(rows.groupingSets([[dimension], []], dimension).agg(*raw))
    members = sides.where("_total = 0").select(
        F.col(dimension).alias("dimension_value"),
        (((F.col("c_rows") > 0) & (cs != AVAILABLE)) | ((F.col("b_rows") > 0) & (bs != AVAILABLE))).alias("bad"),
        F.when(F.col("c_rows") > 0, cv).otherwise(zero).alias("current_value"),
        F.when(F.col("b_rows") > 0, bv).otherwise(zero).alias("baseline_value"),
    ).withColumn("delta", (F.col("current_value") - F.col("baseline_value")).cast("decimal(24,2)"))
    # without any row there is no total either; the maximum of the one row there is keeps the types
    one = [c for c in sides.columns if c not in (dimension, "_total")]
    overall = sides.where("_total = 1").groupBy().agg(*[F.max(c).alias(c) for c in one])
    overall = overall.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("c_rows", "b_rows")}).select(
        _side(cs, "c_rows").alias("current_state"), _side(bs, "b_rows").alias("baseline_state"),
        F.when(F.col("c_rows") > 0, cv).otherwise(zero).alias("overall_current"),
        F.when(F.col("b_rows") > 0, bv).otherwise(zero).alias("overall_baseline"),
    )
    header = _header(members, overall, metric_id, dimension, comparison, (c0, c1, b0, b1))

    # ranked before shares are known, so that the sort does not wait for the header
    ranked = with_order_number(
        members.withColumn("_size", F.abs("delta")), [], "_size", "dimension_value", "rank_by_absolute_change"
    )
    total = header.select(F.struct("status", "overall_delta", "movement_total")).scalar()
    segments = ranked.withColumn("_h", total).where(F.col("_h.status") != UNAVAILABLE)
    segments = segments.select(
        F.lit(dimension).alias("dimension"), "dimension_value", "current_value", "baseline_value",
        "delta",
        share(F.col("delta"), F.col("_h.overall_delta")).alias("net_change_share"),
        share(F.abs("delta"), F.col("_h.movement_total")).alias("movement_share"),
        direction_of(F.col("delta")).alias("direction"), "rank_by_absolute_change",
    )
    return segments, header.drop("movement_total")


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; NULL when the whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def _side(status: Column, rows: str) -> Column:
    """State of one side: an empty side counts as zero and is fine."""
    return F.when((F.col(rows) == 0) & (status == NO_DATA), AVAILABLE).otherwise(status)


def _header(members, overall, metric_id, dimension, comparison, bounds) -> DataFrame:
    tolerance = 0.01 if defs.metric(metric_id)["format"] == "currency" else 0.0
    summed = members.groupBy().agg(
        F.struct(
            F.coalesce(F.bool_or("bad"), F.lit(False)).alias("bad"),
            F.coalesce(F.sum("current_value"), F.lit(0)).alias("cur"),
            F.coalesce(F.sum("baseline_value"), F.lit(0)).alias("base"),
            F.coalesce(F.sum(F.abs("delta")), F.lit(0)).alias("moved"),
        )
    ).scalar()
    h = overall.withColumn("_m", summed).withColumn(
        "overall_delta", F.col("overall_current") - F.col("overall_baseline")
    )
    gaps = {
        "current_reconciliation_difference": F.col("_m.cur") - F.col("overall_current"),
        "baseline_reconciliation_difference": F.col("_m.base") - F.col("overall_baseline"),
        "reconciliation_difference": F.col("_m.cur") - F.col("_m.base") - F.col("overall_delta"),
    }
    apart = F.lit(False)
    for gap in gaps.values():
        apart = apart | (F.abs(gap) > tolerance)
    blocked = (
        F.col("_m.bad") | (F.col("current_state") != AVAILABLE) | (F.col("baseline_state") != AVAILABLE)
    )
    status = (
        F.when(blocked, UNAVAILABLE)
        .when(apart, FAILED)
        .when((F.col("overall_delta") == 0) & (F.col("_m.moved") == 0), NO_CHANGE)
        .otherwise(AVAILABLE)
    )
    reason = (
        F.when(F.col("current_state") != AVAILABLE,
               F.concat(F.lit("current metric is unavailable: "), F.col("current_state")))
        .when(F.col("baseline_state") != AVAILABLE,
              F.concat(F.lit("baseline metric is unavailable: "), F.col("baseline_state")))
        .when(F.col("_m.bad"), "a segment is unavailable")
        .when(apart, "Segment sums do not reconcile to overall values")
    )
    shown = lambda c: F.when(~blocked, c)
    c0, c1, b0, b1 = bounds
    return h.select(
        F.lit(metric_id).alias("metric_id"), F.lit(dimension).alias("dimension"),
        F.lit(comparison).alias("comparison_type"),
        F.lit(c0).alias("current_start"), F.lit(c1).alias("current_end"),
        F.lit(b0).alias("baseline_start"), F.lit(b1).alias("baseline_end"),
        *[shown(F.col(c)).alias(c) for c in ("overall_current", "overall_baseline", "overall_delta")],
        (~blocked & (F.col("overall_delta") != 0)).alias("net_change_share_available"),
        *[shown(c).alias(name) for name, c in gaps.items()],
        status.alias("status"), reason.alias("reason"),
        F.col("_m.moved").alias("movement_total"),
    )


def top(segments: DataFrame, kind: str, n: int) -> DataFrame:
    """First n segments of one kind: increases, decreases or movements."""
    if n < 1:
        raise ValueError("n must be at least 1")
    by_rank = F.col("rank_by_absolute_change").asc()
    if kind == "increases":
        return segments.where("direction = 'increase'").orderBy(by_rank).limit(n)
    if kind == "decreases":
        return segments.where("direction = 'decrease'").orderBy(by_rank).limit(n)
    if kind == "movements":
        return segments.orderBy(by_rank).limit(n)
    raise ValueError(f"unknown kind: {kind}")
