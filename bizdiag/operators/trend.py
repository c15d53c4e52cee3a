"""Daily series with explicit gaps, and trailing seven-day averages."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizdiag import definitions as defs
from bizdiag.operators.metrics import (
    Filters, Result, as_date, averaged, daily_parts, in_scope, result_of, sums, text,
)
from bizdiag.schema import NO_DATA, require_dimension

DAYS = 7


def calendar(spark, start: date | str, end: date | str) -> DataFrame:
    """One row per calendar day of an inclusive range."""
    first, last = as_date(start), as_date(end)
    if first > last:
        raise ValueError("start is after end")
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))


def _named(metric_id: str, r: Result, hidden: str, reason: str) -> list[Column]:
    """Result columns; a hidden row has no data, for the given reason."""
    shown = lambda c: F.expr(f"CASE WHEN NOT ({hidden}) THEN {c} END")
    return [
        F.lit(metric_id).alias("metric_id"),
        shown(r.value).alias("value"),
        F.expr(f"CASE WHEN {hidden} THEN '{NO_DATA}' ELSE {r.status} END").alias("status"),
        F.lit(defs.metric(metric_id)["format"]).alias("format"),
        shown(r.numerator).alias("numerator_value"), shown(r.denominator).alias("denominator_value"),
        F.expr(f"CASE WHEN {hidden} THEN {text(reason)} ELSE {r.reason} END").alias("reason"),
    ]


def series(
    df: DataFrame,
    metric_id: str,
    start: date | str,
    end: date | str,
    dimension: str | None = None,
    available: Iterable[str] | None = None,
    filters: Filters | None = None,
) -> DataFrame:
    """One row per calendar day, or per day and member seen in the range; gaps are "no data" rows.

    The dense rows are the requested output. Members are the small side: each is expanded to its
    days where it lives, so no cross join is planned.
    """
    keys = [] if dimension is None else [require_dimension(dimension)]
    fields = defs.atomic_fields([metric_id])
    daily = in_scope(df, start, end, filters).groupBy("date", *keys).agg(*sums(fields))
    days = F.explode(F.sequence(F.lit(as_date(start)), F.lit(as_date(end)))).alias("date")
    if dimension is None:
        spine = calendar(df.sparkSession, start, end)
        dense = spine.join(daily, "date", "left")
    else:
        members = daily.select(F.col(dimension).alias("_m")).distinct()
        spine = members.select("_m", days.alias("_d"))
        dense = spine.join(
            daily, (F.col("_d") == F.col("date")) & F.col("_m").eqNullSafe(F.col(dimension)), "left"
        ).drop("date", dimension)
        dense = dense.withColumnsRenamed({"_m": dimension, "_d": "date"})
    gap = f"n_{fields[0]} IS NULL"  # a day with rows has a count, if only 0
    r = result_of(metric_id, available)
    return dense.select("date", *keys, *_named(metric_id, r, gap, "No data exists for this calendar date"))


def day_number(c: str = "date") -> Column:
    """Days since 1970-01-01, for range frames."""
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))


def rolling_series(
    df: DataFrame,
    metric_id: str,
    start: date | str,
    end: date | str,
    available: Iterable[str] | None = None,
    filters: Filters | None = None,
) -> DataFrame:
    """Trailing seven-day metric per calendar day.

    A day whose window begins before the first date of the whole table has no data.
    """
    first = as_date(start)
    spine = calendar(df.sparkSession, first - timedelta(days=DAYS - 1), end)
    fields = defs.atomic_fields([metric_id])
    daily = (
        in_scope(df, first - timedelta(days=DAYS - 1), end, filters).groupBy("date").agg(*sums(fields))
    )
    parts = daily_parts(metric_id, available)
    daily = daily.select("date", *[F.expr(c).alias(f"d_{n}") for n, c in parts.items()])
    # one row per calendar day: the frame below never holds more than the requested range
    window = Window.partitionBy(F.lit(1)).orderBy(day_number()).rangeBetween(-(DAYS - 1), 0)
    dense = spine.join(daily, "date", "left").select(
        "date",
        F.sum("d_ok").over(window).alias("n_ok"),
        F.sum("d_num").over(window).alias("num"),
        F.sum("d_den").over(window).alias("den"),
        F.first("d_bad", ignorenulls=True).over(window).alias("bad"),
    )
    earliest = df.agg(F.min("date")).scalar()
    short = F.coalesce(F.date_sub("date", DAYS - 1) < earliest, F.lit(True))
    r = averaged(metric_id, "n_ok", "num", "den", "bad")
    return (
        dense.where(F.col("date") >= F.lit(first))
        .withColumn("short", short)
        .select("date", *_named(metric_id, r, "short", "Seven calendar days of history are not available"))
    )
