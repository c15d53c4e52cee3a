"""Queries over the priority rows: periods, filters, overview, top lists, trends, wording."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUALITY_ALERT = "DATA_QUALITY_ALERT"
RELIABLE = ("COMPLETE", "LIKELY_COMPLETE")


def with_period_quality(p: DataFrame, periods: DataFrame) -> DataFrame:
    """Add status, comparability and label of the month. ``periods``: (month, period_quality_status)."""
    known = periods.select(F.col("month").alias("_m"), F.col("period_quality_status").alias("_s"))
    status = F.coalesce("_s", F.lit("UNRESOLVED"))
    label = (
        F.when(status.isin(*RELIABLE), "完整周期候选")
        .when(status.contains("HISTORICAL_SNAPSHOT"), "历史快照")
        .when(status == "PARTIAL_PERIOD", "部分周期")
        .otherwise("待确认")
    )
    return p.join(known, F.col("month") == F.col("_m"), "left").select(
        p["*"], status.alias("period_quality_status"),
        status.isin(*RELIABLE).alias("is_comparable_period"), label.alias("period_quality_label"),
    )


def latest_complete_period(p: DataFrame, periods: DataFrame) -> DataFrame:
    """Newest reliable month with a resolved merchant whose current and previous GMV are known."""
    usable = (
        F.col("current_gmv").isNotNull()
        & F.col("previous_gmv").isNotNull()
        & (F.col("merchant_mapping_status") != "UNRESOLVED")
    )
    return (
        with_period_quality(p.where(usable), periods)
        .where("is_comparable_period")
        .agg(F.max("month").alias("month"))
    )


def filter_dashboard(
    p: DataFrame,
    period: date | Column,
    owners: Sequence[str] | None = None,
    scales: Sequence[str] | None = None,
    priority_levels: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of a month, optionally of some owners, scales and levels."""
    df = p.where(F.col("month") == (period if isinstance(period, Column) else F.lit(period)))
    if owners:
        df = df.where(F.coalesce("owner", F.lit("")).isin(list(owners)))
    if scales:
        df = df.where(F.col("merchant_scale").isin(list(scales)))
    if priority_levels:
        df = df.where(F.col("priority_level").isin(list(priority_levels)))
    return df


def is_business() -> Column:
    """Comparable row without a quality block."""
    return (
        (F.col("priority_level") != QUALITY_ALERT)
        & F.col("current_gmv").isNotNull()
        & F.col("previous_gmv").isNotNull()
    )


def business_rows(p: DataFrame) -> DataFrame:
    """Rows which may be ranked."""
    return p.where(is_business())


def quality_rows(p: DataFrame) -> DataFrame:
    """Rows flagged for quality."""
    return p.where(
        (F.col("priority_level") == QUALITY_ALERT) | (F.col("data_quality_status") == QUALITY_ALERT)
    )


def overview(p: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals, movements and level counts; totals are NULL when nothing is comparable."""
    ok = is_business()
    level = lambda s: F.count_if(F.col("priority_level") == s)
    out = p.groupBy(*keys).agg(
        F.sum(F.when(ok, F.col("current_gmv"))).alias("region_gmv"),
        F.sum(F.when(ok, F.col("previous_gmv"))).alias("region_gmv_previous"),
        F.count_if(ok & (F.col("gmv_change_abs") < 0)).alias("declining_merchants"),
        F.count_if(ok & (F.col("gmv_change_abs") > 0)).alias("growth_merchants"),
        level("PRIORITY").alias("priority_merchants"),
        level("ATTENTION").alias("attention_merchants"),
        level("WATCHLIST").alias("watchlist_merchants"),
        F.count_if(F.coalesce("diagnostic_dimensions", F.lit("")).contains("Service")).alias("service_alerts"),
        F.count_if(ok).alias("comparable_merchants"),
    )
    before = F.nullif(F.col("region_gmv_previous").cast("double"), F.lit(0.0))
    return out.withColumn("gmv_mom", F.col("region_gmv").cast("double") / before - 1)


def top_loss(p: DataFrame, n: int = 10) -> DataFrame:
    """Largest losses."""
    df = business_rows(p).where(F.col("gmv_loss") > 0)
    return df.orderBy(F.col("gmv_loss").desc(), F.col("merchant_key")).limit(n)


def top_growth(p: DataFrame, n: int = 10) -> DataFrame:
    """Largest gains."""
    df = business_rows(p).where(F.col("gmv_change_abs") > 0)
    return df.orderBy(F.col("gmv_change_abs").desc(), F.col("merchant_key")).limit(n)


def merchant_trend(p: DataFrame, merchant_key: str | None = None, periods: int = 12) -> DataFrame:
    """Last months of one merchant, or of every merchant; NULL gaps stay."""
    df = p if merchant_key is None else p.where(F.col("merchant_key") == merchant_key)
    newest = Window.partitionBy("merchant_key").orderBy(F.col("month").desc())
    return (
        df.withColumn("_n", F.row_number().over(newest))
        .where(F.col("_n") <= periods)
        .select(
            "merchant_key", "month", F.col("current_gmv").alias("gmv"), "gmv_mom", "gmv_rank_current",
            "aftersales_rate", "metric_quality_status", "data_quality_status",
        )
    )


def rank_change_text(c: Column) -> Column:
    """Rank movement with its direction; a positive change is a worse rank."""
    return (
        F.when(c.isNull(), "NULL")
        .when(c > 0, F.concat(F.lit("↓"), c.cast("int").cast("string"), F.lit("名")))
        .when(c < 0, F.concat(F.lit("↑"), F.abs(c).cast("int").cast("string"), F.lit("名")))
        .otherwise("持平")
    )


# Prefixes of reasons and their wording.
PREFIXES = (
    (r"^Trend:\s*", "GMV趋势："),
    ("Scale / Impact: ", "区域影响："),
    ("Relative Position: ", "相对位置："),
    ("Order: ", "订单："),
    ("Service: ", "服务风险："),
)


def reasons_text(c: Column, limit: int = 3) -> Column:
    """First reasons in business wording."""
    def worded(r: Column) -> Column:
        for pattern, text in PREFIXES:
            r = F.regexp_replace(r, pattern, text)
        r = F.regexp_replace(r, r"排名变化0(?!\d)", "排名持平")
        r = F.regexp_replace(r, r"排名变化-(\d+)", "排名上升$1名")
        return F.regexp_replace(r, r"排名变化(\d+)", "排名下降$1名")

    parts = F.filter(F.transform(F.split(c, "；"), lambda r: F.trim(r)), lambda r: r != "")
    kept = F.transform(F.slice(parts, 1, limit), worded)
    return F.coalesce(F.array_join(kept, "｜"), F.lit(""))
