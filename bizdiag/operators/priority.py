"""Merchant priority: impact, scale, diagnostic dimensions and levels over the health rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizdiag.functions.lineage import written
from bizdiag.functions.ordering import quantiles
from bizdiag.functions.text import fixed, percent
from bizdiag.operators.health import as_month, pooled_quantiles, unresolved

LEVELS = {"PRIORITY": 1, "ATTENTION": 2, "WATCHLIST": 3}
SCALES = {"KEY": 1, "MID": 2, "LONG_TAIL": 3, "UNAVAILABLE": 4}


def with_previous(h: DataFrame) -> DataFrame:
    """Values of the previous calendar month, change, loss and rank change."""
    df = as_month(h)
    by_merchant = Window.partitionBy("merchant_key").orderBy("month")
    adjacent = F.lag("month").over(by_merchant) == F.add_months("month", -1)
    prior = lambda c: F.when(adjacent, F.lag(c).over(by_merchant))
    df = df.withColumns(
        {
            "previous_gmv": prior("gmv"), "rank_previous": prior("gmv_rank"),
            "previous_order_count": prior("order_count"),
        }
    )
    change = F.col("gmv") - F.col("previous_gmv")
    return df.withColumns(
        {
            "current_gmv": F.col("gmv"),
            "gmv_change_abs": change,
            "gmv_loss": F.greatest(-change, F.lit(0).cast("decimal(18,2)")),
            "order_change": F.col("order_count_mom"),
            "gmv_rank_current": F.col("gmv_rank"),
            "gmv_rank_change": F.col("gmv_rank") - F.col("rank_previous"),
        }
    ).withColumn("gmv_loss", F.when(F.col("gmv_change_abs").isNotNull(), F.col("gmv_loss")))


def with_impact_and_scale(p: DataFrame) -> DataFrame:
    """Regional totals, shares and the scale class. Both monthly tables have one row per month."""
    counted = F.col("previous_gmv").isNotNull() & ~unresolved()
    valid = p.where(counted)
    totals = valid.groupBy("month").agg(
        F.sum("previous_gmv").alias("regional_previous_gmv"),
        F.sum("current_gmv").alias("regional_current_gmv"),
    )
    quartiles = quantiles(valid, ["month"], "previous_gmv", {"q25": 0.25, "q75": 0.75})
    # the day column keeps its name on the left side only
    months = totals.join(quartiles, "month").withColumnRenamed("month", "_month")
    df = p.join(months, F.col("month") == F.col("_month"), "left").drop("_month")
    change = F.col("regional_current_gmv") - F.col("regional_previous_gmv")
    loss = F.when(change < 0, -change)
    previous = F.col("previous_gmv").cast("double")
    df = df.withColumns(
        {
            "regional_gmv_change_abs": change,
            "regional_gmv_loss": loss,
            "regional_gmv_loss_contribution": F.col("gmv_loss").cast("double") / loss.cast("double"),
            "previous_gmv_share": F.when(F.col("regional_previous_gmv") != 0, previous / F.col("regional_previous_gmv").cast("double")),
            "merchant_scale": F.when(
                F.col("previous_gmv").isNull() | (F.coalesce("n_values", F.lit(0)) < 4), "UNAVAILABLE"
            )
            .when(previous >= F.col("q75"), "KEY")
            .when(previous >= F.col("q25"), "MID")
            .otherwise("LONG_TAIL"),
        }
    )
    return df.drop("n_values", "q25", "q75")


def priority_thresholds(p: DataFrame) -> DataFrame:
    """Nine thresholds over resolved merchants, as one row. Needs four values each."""
    c, always = F.col, F.lit(True)
    t = pooled_quantiles(
        p.where(~unresolved()),
        {
            "severe_gmv_mom": (c("gmv_mom"), c("gmv_mom") < 0, 0.10, -0.20),
            "severe_order_mom": (c("order_count_mom"), c("order_count_mom") < 0, 0.10, -0.20),
            "high_loss": (c("gmv_loss"), c("gmv_loss") > 0, 0.75, 0.0),
            "important_share": (c("previous_gmv_share"), c("previous_gmv_share") > 0, 0.75, 0.0),
            "rank_drop": (c("gmv_rank_change"), c("gmv_rank_change") > 0, 0.90, 10.0),
            "high_aftersales": (c("aftersales_rate"), always, 0.90, 0.0),
            "aftersales_worsening": (c("aftersales_rate_mom"), c("aftersales_rate_mom") > 0, 0.90, 0.20),
            "order_rise_divergence": (c("order_count_mom"), c("order_count_mom") > 0, 0.75, 0.10),
        },
        4,
    )
    return t.withColumn("low_percentile", F.lit(0.20))


def with_dimensions(p: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Diagnostic dimensions of a row, their texts and their number."""
    c = F.col
    t = lambda name: F.col(f"_t.{name}")
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    df = p.withColumn("_t", thresholds.select(F.struct("*")).scalar())
    na = F.lit("nan%")
    long_run = c("consecutive_gmv_decline") >= 3
    trend = yes((c("gmv_mom") <= t("severe_gmv_mom")) & (c("gmv_mom") < 0)) | yes(long_run)
    impact = yes(c("gmv_loss").cast("double") >= t("high_loss")) | yes(c("previous_gmv_share") >= t("important_share"))
    relative = yes(c("gmv_rank_change") >= t("rank_drop")) | yes(c("gmv_percentile") <= t("low_percentile"))
    order = yes((c("order_count_mom") <= t("severe_order_mom")) & (c("order_count_mom") < 0)) | yes(
        (c("gmv_mom") <= t("severe_gmv_mom")) & (c("order_count_mom") >= t("order_rise_divergence"))
    )
    service = yes(c("aftersales_rate") >= t("high_aftersales")) | yes(
        c("aftersales_rate_mom") >= t("aftersales_worsening")
    )
    run = F.when(
        yes(long_run), F.concat(F.lit("，连续下降"), c("consecutive_gmv_decline").cast("string"), F.lit("个月"))
    ).otherwise("")
    texts = {
        "Trend": (trend, F.concat(
            F.lit("Trend: "),
            F.coalesce(F.concat(F.lit("GMV环比"), percent("gmv_mom")), F.lit("GMV连续下降")), run)),
        "Scale / Impact": (impact, F.concat(
            F.lit("Scale / Impact: GMV损失"), F.coalesce(fixed("gmv_loss"), F.lit("nan")),
            F.lit("，上月区域占比"), F.coalesce(percent("previous_gmv_share"), na))),
        "Relative Position": (relative, F.concat(
            F.lit("Relative Position: 排名变化"),
            F.coalesce(c("gmv_rank_change").cast("string"), F.lit("NA")),
            F.lit("，同月分位"), F.coalesce(percent("gmv_percentile"), na))),
        "Order": (order, F.concat(F.lit("Order: 订单环比"), percent("order_count_mom"))),
        "Service": (service, F.concat(
            F.lit("Service: 售后率"), F.coalesce(percent("aftersales_rate"), na),
            F.coalesce(F.concat(F.lit("，环比变化"), percent("aftersales_rate_mom")), F.lit("")))),
    }
    known = ~unresolved()
    pick = lambda make: F.array_compact(
        F.array(*[F.when(known & cond, make(name, text)) for name, (cond, text) in texts.items()])
    )
    dims = pick(lambda name, _: F.lit(name))
    return df.withColumns(
        {
            "_dims": dims,
            "diagnostic_dimensions": F.array_join(dims, "|"),
            "attention_reasons": F.array_join(pick(lambda _, text: text), "；"),
            "diagnostic_dimension_count": F.size(dims),
        }
    ).drop("_t")


def with_level(p: DataFrame) -> DataFrame:
    """Priority level, pool and sort keys."""
    has = lambda d: F.array_contains("_dims", d)
    blocked = unresolved() | F.col("gmv").isNull()
    urgent = has("Trend") & (has("Scale / Impact") | has("Service") | (F.col("consecutive_gmv_decline") >= 3))
    level = (
        F.when(blocked, "DATA_QUALITY_ALERT")
        .when(F.size("_dims") == 0, "NO_PRIORITY")
        .when(urgent, "PRIORITY")
        .when(F.size("_dims") >= 2, "ATTENTION")
        .otherwise("WATCHLIST")
    )
    return p.withColumns(
        {
            "priority_level": level,
            "attention_pool": F.when(level.isin(*LEVELS), "BUSINESS_ALERT").otherwise(level),
            "priority_sort_loss": F.coalesce("gmv_loss", F.lit(0).cast("decimal(18,2)")),
            "priority_sort_share": F.coalesce("previous_gmv_share", F.lit(0.0)),
            "merchant_name": F.col("merchant_name_raw"),
            "merchant_mapping_status": F.col("mapping_status"),
        }
    ).drop("_dims")


def priority(h: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(priority rows, thresholds) of the health rows, which are written on the way."""
    base = written(with_impact_and_scale(written(with_previous(h))))
    thresholds = priority_thresholds(base)
    return with_level(with_dimensions(base, thresholds)), thresholds


def ordinal(column: str, order: dict[str, int]) -> Column:
    """Position of a code in its order; NULL for other codes."""
    out = F.lit(None).cast("int")
    for code, n in order.items():
        out = F.when(F.col(column) == code, n).otherwise(out)
    return out


def priority_list(p: DataFrame, month: date, n: int = 15) -> DataFrame:
    """First n merchants of a month: level, scale, loss, dimensions, share."""
    return (
        p.where((F.col("month") == F.lit(month)) & F.col("priority_level").isin(*LEVELS))
        .orderBy(
            ordinal("priority_level", LEVELS), ordinal("merchant_scale", SCALES),
            F.col("priority_sort_loss").desc(), F.col("diagnostic_dimension_count").desc(),
            F.col("priority_sort_share").desc(), F.col("merchant_key"),
        )
        .limit(n)
    )


def priority_summary(p: DataFrame, month: date) -> DataFrame:
    """Totals and level counts of a month, as one row."""
    shared = F.col("current_gmv").isNotNull() & F.col("previous_gmv").isNotNull() & ~unresolved()
    level = lambda s: F.count_if(F.col("priority_level") == s)
    row = p.where(F.col("month") == F.lit(month)).agg(
        F.count_if(shared).alias("valid_merchants"),
        F.sum(F.when(shared, F.col("current_gmv"))).alias("current_total"),
        F.sum(F.when(shared, F.col("previous_gmv"))).alias("previous_total"),
        F.count_if(shared & (F.col("gmv_change_abs") < 0)).alias("decline_merchants"),
        F.count_if(shared & (F.col("gmv_change_abs") > 0)).alias("growth_merchants"),
        F.count_if(F.col("diagnostic_dimensions").contains("Service")).alias("service_merchants"),
        level("PRIORITY").alias("priority"), level("ATTENTION").alias("attention"),
        level("WATCHLIST").alias("watchlist"), level("DATA_QUALITY_ALERT").alias("data_quality"),
    )
    change = (F.col("current_total") - F.col("previous_total")).cast("double")
    return row.withColumn("mom", change / F.nullif(F.col("previous_total").cast("double"), F.lit(0.0)))
