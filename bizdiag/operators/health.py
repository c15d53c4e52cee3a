"""Merchant health: quality states, ranks, month-on-month changes, attention rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizdiag.functions.lineage import written
from bizdiag.functions.ordering import quantiles, with_ranks
from bizdiag.functions.text import joined, percent
from bizdiag.operators.staging import rate

# Quality states from best to worst.
QUALITY = ("VALID", "INSUFFICIENT_HISTORY", "UNAVAILABLE_FOR_PERIOD", "MISSING", "UNRESOLVED_MERCHANT")
BASE = ("gmv", "cash_sales_amount", "order_count", "aftersales_order_count", "aftersales_rate")
CHANGES = {
    "gmv_mom": "gmv", "cash_sales_mom": "cash_sales_amount",
    "order_count_mom": "order_count", "aftersales_rate_mom": "aftersales_rate",
}


def unresolved() -> Column:
    """Merchant without an identity."""
    return F.col("mapping_status") == "UNRESOLVED"


def as_month(df: DataFrame) -> DataFrame:
    """``month`` as the first day of the month, from a date or ``yyyy-MM`` text."""
    if dict(df.dtypes)["month"] == "string":
        return df.withColumn("month", F.to_date(F.concat("month", F.lit("-01"))))
    return df


def health(staged: DataFrame) -> DataFrame:
    """Health columns per month and merchant.

    One window per merchant (its months) serves all changes and the run of declines; ranks within a
    month are exact and are computed without one task per month. Writes the rows when called.
    """
    df = as_month(staged)
    states = []
    for m in BASE:
        df = df.withColumn(
            f"{m}_quality_status",
            F.when(unresolved(), "UNRESOLVED_MERCHANT").when(F.col(m).isNull(), "MISSING").otherwise("VALID"),
        )
        states.append(F.array_position(F.array(*[F.lit(q) for q in QUALITY]), F.col(f"{m}_quality_status")))
    worst = F.element_at(F.array(*[F.lit(q) for q in QUALITY]), F.greatest(*states).cast("int"))
    df = df.withColumn("metric_quality_status", worst)
    ranks = {"gmv": ("gmv_rank", "gmv_percentile"), "cash_sales_amount": ("cash_sales_rank", None)}
    df = with_ranks(written(df), ["month"], ranks)

    by_merchant = Window.partitionBy("merchant_key").orderBy("month")
    adjacent = F.lag("month").over(by_merchant) == F.add_months("month", -1)
    prior = lambda c: F.when(adjacent, F.lag(c).over(by_merchant))
    new: dict[str, Column] = {
        f"_prior_{c}": prior(c) for c in (*CHANGES.values(), "gmv_rank")
    }
    fell = F.coalesce(F.col("gmv") < F.lag("gmv").over(by_merchant), F.lit(False))
    new["_fell"] = fell
    new["_n"] = F.row_number().over(by_merchant)
    df = df.withColumns(new)
    so_far = by_merchant.rowsBetween(Window.unboundedPreceding, 0)
    last_stop = F.max(F.when(~F.col("_fell"), F.col("_n"))).over(so_far)
    out: dict[str, Column] = {}
    for name, c in CHANGES.items():
        before = F.col(f"_prior_{c}")
        out[name] = F.when(~unresolved(), rate(F.col(c), before))
        out[f"{name}_quality_status"] = (
            F.when(unresolved(), "UNRESOLVED_MERCHANT")
            .when(F.col(c).isNull(), "MISSING")
            .when(before.isNotNull(), "VALID")
            .otherwise("INSUFFICIENT_HISTORY")
        )
    out["gmv_rank_change"] = F.col("gmv_rank") - F.col("_prior_gmv_rank")
    out["consecutive_gmv_decline"] = F.col("_n") - last_stop
    return df.withColumns(out).drop("_fell", "_n", *[c for c in new if c.startswith("_prior_")])


def pooled_quantiles(
    df: DataFrame, wanted: Mapping[str, tuple[Column, Column, float, float]], minimum: int
) -> DataFrame:
    """One row of thresholds: name -> (value, condition, q, fallback below ``minimum`` values).

    All thresholds come from one distributed ordering of (name, value) rows.
    """
    cells = [
        F.struct(
            F.lit(name).alias("name"), F.lit(q).alias("q"),
            F.when(F.coalesce(cond, F.lit(False)), value.cast("double")).alias("v"),
        )
        for name, (value, cond, q, _) in wanted.items()
    ]
    long = df.select(F.inline(F.array(*cells)))
    found = quantiles(long, ["name", "q"], "v", {"threshold": F.col("q")})
    pick = lambda n: F.max(F.when((F.col("name") == n) & (F.col("n_values") >= minimum), F.col("threshold")))
    return found.agg(
        *[F.coalesce(pick(n), F.lit(float(fallback))).alias(n) for n, (_, _, _, fallback) in wanted.items()]
    )


def health_thresholds(h: DataFrame) -> DataFrame:
    """Eight thresholds from the observed distribution, as one row. Needs three values each."""
    c, always = F.col, F.lit(True)
    t = pooled_quantiles(
        h,
        {
            "gmv_decline": (c("gmv_mom"), c("gmv_mom") < 0, 0.10, -0.20),
            "cash_decline": (c("cash_sales_mom"), c("cash_sales_mom") < 0, 0.10, -0.20),
            "order_decline": (c("order_count_mom"), c("order_count_mom") < 0, 0.10, -0.20),
            "rank_drop": (c("gmv_rank_change"), c("gmv_rank_change") > 0, 0.90, 10.0),
            "aftersales_high": (c("aftersales_rate"), always, 0.90, 0.0),
            "aftersales_worsening": (c("aftersales_rate_mom"), c("aftersales_rate_mom") > 0, 0.90, 0.20),
            "order_rise_for_divergence": (c("order_count_mom"), c("order_count_mom") > 0, 0.75, 0.10),
        },
        3,
    )
    return t.withColumn("low_gmv_percentile", F.lit(0.20))


def attention(h: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Business and quality signals per row with their roll-up. Gaps never become business signals."""
    t = lambda name: F.col(f"_t.{name}")
    c = F.col
    df = h.withColumn("_t", thresholds.select(F.struct("*")).scalar()).withColumn(
        "_latest", h.agg(F.max("month")).scalar()
    )
    known = ~unresolved()
    fell = (c("gmv_mom") <= t("gmv_decline")) & (c("gmv_mom") < 0)
    business = [
        (fell, F.concat(F.lit("GMV环比明显下降("), percent("gmv_mom"), F.lit(")"))),
        (c("gmv_rank_change") >= t("rank_drop"),
         F.concat(F.lit("GMV排名恶化("), c("gmv_rank_change").cast("string"), F.lit("名)"))),
        (c("gmv_percentile") <= t("low_gmv_percentile"), F.lit("GMV处于同月区域低分位")),
        (c("aftersales_rate") >= t("aftersales_high"), F.lit("售后率处于同月区域高位")),
        (c("aftersales_rate_mom") >= t("aftersales_worsening"),
         F.concat(F.lit("售后率明显恶化("), percent("aftersales_rate_mom"), F.lit(")"))),
        ((c("order_count_mom") <= t("order_decline")) & (c("order_count_mom") < 0),
         F.concat(F.lit("订单数明显下降("), percent("order_count_mom"), F.lit(")"))),
        ((c("gmv_mom") <= t("gmv_decline")) & (c("order_count_mom") >= t("order_rise_for_divergence")),
         F.lit("GMV下降与订单数上升方向背离")),
        (c("consecutive_gmv_decline") >= 3,
         F.concat(F.lit("GMV连续下降"), c("consecutive_gmv_decline").cast("string"), F.lit("个月"))),
    ]
    latest = c("month") == c("_latest")
    quality = [
        (unresolved(), F.lit("UNRESOLVED_MERCHANT")),
        (known & latest & c("gmv").isNull(), F.lit("近期GMV缺失")),
        (known & latest & c("cash_sales_amount").isNull(), F.lit("近期现金额缺失")),
    ]
    listed = lambda rules, gate: F.array_compact(
        F.array(*[F.when(gate & F.coalesce(cond, F.lit(False)), text) for cond, text in rules])
    )
    df = df.withColumns({"_b": listed(business, known), "_q": listed(quality, F.lit(True))})
    has_b, has_q = F.size("_b") > 0, F.size("_q") > 0
    return df.withColumns(
        {
            "attention_reasons": F.array_join(F.concat("_b", "_q"), "；"),
            "attention_reason_types": joined(
                "|", (has_b, F.lit("BUSINESS_ALERT")), (has_q, F.lit("DATA_QUALITY_ALERT"))
            ),
            "data_quality_status": F.when(has_q, "DATA_QUALITY_ALERT").otherwise("NO_ALERT"),
            "data_quality_reasons": F.array_join("_q", "；"),
            "business_attention_status": F.when(has_b, "BUSINESS_ALERT")
            .when(has_q, "DATA_QUALITY_ALERT")
            .otherwise("NO_ALERT"),
            "priority_score": F.size("_b"),
            "severity": F.when(F.size("_b") >= 3, "HIGH")
            .when(has_b, "MEDIUM")
            .when(has_q, "DATA_QUALITY")
            .otherwise("NONE"),
        }
    ).drop("_b", "_q", "_t", "_latest")


def attention_sample(a: DataFrame, n: int = 15) -> DataFrame:
    """Per month the first n rows with an alert, by score, then by GMV change (NULL last)."""
    order = Window.partitionBy("month").orderBy(
        F.col("priority_score").desc(), F.col("gmv_mom").asc_nulls_last(), F.col("merchant_key")
    )
    return (
        a.where("business_attention_status <> 'NO_ALERT'")
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= n)
        .drop("_n")
    )


def alert_counts(a: DataFrame) -> DataFrame:
    """Alerts per month."""
    is_ = lambda s: F.count_if(F.col("business_attention_status") == s)
    return a.groupBy("month").agg(
        is_("BUSINESS_ALERT").alias("business_alert"),
        is_("DATA_QUALITY_ALERT").alias("data_quality_alert"),
        F.count_if(F.col("business_attention_status") != "NO_ALERT").alias("total_attention_rows"),
    )
