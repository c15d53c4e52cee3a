"""Case exports of merchants: capabilities, activities, traffic against peers, cut-off check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizdiag.functions.cleaning import date_col, identifier_col, trimmed
from bizdiag.functions.text import fixed, percent
from bizdiag.operators.facts import LIMITED, driver
from bizdiag.operators.orders import lenient_number, with_order_totals, zero

# Columns each module needs.
CAPABILITIES = {
    "HAS_PRODUCT": ("商品编码", "产品名称", "进货金额"),
    "HAS_ACTIVITY": ("活动类型", "活动ID", "进货金额"),
    "HAS_CUSTOMER": ("药店编码", "药店全称", "进货金额"),
}
TRAFFIC_COLUMNS = (
    "时间", "详情点击数-我的店铺", "详情点击数-同行均值", "店铺访客数-我的店铺",
    "店铺访客数-同行均值", "活动曝光数-我的店铺", "活动曝光数-同行均值",
)
TRAFFIC_METRICS = {
    "曝光": ("活动曝光数-我的店铺", "活动曝光数-同行均值"),
    "点击": ("详情点击数-我的店铺", "详情点击数-同行均值"),
    "访客": ("店铺访客数-我的店铺", "店铺访客数-同行均值"),
}
CASE_COLUMNS = {
    "订单ID": "order_id", "商品编码": "product_key", "产品名称": "product_name", "厂家": "manufacturer_raw",
    "规格": "specification_raw", "订单状态": "order_status_raw", "处理情况": "processing_status_raw",
    "结算状态": "settlement_status_raw", "活动类型": "activity_type", "活动ID": "activity_id",
}


def capabilities(
    order: DataFrame, traffic: DataFrame | None = None, modules: Mapping[str, Sequence[str]] = CAPABILITIES,
    traffic_columns: Sequence[str] = TRAFFIC_COLUMNS,
) -> DataFrame:
    """One row per module: on when all its columns exist and each holds a value."""
    def check(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
        present = {m: cs for m, cs in wanted.items() if set(cs) <= set(df.columns)}
        counted = list(dict.fromkeys(c for cs in present.values() for c in cs))
        row = df.agg(F.count("*").alias("_rows"), *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(counted)])
        cells = []
        for m in wanted:
            on = F.lit(m in present)
            for c in present.get(m, ()):
                on = on & (F.col(f"n{counted.index(c)}") > 0)
            cells.append(F.struct(F.lit(m).alias("capability"), on.alias("enabled")))
        return row.select(F.inline(F.array(*cells)))

    out = check(order, modules)
    if traffic is not None:
        out = out.unionByName(check(traffic, {"HAS_TRAFFIC": tuple(traffic_columns)}))
    return out


def merchant_check(order: DataFrame, column: str, expected: str) -> DataFrame:
    """Whether the export holds exactly the expected merchant."""
    name = F.col(f"`{column}`")
    return order.agg(F.min(name).alias("first_name"), F.max(name).alias("last_name")).withColumn(
        "is_expected",
        F.coalesce((F.col("first_name") == expected) & (F.col("last_name") == expected), F.lit(False)),
    )


def stage_case_orders(order: DataFrame, merchant: str = "配送商") -> DataFrame:
    """Case order export as typed lines; unreadable amounts are 0, orders count when their sum is > 0."""
    number = lambda c: lenient_number(F.col(c))
    staged = order.select(
        F.col(merchant).alias("merchant_key"),
        date_col(F.col("下单时间"))[0].alias("order_date"),
        *[trimmed(F.col(s)).alias(n) for s, n in CASE_COLUMNS.items()],
        trimmed(F.col("商品编码")).alias("product_code"),
        number("采购量").alias("quantity"), number("进货价").alias("unit_purchase_price"),
        F.coalesce(number("进货金额"), zero()).alias("policy_purchase_amount"),
        F.lit(None).cast("string").alias("customer_key"), F.lit(None).cast("string").alias("customer_name"),
    )
    return with_order_totals(staged).drop("dq_order_cross_date", "dq_zero_amount_order")


def _of_months(lines: DataFrame, previous: date, current: date) -> DataFrame:
    month = F.trunc("order_date", "month")
    return lines.where(month.isin(previous, current)).withColumn("_now", month == F.lit(current))


def case_monthly(lines: DataFrame, previous: date, current: date) -> DataFrame:
    """Two months side by side per merchant, without a completeness test."""
    df = _of_months(lines, previous, current)
    now, positive = F.col("_now"), F.col("policy_purchase_amount") > 0
    aggs = []
    for tag, side in (("current", now), ("previous", ~now)):
        aggs += [
            F.coalesce(F.sum(F.when(side, F.col("policy_purchase_amount"))), F.lit(0)).cast("decimal(24,2)").alias(f"{tag}_purchase_amount"),
            F.countDistinct(F.when(side & F.col("included_in_order_count"), F.col("order_id"))).alias(f"{tag}_order_count"),
            F.countDistinct(F.when(side & positive, F.col("product_key"))).alias(f"{tag}_active_products"),
        ]
    out = df.groupBy("merchant_key").agg(*aggs)
    for tag in ("current", "previous"):
        orders = F.nullif(F.col(f"{tag}_order_count"), F.lit(0)).cast("double")
        out = out.withColumn(f"{tag}_aov", F.col(f"{tag}_purchase_amount").cast("double") / orders)
    for m in ("purchase_amount", "order_count", "aov", "active_products"):
        change = F.col(f"current_{m}").cast("double") - F.col(f"previous_{m}").cast("double")
        base = F.nullif(F.col(f"previous_{m}").cast("double"), F.lit(0.0))
        out = out.withColumns({f"{m}_change": change, f"{m}_change_rate": change / base})
    return out.withColumns(
        {
            "previous_month": F.lit(previous), "current_month": F.lit(current),
            "comparison_quality_status": F.lit("CASE_EXPORT"),
        }
    )


def activity_contribution(lines: DataFrame, previous: date, current: date) -> DataFrame:
    """Changes per merchant and activity type, with shares of the merchant."""
    typed = lines.where(F.col("activity_type").isNotNull())
    # activities of other months stay as zero rows, so all months are grouped
    month = F.trunc("order_date", "month")
    sums, orders = [], []
    for tag, when in (("previous", month == F.lit(previous)), ("current", month == F.lit(current))):
        when = F.coalesce(when, F.lit(False))
        sums.append(
            F.coalesce(F.sum(F.when(when, F.col("policy_purchase_amount"))), F.lit(0)).cast("decimal(24,2)").alias(f"{tag}_amount")
        )
        orders.append(
            F.countDistinct(F.when(when & F.col("included_in_order_count"), F.col("order_id"))).alias(f"{tag}_orders")
        )
    df = typed.groupBy("merchant_key", "activity_type").agg(*sums, *orders)
    change = (F.col("current_amount") - F.col("previous_amount")).cast("decimal(24,2)")
    df = df.withColumn("amount_change", change)
    totals = df.groupBy("merchant_key").agg(
        F.sum("current_amount").alias("_current"),
        F.sum(F.when(F.col("amount_change") < 0, -F.col("amount_change"))).alias("_loss"),
    )
    part = lambda a, b: a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    loss_share = F.when(F.col("amount_change") < 0, part(-F.col("amount_change"), F.col("_loss")))
    return df.join(totals, "merchant_key").select(
        "merchant_key", "activity_type", "previous_amount", "current_amount", "previous_orders",
        "current_orders", "amount_change",
        part(F.col("amount_change"), F.col("previous_amount")).alias("change_rate"),
        part(F.col("current_amount"), F.col("_current")).alias("current_amount_share"),
        F.coalesce(loss_share, F.lit(0.0)).alias("negative_contribution"),
    )


def unpivot_traffic(traffic: DataFrame, metrics: Mapping[str, Sequence[str]] = TRAFFIC_METRICS) -> DataFrame:
    """Traffic export (one column per metric and side) as rows of (day, metric, own, peer)."""
    number = lambda c: F.col(f"`{c}`").cast("string").try_cast("decimal(22,4)")
    cells = [
        F.struct(F.lit(m).alias("metric"), number(own).alias("own"), number(peer).alias("peer"))
        for m, (own, peer) in metrics.items()
    ]
    day = F.try_to_timestamp(F.col("时间").cast("string"), F.lit("yyyyMMdd")).cast("date")
    return traffic.select(day.alias("day"), F.inline(F.array(*cells)))


def traffic_benchmark(
    rows: DataFrame, previous: tuple[date, date], current: tuple[date, date], keys: Sequence[str] = ("metric",)
) -> DataFrame:
    """Own and peer sums of two periods, their changes and the gap, per metric (or per ``keys``)."""
    side = lambda p: F.col("day").between(F.lit(p[0]), F.lit(p[1]))
    zero_ = F.lit(0)
    aggs = [
        F.coalesce(F.sum(F.when(side(p), F.col(c))), zero_).cast("double").alias(f"{tag}_{c}")
        for tag, p in (("previous", previous), ("current", current))
        for c in ("own", "peer")
    ]
    df = rows.groupBy(*keys).agg(*aggs)
    rate = lambda c: F.col(f"current_{c}") / F.nullif(F.col(f"previous_{c}"), F.lit(0.0)) - 1
    df = df.withColumns({"own_change_rate": rate("own"), "peer_change_rate": rate("peer")})
    return df.withColumn("relative_gap", F.col("own_change_rate") - F.col("peer_change_rate"))


def id_coverage(order: DataFrame, snapshots: Sequence[DataFrame], column: str = "活动ID") -> DataFrame:
    """Share of the distinct ids of the orders found in any snapshot; NULL when it cannot be told."""
    ids = lambda df: df.select(identifier_col(F.col(f"`{column}`")).alias("id")).where("id is not null").distinct()
    if not snapshots or any(column not in s.columns for s in snapshots):
        return ids(order).agg(
            F.count("*").alias("ids"), F.lit(None).cast("bigint").alias("mapped_ids"),
            F.lit(None).cast("double").alias("coverage"),
        )
    known = reduce(DataFrame.unionByName, [ids(s) for s in snapshots]).distinct()
    found = ids(order).join(known.withColumn("_hit", F.lit(True)), "id", "left")
    return found.agg(
        F.count("*").alias("ids"), F.count("_hit").alias("mapped_ids")
    ).withColumn("coverage", F.col("mapped_ids") / F.nullif(F.col("ids"), F.lit(0)))


def with_name_conflicts(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Product rows whose product has several names become CONFLICT."""
    several = (
        lines.where(F.col("product_key").isNotNull())
        .groupBy("merchant_key", "product_key")
        .agg(F.coalesce(F.min("product_name") != F.max("product_name"), F.lit(False)).alias("_several"))
        .where("_several")
    )
    df = products.join(several, ["merchant_key", "product_key"], "left")
    state = F.when(F.coalesce("_several", F.lit(False)), "CONFLICT").otherwise(F.col("mapping_quality_status"))
    return df.withColumn("mapping_quality_status", state).drop("_several")


def case_quality(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Three quality rows per merchant: zero amounts, product conflicts, missing customers."""
    orders = lines.where(F.col("order_id").isNotNull()).groupBy("merchant_key", "order_id").agg(
        F.sum("policy_purchase_amount").alias("amount")
    )
    zero_orders = orders.groupBy("merchant_key").agg(F.count_if(F.col("amount") == 0).alias("zero_orders"))
    conflicts = products.groupBy("merchant_key").agg(
        F.count_if(F.col("mapping_quality_status") == "CONFLICT").alias("conflicts")
    )
    per = (
        lines.groupBy("merchant_key")
        .agg(F.count("*").alias("rows"), F.count_if(F.col("policy_purchase_amount") == 0).alias("zero_lines"))
        .join(zero_orders, "merchant_key", "left")
        .join(conflicts, "merchant_key", "left")
    )
    none = F.lit(None).cast("bigint")
    n_conflicts = F.coalesce("conflicts", F.lit(0))
    row = lambda rule, rows, entities, status: F.struct(
        F.lit(rule).alias("rule"), rows.alias("affected_rows"), entities.alias("affected_entities"),
        status.alias("quality_status"),
    )
    return per.select(
        "merchant_key",
        F.inline(
            F.array(
                row("ZERO_AMOUNT_ORDER", F.col("zero_lines"), F.coalesce("zero_orders", F.lit(0)), F.lit("REVIEW_REQUIRED")),
                row("PRODUCT_KEY_MAPPING_CONFLICT", none, n_conflicts,
                    F.when(n_conflicts > 0, "REVIEW_REQUIRED").otherwise("VALID")),
                row("MISSING_CUSTOMER_KEY", F.col("rows"), none, F.lit("UNAVAILABLE")),
            )
        ),
    )


# Sentence parts and codes of case facts.
FALLS, RISES, EQUAL, UNKNOWN = "下降 ", "上升 ", "持平", "变化率不可用"
BOTH_FALL, BOTH_RISE, APART = "；订单量和客单价均为负向变化。", "；订单量和客单价均为正向变化。", "；订单量和客单价变化方向不一致。"


def moved(rate: Column) -> Column:
    """Direction and size of a rate."""
    size = percent(F.abs(rate))
    return (
        F.when(rate.isNull(), F.lit(UNKNOWN)).when(rate < 0, F.concat(F.lit(FALLS), size))
        .when(rate > 0, F.concat(F.lit(RISES), size)).otherwise(F.lit(EQUAL))
    )


def case_facts(
    monthly: DataFrame, products: DataFrame, activities: DataFrame, traffic: DataFrame,
    visitor_metric: str = "访客", top_n: int = 5,
) -> DataFrame:
    """Result, traffic, activity and product facts per merchant, then limitation and guardrail.

    ``traffic``: benchmark rows with a ``merchant_key``. The result states each direction by its sign and
    carries the driver as its code; the traffic signal is stated only for a merchant that did worse than
    its peers, losses only where something was lost.
    """
    c = F.col
    base = monthly.select("merchant_key", "previous_month", "current_month")
    change = c("purchase_amount_change")
    n0, n1, p0, p1 = (c(x) for x in ("previous_order_count", "current_order_count", "previous_aov", "current_aov"))
    order_effect, aov_effect = (n1 - n0) * (p0 + p1) / 2, (p1 - p0) * (n0 + n1) / 2
    orders, value = c("order_count_change_rate"), c("aov_change_rate")
    driven = driver(change, order_effect, aov_effect)
    result = _case_fact(
        monthly, 1, "FACT", "RESULT", F.concat(F.lit("RESULT_"), driven),
        F.concat(
            F.date_format("current_month", "yyyy-MM"), F.lit(" 进货金额较 "), F.date_format("previous_month", "yyyy-MM"), F.lit(" "),
            moved(c("purchase_amount_change_rate")), F.lit("，订单数"), moved(orders), F.lit("，客单价"), moved(value),
            F.when((orders < 0) & (value < 0), F.lit(BOTH_FALL)).when((orders > 0) & (value > 0), F.lit(BOTH_RISE)).otherwise(F.lit(APART)),
        ),
        LIMITED, change, c("purchase_amount_change_rate"), "ORDER_STATUS_SEMANTICS_UNCONFIRMED",
        F.to_json(F.struct(
            change.alias("purchase_amount_change"), order_effect.alias("order_effect"), aov_effect.alias("aov_effect"),
            (order_effect + aov_effect - change).alias("decomposition_error"), driven.alias("driver_classification"),
        )),
    )
    shown = [x for x in traffic.columns if x != "merchant_key"]
    visitors = traffic.where((c("metric") == visitor_metric) & (c("relative_gap") < 0))
    visitors = visitors.select("merchant_key", F.struct(*shown).alias("v"))
    signal = _case_fact(
        base.join(visitors, "merchant_key"), 2, "SIGNAL", "TRAFFIC", F.lit("TRAFFIC_WEAKER_THAN_PEERS"),
        F.concat(
            F.lit("本店访客"), moved(c("v.own_change_rate")), F.lit("，同期同行"), moved(c("v.peer_change_rate")),
            F.lit("；本店流量表现弱于同行。"),
        ),
        "HIGH", F.lit(None), c("v.relative_gap"), "PEER_DEFINITION_UNCONFIRMED", F.to_json("v"),
    )
    first = activities.where(c("amount_change") < 0).groupBy("merchant_key").agg(
        F.min_by(F.struct(*[x for x in activities.columns if x != "merchant_key"]), F.struct("amount_change", "activity_type")).alias("a")
    )
    activity = _case_fact(
        base.join(first, "merchant_key"), 3, "FACT", "ACTIVITY", F.lit("ACTIVITY_TOP_LOSS"),
        F.concat(
            F.lit("活动端口损失主要集中在"), c("a.activity_type"), F.lit("，金额减少 "),
            fixed(F.abs("a.amount_change").cast("double") / 10000), F.lit(" 万，占活动端口全部负向变化 "),
            percent("a.negative_contribution"), F.lit("。"),
        ),
        LIMITED, c("a.amount_change"), c("a.negative_contribution"), "ORDER_STATUS_SEMANTICS_UNCONFIRMED", F.to_json("a"),
    )
    order = Window.partitionBy("merchant_key").orderBy("amount_change", "product_key")
    losses = products.where(c("amount_change") < 0)
    top = losses.withColumn("position", F.row_number().over(order)).where(c("position") <= top_n)
    shown = [x for x in products.columns if x != "merchant_key"]
    top = top.groupBy("merchant_key").agg(
        F.min_by(F.struct(*shown), "position").alias("p"), F.sum("amount_change").alias("_top")
    )
    lost = losses.groupBy("merchant_key").agg(F.sum("amount_change").alias("_all"))
    share = c("_top").cast("double") / c("_all").cast("double")
    product = _case_fact(
        base.join(top, "merchant_key").join(lost, "merchant_key"), 4, "FACT", "PRODUCT", F.lit("PRODUCT_TOP_LOSS"),
        F.concat(
            F.lit("最大单品负向变化为"), c("p.product_name"), F.lit("，进货金额减少 "),
            fixed(F.abs("p.amount_change").cast("double") / 10000), F.lit(" 万；Top 5 损失商品占全部商品负向变化 "),
            percent(share), F.lit("。"),
        ),
        "MEDIUM", c("p.amount_change"), share, "PRODUCT_MAPPING_LIMITATION", F.to_json("p"),
    )
    empty = F.lit("{}")
    limit = _case_fact(
        base, 5, "LIMITATION", "CUSTOMER", F.lit("CUSTOMER_CAPABILITY_UNAVAILABLE"),
        F.lit("当前数据来自中台账号，订单导出不包含药店标识；药店贡献诊断需要商家账号权限。"),
        LIMITED, F.lit(None), F.lit(None), "CUSTOMER_KEY_UNAVAILABLE", empty,
    )
    guard = _case_fact(
        base, None, "DO_NOT_INFER", "GUARDRAIL", F.lit("NO_CAUSAL_INFERENCE"),
        F.lit("现有数据不能证明流量下降导致进货金额下降，也不能证明活动、价格、缺货或退款导致金额变化。"),
        LIMITED, F.lit(None), F.lit(None), "", empty,
    )
    return reduce(DataFrame.unionByName, [result, signal, activity, product, limit, guard])


def _case_fact(df: DataFrame, rank: int | None, kind: str, dimension: str, code: Column, text: Column,
               level: str, amount: Column, ratio: Column, flags: str, supporting: Column) -> DataFrame:
    return df.select(
        "merchant_key", "current_month", "previous_month", F.lit(rank).cast("int").alias("fact_rank"),
        F.lit(rank is not None).alias("is_core_fact"), F.lit(kind).alias("output_type"),
        F.lit(dimension).alias("diagnosis_dimension"), code.alias("fact_code"), text.alias("fact_text"),
        F.lit(level).alias("evidence_level"), amount.cast("double").alias("impact_amount"),
        ratio.cast("double").alias("impact_ratio"), F.lit(flags).alias("quality_flags"),
        supporting.alias("supporting_data"),
    )


def cutoff_reconciliation(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Running daily amount of a month against a reference total, and the nearest cut-off day.

    ``totals``: (merchant_key, month, reference_total). The window runs over the days of a month.
    """
    daily = lines.groupBy("merchant_key", "order_date").agg(F.sum("policy_purchase_amount").alias("amount"))
    daily = daily.withColumn("month", F.trunc("order_date", "month")).join(totals, ["merchant_key", "month"])
    by_day = Window.partitionBy("merchant_key", "month").orderBy("order_date")
    running = F.sum("amount").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(24,2)")
    daily = daily.withColumn("cumulative_purchase_amount", running)
    gap = (F.col("cumulative_purchase_amount") - F.col("reference_total")).cast("decimal(24,2)")
    daily = daily.withColumn("difference", gap)
    nearest = F.min_by("order_date", F.struct(F.abs("difference"), F.col("order_date"))).over(
        Window.partitionBy("merchant_key", "month")
    )
    return daily.select(
        "merchant_key", "month", F.col("order_date").alias("cutoff_date"), "cumulative_purchase_amount",
        "reference_total", "difference",
        (F.col("difference").cast("double") / F.nullif(F.col("reference_total").cast("double"), F.lit(0.0))).alias("difference_rate"),
        (F.col("order_date") == nearest).alias("is_nearest"),
    )
