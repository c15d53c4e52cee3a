"""What changed inside each merchant: decomposition, bridges, concentration, ranked facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizdiag.definitions import FACT_RULES
from bizdiag.functions.text import percent, wan

CUSTOMER_STATUSES = ("RETAINED", "CURRENT_ONLY", "PREVIOUS_ONLY")
PRODUCT_STATUSES = ("RETAINED_ACTIVE", "CURRENT_ONLY_ACTIVE", "PREVIOUS_ONLY_ACTIVE")
HIGH, MEDIUM, LIMITED = "HIGH", "MEDIUM", "LIMITED"
MONEY = "decimal(24,2)"
DECOMPOSITION = (
    "driver_classification string, order_effect double, aov_effect double, decomposition_error double"
)


def decompose(months: DataFrame, pairs: DataFrame) -> DataFrame:
    """Symmetric order and order-value effects of the amount change of each pair."""
    chosen = pairs.select("merchant_key", F.col("current_month").alias("month"))
    df = months.join(chosen, ["merchant_key", "month"])
    n0, n1 = F.col("prior_order_count"), F.col("order_count")
    p0, p1 = F.col("prior_aov"), F.col("aov")
    order_effect = (n1 - n0) * (p0 + p1) / 2
    aov_effect = (p1 - p0) * (n0 + n1) / 2
    change = F.col("purchase_amount_change").cast("double")
    df = df.withColumns({"order_effect": order_effect, "aov_effect": aov_effect})
    return df.select(
        "merchant_key", "previous_month", F.col("month").alias("current_month"),
        "purchase_amount_change", "purchase_amount_change_rate", "order_count_change_rate",
        "aov_change_rate", "order_effect", "aov_effect",
        (F.col("order_effect") + F.col("aov_effect") - change).alias("decomposition_error"),
        driver(change, F.col("order_effect"), F.col("aov_effect")).alias("driver_classification"),
    )


def driver(total: Column, order_effect: Column, aov_effect: Column, tolerance: float = 0.01) -> Column:
    """Which effect moves in the direction of the total."""
    sign = F.when(total > 0, 1).otherwise(-1)
    orders, value = order_effect * sign > tolerance, aov_effect * sign > tolerance
    return (
        F.when(F.abs(total) <= tolerance, "MIXED")
        .when(orders & ~value, "ORDER_DRIVEN")
        .when(value & ~orders, "AOV_DRIVEN")
        .otherwise("MIXED")
    )


def bridge(contribution: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Per merchant and status: entities, amounts, change. Absent statuses are zero rows.

    One aggregate; an unknown status fails the job.
    """
    is_ = lambda s: F.col("period_status") == s
    sums = [F.count_if(~F.col("period_status").isin(list(statuses))).alias("unknown")]
    for s in statuses:
        sums.append(F.count_if(is_(s)).alias(f"n_{s}"))
        for c in ("previous_amount", "current_amount", "amount_change"):
            sums.append(F.coalesce(F.sum(F.when(is_(s), F.col(c))), F.lit(0)).cast(MONEY).alias(f"{c}_{s}"))
    cells = [
        F.struct(
            F.lit(i).alias("position"), F.lit(s).alias("period_status"),
            F.col(f"n_{s}").alias("entity_count"),
            *[F.col(f"{c}_{s}").alias(c) for c in ("previous_amount", "current_amount", "amount_change")],
        )
        for i, s in enumerate(statuses, 1)
    ]
    checked = F.when(F.col("unknown") > 0, F.raise_error(F.lit("unknown period status"))).otherwise(F.lit(True))
    return (
        contribution.groupBy("merchant_key").agg(*sums).where(checked)
        .select("merchant_key", F.inline(F.array(*cells)))
    )


def reconciliation(bridged: DataFrame, decomposed: DataFrame) -> DataFrame:
    """Sum of entity changes against the overall change of the merchant."""
    total = bridged.groupBy("merchant_key").agg(F.sum("amount_change").cast(MONEY).alias("bridge_change"))
    return total.join(decomposed.select("merchant_key", "purchase_amount_change"), "merchant_key").select(
        "merchant_key", "bridge_change", F.col("purchase_amount_change").alias("overall_change"),
        (F.col("bridge_change") - F.col("purchase_amount_change")).cast(MONEY).alias("reconciliation_error"),
    )


def top_entities(contribution: DataFrame, key: str, losses: bool, n: int) -> DataFrame:
    """First n losses or gains of each merchant with their ``position``."""
    change = F.col("amount_change")
    side = contribution.where(change < 0 if losses else change > 0)
    order = Window.partitionBy("merchant_key").orderBy(change.asc() if losses else change.desc(), F.col(key))
    return side.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def concentration(contribution: DataFrame, key: str, n: int) -> DataFrame:
    """Share of the n largest losses in all losses of a merchant; NULL without losses."""
    losses = contribution.groupBy("merchant_key").agg(
        F.coalesce(F.sum(F.when(F.col("amount_change") < 0, -F.col("amount_change"))), F.lit(0)).cast(MONEY).alias("total_loss_amount")
    )
    top = (
        top_entities(contribution, key, True, n)
        .groupBy("merchant_key")
        .agg(F.sum(-F.col("amount_change")).cast(MONEY).alias("_top"), F.count("*").alias("top_losses"))
    )
    zero = F.lit(0).cast(MONEY)
    return losses.join(top, "merchant_key", "left").select(
        "merchant_key", "total_loss_amount",
        F.coalesce("_top", zero).alias("top_loss_amount"),
        F.coalesce("top_losses", F.lit(0)).alias("top_losses"),
        (F.col("_top").cast("double") / F.nullif(F.col("total_loss_amount"), zero).cast("double")).alias("loss_concentration"),
    )


def active_overlap(contribution: DataFrame, retained: str = "RETAINED") -> DataFrame:
    """Share of the entities of both months which are active in both."""
    return contribution.groupBy("merchant_key").agg(
        F.count("*").alias("entities"), F.count_if(F.col("period_status") == retained).alias("retained")
    ).withColumn("overlap", F.col("retained") / F.nullif(F.col("entities"), F.lit(0)))


# ------------------------------------------------------------------ facts
def facts(
    months: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    pairs: DataFrame,
    rules: Mapping = FACT_RULES,
) -> DataFrame:
    """At most five ranked core facts per merchant, then its guardrail rows."""
    n, tolerance = rules["loss_concentration_top_n"], rules["reconciliation_tolerance"]
    result = decompose(months, pairs)
    head = result.select("merchant_key", "previous_month", "current_month", "purchase_amount_change")
    has_conflict = products.groupBy("merchant_key").agg(
        F.bool_or(F.col("mapping_quality_status") == "CONFLICT").alias("conflict")
    )
    level = F.when(F.col("conflict"), MEDIUM).otherwise(HIGH)
    flags = F.when(F.col("conflict"), "PRODUCT_MAPPING_LIMITATION").otherwise("")
    high, none = F.lit(HIGH), F.lit("")
    parts = [
        _result_fact(result),
        _bridge_fact(head, customers, CUSTOMER_STATUSES, rules["customer_status_labels"], 2, "CUSTOMER", tolerance, high, none),
        _concentration_fact(head, customers, "customer_key", "customer_name", n, 3, "CUSTOMER", "药店", high, none),
        _bridge_fact(
            head.join(has_conflict, "merchant_key", "left"), products, PRODUCT_STATUSES,
            rules["product_status_labels"], 4, "PRODUCT", tolerance, level, flags,
        ),
        _concentration_fact(
            head.join(has_conflict, "merchant_key", "left"), products, "product_key", "product_name",
            n, 5, "PRODUCT", "商品", level, flags,
        ),
    ]
    core = reduce(DataFrame.unionByName, parts).where(F.col("fact_rank") <= rules["max_core_facts"])
    return core.unionByName(guardrails(head, rules))


def _fact(df: DataFrame, rank: int, dimension: str, code: Column, text: Column, level: Column,
          amount: Column, ratio: Column, flags: Column, supporting: Column) -> DataFrame:
    return df.select(
        "merchant_key", "current_month", "previous_month",
        F.lit(rank).alias("fact_rank"), F.lit(True).alias("is_core_fact"), F.lit("FACT").alias("output_type"),
        F.lit(dimension).alias("diagnosis_dimension"), code.alias("fact_code"), text.alias("fact_text"),
        level.alias("evidence_level"), amount.cast("double").alias("impact_amount"),
        ratio.cast("double").alias("impact_ratio"), flags.alias("quality_flags"),
        supporting.alias("supporting_data"),
    )


def _ym(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def _result_fact(result: DataFrame) -> DataFrame:
    c = F.col
    text = F.concat(
        _ym("current_month"), F.lit(" 进货金额较 "), _ym("previous_month"), F.lit(" "),
        F.when(c("purchase_amount_change") < 0, "下降").otherwise("增长"), F.lit(" "),
        wan(F.abs("purchase_amount_change")), F.lit("（"), percent("purchase_amount_change_rate", 1, True),
        F.lit("）。同期订单数变化 "), percent("order_count_change_rate", 1, True),
        F.lit("，AOV 变化 "), percent("aov_change_rate", 1, True),
        F.lit("；对称两因素分解的订单效应为 "), wan("order_effect", True),
        F.lit("，AOV 效应为 "), wan("aov_effect", True),
        F.lit("，结果层判断为 "), c("driver_classification"), F.lit("。"),
    )
    return _fact(
        result, 1, "RESULT", F.concat(F.lit("RESULT_"), c("driver_classification")), text, F.lit(LIMITED),
        c("purchase_amount_change"), c("purchase_amount_change_rate"),
        F.lit("ORDER_STATUS_SEMANTICS_UNCONFIRMED"),
        F.to_json(F.struct("driver_classification", "order_effect", "aov_effect", "decomposition_error")),
    )


def _bridge_fact(head, contribution, statuses, labels, rank, dimension, tolerance, level, flags) -> DataFrame:
    rows = bridge(contribution, statuses)
    label = F.lit("")
    for s in statuses:
        label = F.when(F.col("period_status") == s, labels[s]).otherwise(label)
    part = F.concat(
        label, F.lit(" "), F.format_number(F.col("entity_count"), 0), F.lit(" 个，贡献 "),
        wan("amount_change", True),
    )
    merged = rows.groupBy("merchant_key").agg(
        F.sum("amount_change").cast(MONEY).alias("_total"),
        # three statuses: the list is bounded
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", part.alias("t")))), lambda s: s["t"]), "；"
        ).alias("_text"),
    )
    df = head.join(merged, "merchant_key")
    error = (F.col("_total") - F.col("purchase_amount_change")).cast(MONEY)
    df = df.withColumn("_error", error.cast("double"))
    ok = F.abs("_error") <= tolerance
    bad_flag = F.concat_ws(";", F.nullif(flags, F.lit("")), F.lit(f"{dimension}_RECONCILIATION_ERROR"))
    return _fact(
        df, rank, dimension, F.lit(f"{dimension}_STATUS_BRIDGE"),
        F.concat(F.col("_text"), F.lit("；该维度合计 "), wan("_total", True), F.lit("。")),
        F.when(ok, level).otherwise(LIMITED), F.col("_total"), F.when(ok, F.lit(1.0)),
        F.when(ok, flags).otherwise(bad_flag),
        F.to_json(F.struct(F.col("_error").alias("reconciliation_error"))),
    )


def _concentration_fact(head, contribution, key, label, n, rank, dimension, entity, level, flags) -> DataFrame:
    shown = [key, label, "amount_change", "period_status"]
    if "mapping_quality_status" in contribution.columns:
        shown.append("mapping_quality_status")

    def listed(losses: bool, name: str) -> DataFrame:
        top = top_entities(contribution, key, losses, n)
        item = F.struct("position", F.struct(*shown).alias("item"))
        return top.groupBy("merchant_key").agg(
            F.transform(F.array_sort(F.collect_list(item)), lambda s: s["item"]).alias(name)
        )

    df = (
        head.join(concentration(contribution, key, n), "merchant_key")
        .join(listed(True, "top_losses_list"), "merchant_key", "left")
        .join(listed(False, "top_growth_list"), "merchant_key", "left")
    )
    loss, gain = F.col("top_losses_list")[0], F.col("top_growth_list")[0]
    named = lambda s: F.concat(s[label], F.lit(" "), wan(s["amount_change"], True))
    text = F.concat_ws(
        "",
        F.concat(
            F.lit("Top "), F.col("top_losses").cast("string"), F.lit(f" {entity}负向变化合计 "),
            wan(-F.col("top_loss_amount"), True), F.lit(f"，占全部{entity}负向变化 "),
            percent("loss_concentration"), F.lit("。"),
        ),
        F.concat(F.lit("最大负向变化为"), named(loss), F.lit("；")),
        F.concat(F.lit("最大正向变化为"), named(gain), F.lit("。")),
    )
    empty = F.array().cast(df.schema["top_losses_list"].dataType)
    supporting = F.to_json(
        F.struct(
            F.coalesce("top_losses_list", empty).alias("top_losses"),
            F.coalesce("top_growth_list", empty).alias("top_growth"),
            F.col("total_loss_amount").cast("double").alias("total_loss_amount"),
            F.col("top_loss_amount").cast("double").alias("top_loss_amount"),
        )
    )
    return _fact(
        df, rank, dimension, F.lit(f"{dimension}_LOSS_CONCENTRATION"), text, level,
        -F.col("top_loss_amount"), F.col("loss_concentration"), flags, supporting,
    )


def guardrails(head: DataFrame, rules: Mapping = FACT_RULES) -> DataFrame:
    """Limitation and do-not-infer rows, added to each merchant where it lives."""
    code, text, flags = rules["limitation"]
    rows = [("LIMITATION", "DATA_QUALITY", code, text, flags)]
    rows += [("DO_NOT_INFER", "GUARDRAIL", c, t, "") for c, t in rules["do_not_infer"].items()]
    cells = [
        F.struct(
            F.lit(kind).alias("output_type"), F.lit(dim).alias("diagnosis_dimension"),
            F.lit(c).alias("fact_code"), F.lit(t).alias("fact_text"), F.lit(f).alias("quality_flags"),
        )
        for kind, dim, c, t, f in rows
    ]
    none = lambda kind: F.lit(None).cast(kind)
    return head.select("merchant_key", "current_month", "previous_month", F.inline(F.array(*cells))).select(
        "*",
        none("int").alias("fact_rank"), F.lit(False).alias("is_core_fact"),
        F.lit(LIMITED).alias("evidence_level"), none("double").alias("impact_amount"),
        none("double").alias("impact_ratio"), F.lit("{}").alias("supporting_data"),
    )


def core_facts(f: DataFrame) -> DataFrame:
    """Ranked facts only."""
    return f.where("is_core_fact").orderBy("merchant_key", "fact_rank")


def read_decomposition(f: DataFrame) -> DataFrame:
    """Decomposition read back from the evidence of the result fact."""
    parsed = F.from_json("supporting_data", DECOMPOSITION)
    return f.where("is_core_fact and diagnosis_dimension = 'RESULT'").select(
        "merchant_key", F.col("impact_amount").alias("purchase_amount_change"),
        "evidence_level", "quality_flags", parsed.alias("d"),
    ).select("merchant_key", "purchase_amount_change", "evidence_level", "quality_flags", "d.*")


def current_metrics(months: DataFrame, pairs: DataFrame) -> DataFrame:
    """Monthly row of the current month of each merchant."""
    chosen = pairs.select("merchant_key", F.col("current_month").alias("month"))
    return months.join(chosen, ["merchant_key", "month"])


def quality_count(quality: DataFrame, rule: str, field: str = "affected_entities") -> DataFrame:
    """One quality number per merchant; unknown stays NULL."""
    return quality.where(F.col("rule") == rule).select("merchant_key", "rule", F.col(field).alias("value"))
