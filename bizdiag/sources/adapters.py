"""Domain tables derived from the TPC-H-like test tables.

A user of the library brings their own fact, order lines and merchant months; these adapters only
give the registered queries something to run on. Every adapter reads the whole tables, prunes to
the columns it needs and lets Catalyst choose the joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizdiag.functions.lineage import written
from bizdiag.schema import COLUMNS, DIMENSIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str) -> Column:
    """Stored double as exact money."""
    return F.col(c).cast("decimal(18,2)")


def daily_fact(
    spark: SparkSession, sf_dir: str, dims: Sequence[str] = DIMENSIONS
) -> DataFrame:
    """Canonical daily fact at the grain ``date`` x ``dims``.

    Dimensions which are not asked for are not joined. All measures are sums of line counts or
    amounts, so a coarser grain gives the same metric values.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("qty"),
        money("l_extendedprice").alias("price"), "l_returnflag", "l_linestatus",
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.col("o_orderdate").cast("date").alias("date"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("channel"),
    )
    if {"business_line", "region", "team"} & set(dims):
        places = table(spark, sf_dir, "nation").join(
            table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        customers = (
            table(spark, sf_dir, "customer")
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                "c_custkey",
                F.col("r_name").alias("business_line"),
                F.col("n_name").alias("region"),
                F.col("c_mktsegment").alias("team"),
            )
        )
        orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    if "product" in dims:
        parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("product"))
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    if "salesperson" in dims:
        people = table(spark, sf_dir, "supplier").select(
            "s_suppkey", F.col("s_name").alias("salesperson")
        )
        lines = lines.join(people, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    valid = F.col("o_orderstatus") != "P"
    paid = F.col("o_orderstatus") == "F"
    refunded = paid & (F.col("l_returnflag") == "R")
    keys = ["date", *[d for d in DIMENSIONS if d in dims]]
    fact = joined.groupBy(*keys).agg(
        F.sum("qty").alias("impressions"),
        F.count("*").alias("leads"),
        F.count_if(valid).alias("valid_leads"),
        F.count_if(valid & (F.col("l_linestatus") == "F")).alias("contacted_leads"),
        F.count_if(valid & (F.col("l_returnflag") != "A")).alias("followed_leads"),
        F.count_if(paid).alias("paid_users"),
        F.count_if(paid).alias("paid_orders"),
        F.sum(F.when(paid, F.col("price"))).cast("decimal(18,2)").alias("gross_revenue"),
        F.count_if(refunded).alias("refund_users"),
        F.count_if(refunded).alias("refund_orders"),
        F.sum(F.when(paid, F.when(refunded, F.col("price")).otherwise(F.lit(0))))
        .cast("decimal(18,2)")
        .alias("refund_amount"),
    )
    return fact.select(*[c for c in COLUMNS if c in keys or c not in DIMENSIONS])


def _merchant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a supplier in a ship month: one row per (supplier, month, order)."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"),
        money("l_extendedprice").alias("price"), "l_returnflag", "l_linestatus",
    )
    # an order has few lines of one supplier and month, so combining them before a shuffle gains nothing; lines of a
    # supplier and month meet once, for the orders and for the sums that follow
    return lines.repartition("l_suppkey", "month").groupBy("l_suppkey", "month", "l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") != "A", F.col("price"))).alias("gmv"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("price"))).alias("cash"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"),
        F.max((F.col("l_linestatus") == "F").cast("int")).alias("settled"),
    )


def merchant_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month x merchant staging rows: one merchant per supplier, months by ship date.

    GMV counts lines which are not returned as 'A', cash counts settled lines; either is NULL in a
    month without such lines. Merchants with a negative balance are unresolved.
    """
    months = _merchant_lines(spark, sf_dir).groupBy("l_suppkey", "month").agg(
        F.sum("gmv").cast("decimal(18,2)").alias("gmv"),
        F.sum("cash").cast("decimal(18,2)").alias("cash_sales_amount"),
        F.count("*").alias("order_count"),
        F.nullif(F.count_if(F.col("returned") == 1), F.lit(0)).alias("aftersales_order_count"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey",
        F.col("s_name").alias("merchant_name_raw"),
        F.when(F.col("s_acctbal") < 0, "UNRESOLVED").otherwise("ID_MATCHED").alias("mapping_status"),
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("owner"))
    joined = months.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "month",
        F.concat(F.lit("ID:"), F.col("l_suppkey").cast("string")).alias("merchant_key"),
        "merchant_name_raw", "owner", "mapping_status", F.lit("CURRENT").alias("coverage_status"),
        "gmv", "cash_sales_amount", "order_count", "aftersales_order_count",
        (F.col("aftersales_order_count").cast("double") / F.col("order_count").cast("double")).alias(
            "aftersales_rate"
        ),
    )


def merchant_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three exports a staging job starts from: cash by name, GMV by id, after-sales by id.

    Suppliers with a negative balance have no id in the GMV and after-sales exports.
    """
    # all three are sums of the same small rows, one for each merchant and month: written once
    by_month = _merchant_lines(spark, sf_dir).groupBy("l_suppkey", "month").agg(
        F.sum(F.when(F.col("settled") == 1, F.col("cash"))).alias("cash"),
        F.count_if(F.col("settled") == 1).alias("settled"),
        F.sum("gmv").alias("gmv"),
        F.count_if(F.col("returned") == 1).alias("returned"),
        F.count("*").alias("orders"),
    )
    rows = written(
        by_month.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("l_suppkey", "month", "s_name", "n_name", "s_acctbal", "cash", "settled", "gmv", "returned", "orders")
    )
    month = F.date_format("month", "yyyy-MM").alias("month")
    cash = (
        rows.where(F.col("settled") > 0)
        .groupBy("s_name", "n_name", "month")
        .agg(F.sum("cash").cast("decimal(18,2)").alias("cash_sales_amount"), F.sum("settled").alias("order_count"))
        .select(
            month, F.col("s_name").alias("name"), "cash_sales_amount", "order_count",
            F.col("n_name").alias("owner"),
        )
    )
    known = rows.where(F.col("s_acctbal") >= 0)
    by_id = F.col("l_suppkey").cast("string").alias("raw_id")
    gmv = (
        known.groupBy("l_suppkey", "s_name", "n_name", "month")
        .agg(F.sum("gmv").cast("decimal(18,2)").alias("gmv"))
        .where(F.col("gmv").isNotNull())
        .select(
            month, by_id, F.col("s_name").alias("name"), "gmv",
            F.col("n_name").alias("region"), F.col("n_name").alias("owner"),
        )
    )
    after = (
        known.groupBy("l_suppkey", "s_name", "n_name", "month")
        .agg(F.sum("returned").alias("returned"), F.sum("orders").alias("orders"))
        .where(F.col("returned") > 0)
        .select(
            month, by_id, F.col("s_name").alias("name"),
            F.col("returned").alias("aftersales_order_count"),
            (F.col("returned").cast("double") / F.col("orders").cast("double")).alias("aftersales_rate"),
            F.col("n_name").alias("region"), F.col("n_name").alias("owner"),
        )
    )
    return cash, gmv, after


def wide_gmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GMV export in its wide form: one column ``aYYYYMM`` for each month that has data."""
    _, gmv, _ = merchant_sources(spark, sf_dir)
    months = sorted(r[0] for r in gmv.select("month").distinct().collect())  # as many as the calendar has
    wide = gmv.groupBy("raw_id", "name").pivot("month", months).agg(F.first("gmv"))
    return wide.select(
        "raw_id", "name", *[F.col(f"`{m}`").alias(f"a{m.replace('-', '')}") for m in months]
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed order lines: merchant = region of the supplier, dates by ship date.

    Five merchants hold all lines, so every merchant is a hot key. Lines meet the large tables while they are
    narrow and orders last, by the id they leave with, so that work on orders finds them together. Suppliers,
    nations and regions come one by one: the size of their join is not known before it has run.
    """
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey is not null").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        F.col("l_shipdate").cast("date").alias("order_date"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        money("l_extendedprice").alias("purchase_amount"),
        "l_returnflag", "l_linestatus",
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = (
        table(spark, sf_dir, "orders").where("o_orderkey is not null")
        .select(
            F.coalesce(F.col("o_orderkey").cast("string"), F.lit("")).alias("_order"),
            "o_custkey", "o_orderstatus", "o_orderpriority",
        )
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("maker"))
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("merchant_key"))
    cents = (F.col("purchase_amount") * 100).cast("bigint")
    # as text only after the first shuffle; never NULL, which an inner join makes sure of and the schema now says
    order_id = F.coalesce(F.col("l_orderkey").cast("string"), F.lit(""))
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("order_id", order_id)
        .join(orders, F.col("order_id") == F.col("_order"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "merchant_key",
            "order_date",
            "order_id",
            F.col("o_custkey").cast("string").alias("customer_key"),
            F.col("c_name").alias("customer_name"),
            F.col("l_partkey").cast("string").alias("product_key"),
            F.col("p_brand").alias("product_code"),
            F.col("p_name").alias("product_name"),
            F.col("maker").alias("manufacturer_raw"),
            F.col("p_size").cast("string").alias("specification_raw"),
            F.col("qty").cast("decimal(18,2)").alias("quantity"),
            (F.call_function("div", cents, F.col("qty")).cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)"))
            .cast("decimal(18,2)")
            .alias("unit_purchase_price"),
            "purchase_amount",
            F.when(F.col("o_orderstatus") == "F", "交易完成")
            .when(F.col("o_orderstatus") == "O", "待收货")
            .alias("order_status_raw"),
            F.when(F.col("l_returnflag") == "R", "已退款")
            .when(F.col("l_returnflag") == "N", "配送完成")
            .otherwise("A")
            .alias("processing_status_raw"),
            F.lit(None).cast("string").alias("processing_remark_raw"),
            F.when(F.col("l_linestatus") == "F", "已结算").otherwise("未结算").alias("settlement_status_raw"),
            F.col("o_orderpriority").alias("order_type_raw"),
            F.col("c_mktsegment").alias("activity_type"),
            F.col("p_brand").alias("activity_id"),
        )
    )


def merchant_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily traffic of each merchant by metric: the events of its users against those of all others.

    A user belongs to the merchant whose number is the rest of the user's id divided by five.
    """
    daily = table(spark, sf_dir, "events").groupBy(
        F.col("ts").cast("date").alias("day"), F.col("event_type").alias("metric"), (F.col("user_id") % 5).alias("k")
    ).agg(F.count("*").alias("n"))
    total = daily.groupBy("day", "metric").agg(F.sum("n").alias("total"))
    merchants = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("merchant_key"))
    cells = total.withColumn("_m", merchants.agg(F.collect_list(F.struct("k", "merchant_key"))).scalar()).select("day", "metric", "total", F.inline("_m"))
    own = F.coalesce("n", F.lit(0))
    return cells.join(daily, ["day", "metric", "k"], "left").select("merchant_key", "day", "metric", own.alias("own"), (F.col("total") - own).alias("peer"))


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily traffic by metric: events of user 0 against the events of all other users."""
    events = table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("day"), F.col("event_type").alias("metric"), "user_id"
    )
    return events.groupBy("day", "metric").agg(
        F.count_if(F.col("user_id") == 0).alias("own"),
        F.count_if(F.col("user_id") != 0).alias("peer"),
    )
