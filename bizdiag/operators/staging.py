"""Merchant-month staging: three monthly exports become one covered grid with explicit gaps."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizdiag.functions.cleaning import name_col, provided
from bizdiag.functions.lineage import written
from bizdiag.functions.ordering import with_ranks

METRICS = ("cash_sales_amount", "gmv", "order_count", "aftersales_order_count", "aftersales_rate")


def unpivot_months(df: DataFrame, ids: list[str], value: str = "gmv") -> DataFrame:
    """Columns ``aYYYYMM`` as rows of (ids, month ``yyyy-MM``, value); NULL cells are dropped."""
    months = [c for c in df.columns if re.fullmatch(r"a\d{4}(0[1-9]|1[0-2])", c)]
    if not months:
        raise ValueError("no month columns")
    long = df.select(*ids, *months).unpivot(ids, months, "header", value)
    return long.where(F.col(value).isNotNull()).select(
        *ids,
        F.concat(F.substring("header", 2, 4), F.lit("-"), F.substring("header", 6, 2)).alias("month"),
        value,
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys which occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def require_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The same rows; a duplicate key fails the job that reads them.

    The check is one aggregate evaluated inside the plan, so nothing is collected here.
    """
    worst = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    ok = F.coalesce(worst, F.lit(0)) <= 1
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"duplicate key in {name}: {keys}"))))


def has_key(source: str) -> Column:
    """Whether a row of a source can be placed: a month, and an id (``cash``: a name)."""
    filled = lambda c: provided(F.col(c))
    key = F.coalesce(name_col(F.col("name")) != "", F.lit(False)) if source == "cash" else filled("raw_id")
    return key & filled("month")


def keyless_rows(cash: DataFrame, gmv: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of each source that the staging skips, as (source, row_count, skipped)."""
    parts = [
        df.agg(F.count("*").alias("row_count"), F.count_if(~has_key(s)).alias("skipped")).select(F.lit(s).alias("source"), "row_count", "skipped")
        for s, df in (("cash", cash), ("gmv", gmv), ("after", after))
    ]
    return reduce(DataFrame.unionByName, parts)


def _keyed(cash: DataFrame, gmv: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sources with merchant keys: ``ID:x`` where an id is known, else ``NAME:n``; rows without a key or month are left out."""
    cash, gmv, after = cash.where(has_key("cash")), gmv.where(has_key("gmv")), after.where(has_key("after"))
    ids = (
        gmv.select(name_col(F.col("name")).alias("nname"), "raw_id")
        .groupBy("nname")
        .agg(F.min("raw_id").alias("low"), F.max("raw_id").alias("high"))
        .where((F.col("low") == F.col("high")) & (F.col("nname") != ""))
        .select(F.col("nname").alias("match_name"), F.col("low").alias("match_id"))
    )
    named = cash.withColumn("nname", name_col(F.col("name")))
    cash = named.join(ids, F.col("nname") == F.col("match_name"), "left").withColumn(
        "merchant_key",
        F.coalesce(
            F.concat(F.lit("ID:"), F.col("match_id")), F.concat(F.lit("NAME:"), F.col("nname"))
        ),
    )
    by_id = F.concat(F.lit("ID:"), F.col("raw_id"))
    return cash, gmv.withColumn("merchant_key", by_id), after.withColumn("merchant_key", by_id)


def crosswalk(cash: DataFrame, gmv: DataFrame, after: DataFrame) -> DataFrame:
    """One row per merchant: id, name, months seen and how it was matched."""
    cash, gmv, after = _keyed(cash, gmv, after)
    return _crosswalk(cash, gmv, after)


def _crosswalk(cash: DataFrame, gmv: DataFrame, after: DataFrame) -> DataFrame:
    parts = (
        (1, cash, F.col("match_id"), F.when(F.col("match_id").isNotNull(), "NAME_MATCHED").otherwise("UNRESOLVED")),
        (2, gmv, F.col("raw_id"), F.lit("ID_MATCHED")),
        (3, after, F.col("raw_id"), F.lit("ID_MATCHED")),
    )
    seen = reduce(
        DataFrame.unionByName,
        [
            df.select(
                "merchant_key", "month", "name", raw.alias("raw_id"), status.alias("status"),
                F.lit(order).alias("source"),
            )
            for order, df, raw, status in parts
        ],
    )
    at = F.struct("source", "month", "name")
    return (
        seen.groupBy("merchant_key")
        .agg(
            F.max("raw_id").alias("merchant_id_raw"),
            F.min_by("name", F.when(F.col("name") != "", at)).alias("merchant_name_raw"),
            F.min("month").alias("first_seen_month"),
            F.max("month").alias("last_seen_month"),
            F.min_by("status", at).alias("mapping_status"),
        )
        .select(
            "merchant_key", "merchant_id_raw", "merchant_name_raw",
            name_col(F.col("merchant_name_raw")).alias("merchant_name_normalized"),
            "first_seen_month", "last_seen_month",
            F.when(F.col("merchant_id_raw").isNotNull(), "ID_MATCHED").otherwise("NAME_MATCHED").alias("mapping_method"),
            "mapping_status",
        )
    )


def merchant_month(cash: DataFrame, gmv: DataFrame, after: DataFrame) -> DataFrame:
    """Coverage grid: every merchant in every month any source covers.

    Each merchant row is expanded to the (few hundred) months where it lives; the three sources are
    joined on (merchant, month).
    """
    # each export is read for its checks, the crosswalk, the months and the grid: written once
    cash, gmv, after = (written(df) for df in _keyed(written(cash), written(gmv), after))
    cash = require_unique(cash, ["month", "nname"], "cash")
    gmv = require_unique(gmv, ["month", "raw_id"], "gmv")
    after = require_unique(after, ["month", "raw_id"], "after-sales")
    merchants = _crosswalk(cash, gmv, after)
    all_months = (
        cash.select("month").unionByName(gmv.select("month")).unionByName(after.select("month"))
        .agg(F.array_sort(F.collect_set("month")))
        .scalar()
    )
    grid = merchants.withColumn("_months", all_months).withColumn("month", F.explode("_months"))

    def side(df: DataFrame, tag: str, *columns: str) -> DataFrame:
        has = [c for c in (*columns, "source_file", "source_sheet", "source_version") if c in df.columns]
        return df.select(
            "merchant_key", "month", F.lit(True).alias(f"{tag}_seen"),
            *[F.col(c).alias(f"{tag}_{c}") for c in has],
        )

    key = ["merchant_key", "month"]
    rows = (
        grid.join(side(cash, "c", "name", "owner", "cash_sales_amount", "order_count"), key, "left")
        .join(side(gmv, "g", "name", "owner", "region", "gmv"), key, "left")
        .join(side(after, "a", "name", "owner", "region", "aftersales_order_count", "aftersales_rate"), key, "left")
    )
    seen = {t: F.coalesce(F.col(f"{t}_seen"), F.lit(False)) for t in "cga"}
    last = F.array_max("_months")
    status = (
        F.when(F.col("mapping_status") == "UNRESOLVED", "UNRESOLVED")
        .when(F.col("month") == F.col("first_seen_month"), "NEW")
        .when((F.col("month") == F.col("last_seen_month")) & (F.col("last_seen_month") < last), "LOST")
        .when(seen["c"] | seen["g"] | seen["a"], "CURRENT")
        .otherwise("MISSING")
    )

    def first_present(column: str, sources: str, otherwise: Column) -> Column:
        out = otherwise
        for t in reversed(sources):
            if f"{t}_{column}" in rows.columns:
                out = F.when(seen[t], F.col(f"{t}_{column}")).otherwise(out)
        return out

    def lineage(column: str) -> Column:
        cells = [F.col(f"{t}_{column}") for t in "cga" if f"{t}_{column}" in rows.columns]
        if not cells:
            return F.lit("")
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*cells)))), " | ")

    staged = rows.select(
        "month", "merchant_key", "merchant_id_raw",
        first_present("name", "cga", F.col("merchant_name_raw")).alias("merchant_name_raw"),
        "merchant_name_normalized",
        first_present("region", "ga", F.lit("")).alias("region"),
        first_present("owner", "cga", F.lit("")).alias("owner"),
        F.col("c_cash_sales_amount").alias("cash_sales_amount"),
        F.col("g_gmv").alias("gmv"),
        F.col("c_order_count").alias("order_count"),
        F.col("a_aftersales_order_count").alias("aftersales_order_count"),
        F.col("a_aftersales_rate").alias("aftersales_rate"),
        lineage("source_file").alias("source_file"),
        lineage("source_sheet").alias("source_sheet"),
        lineage("source_version").alias("source_version"),
        "mapping_status", status.alias("coverage_status"),
    )
    return staged


def month_before(month: Column) -> Column:
    """The calendar month before a ``yyyy-MM`` text."""
    first = F.to_date(F.concat(month, F.lit("-01")))
    return F.date_format(F.add_months(first, -1), "yyyy-MM")


def with_month_on_month(staged: DataFrame) -> DataFrame:
    """Add ``mom_cash_sales`` and ``mom_gmv``; NULL when a side is missing or the prior is 0."""
    by_merchant = Window.partitionBy("merchant_key").orderBy("month")
    adjacent = F.lag("month").over(by_merchant) == month_before(F.col("month"))
    out = staged
    for metric, name in (("cash_sales_amount", "mom_cash_sales"), ("gmv", "mom_gmv")):
        prior = F.when(adjacent, F.lag(metric).over(by_merchant))
        out = out.withColumn(name, rate(F.col(metric), prior))
    return out


def rate(current: Column, prior: Column) -> Column:
    """current / prior - 1 as a double; NULL when unknown or the prior is 0."""
    base = F.nullif(prior.cast("double"), F.lit(0.0))
    return current.cast("double") / base - 1


def with_staging_ranks(staged: DataFrame) -> DataFrame:
    """Add each merchant's rank of the month by cash and by GMV; NULL values are not ranked."""
    ranks = {"cash_sales_amount": ("merchant_rank_cash_sales", None), "gmv": ("merchant_rank_gmv", None)}
    return with_ranks(staged, ["month"], ranks)


def reconcile(cash: DataFrame, gmv: DataFrame, after: DataFrame, staged: DataFrame) -> DataFrame:
    """Per month and metric: source total, staging total, difference and its rate."""
    def long(df: DataFrame, *columns: str) -> DataFrame:
        cells = [
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("decimal(22,2)").alias("v")) for c in columns
        ]
        return df.select("month", F.inline(F.array(*cells)))

    source = (
        long(cash, "cash_sales_amount", "order_count")
        .unionByName(long(gmv, "gmv"))
        .unionByName(long(after, "aftersales_order_count"))
        .withColumn("side", F.lit("source"))
    )
    kept = long(staged, "cash_sales_amount", "order_count", "gmv", "aftersales_order_count")
    both = source.unionByName(kept.withColumn("side", F.lit("staging")))
    zero = F.lit(0).cast("decimal(22,2)")
    totals = both.groupBy("month", "metric").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("side") == s, F.col("v"))), zero).cast("decimal(24,2)").alias(f"{s}_total")
            for s in ("source", "staging")
        ]
    )
    gap = (F.col("staging_total") - F.col("source_total")).cast("decimal(24,2)")
    return totals.select(
        "month", "metric", "source_total", "staging_total",
        gap.alias("absolute_difference"),
        (gap.cast("double") / F.nullif(F.col("source_total").cast("double"), F.lit(0.0))).alias("difference_rate"),
    )


def coverage(staged: DataFrame) -> DataFrame:
    """Non-NULL rows per metric."""
    counts = staged.agg(F.count("*").alias("total"), *[F.count(m).alias(m) for m in METRICS])
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("non_null_rows")) for m in METRICS]
    return counts.select(F.inline(F.array(*cells)), F.col("total").alias("total_rows")).withColumn(
        "non_null_rate", F.col("non_null_rows") / F.nullif(F.col("total_rows"), F.lit(0))
    )


def mapping_summary(merchants: DataFrame) -> DataFrame:
    """Merchants per mapping status, and the share matched."""
    count = lambda s: F.count_if(F.col("mapping_status") == s)
    return merchants.agg(
        F.count("*").alias("merchants"), count("ID_MATCHED").alias("id_matched"),
        count("NAME_MATCHED").alias("name_matched"), count("UNRESOLVED").alias("unresolved"),
    ).withColumn(
        "success_rate",
        (F.col("id_matched") + F.col("name_matched")) / F.nullif(F.col("merchants"), F.lit(0)),
    )
