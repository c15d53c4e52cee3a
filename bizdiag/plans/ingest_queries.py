"""Registered queries on sources, mapping, cleaning, quality checks and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizdiag.functions import cleaning
from bizdiag.functions.lineage import new_folder
from bizdiag.operators import mapping, orders, profile, quality
from bizdiag.plans import imports
from bizdiag.plans.edge import edge
from bizdiag.plans.oracle import CTES, sql
from bizdiag.schema import COLUMNS, COUNTS, DIMENSIONS
from bizdiag.sources import files, tables
from bizdiag.sources.adapters import daily_fact, order_items, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    """Register a query and, when there is one, its SQL."""
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle)
        return f
    return add


def folder(spark) -> str:
    """A new folder for tables a query writes."""
    return new_folder(spark, "tables")


# ------------------------------------------------------------------ a raw export derived from the orders
def raw_export(spark, sf):
    """One text row per order with the usual dirt: mixed dates, serials, signs, blanks, bad cells."""
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey")
    cents = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    return o.select(
        k.cast("string").alias("row_id"),
        F.when(k % 97 == 5, "无效日期").when(k % 11 == 1, F.date_format(day, "M/d/yyyy HH:mm")).when(k % 11 == 2, F.date_format(day, "MMMM d, yyyy"))
        .when(k % 11 == 3, F.date_format(day, "d-MMM-yyyy")).when(k % 5 == 1, F.date_format(day, "yyyy/MM/dd")).when(k % 5 == 2, serial)
        .when(k % 5 == 3, F.concat(F.lit(" "), F.date_format(day, "yyyyMMdd"))).when(k % 5 == 4, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:30:00")))
        .otherwise(F.date_format(day, "yyyy-MM-dd")).alias("日期"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "  ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" \u00a0\u3000"))).alias("渠道"),
        F.when(k % 89 == 3, "1.5").when(k % 83 == 2, "n/a").when(k % 7 == 0, F.concat((F.col("o_custkey") + 1000).cast("string"), F.lit(".0")))
        .when(k % 79 == 1, "-3").otherwise(F.col("o_custkey").cast("string")).alias("线索数"),
        (F.col("o_custkey") + F.when(k % 73 == 4, 5).otherwise(-1)).cast("string").alias("有效"),
        F.when(k % 71 == 6, "inf").when(k % 61 == 9, "1e30").when(k % 3 == 0, F.concat(F.lit("¥"), cents)).when(k % 67 == 8, "").otherwise(cents).alias("金额"),
        F.col("o_orderstatus").alias("未用"),
    )


FIELDS = {"date": "日期", "channel": "渠道", "leads": "线索数", "valid_leads": "有效", "gross_revenue": "金额"}

CTES["raw_cells"] = """
SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderpriority, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
  CASE WHEN o_orderkey % 89 = 3 THEN 'split' WHEN o_orderkey % 83 = 2 THEN 'bad' ELSE 'ok' END AS leads_state,
  CASE WHEN o_orderkey % 71 = 6 OR o_orderkey % 61 = 9 THEN 'bad' WHEN o_orderkey % 3 = 0 THEN 'ok' WHEN o_orderkey % 67 = 8 THEN 'blank' ELSE 'ok' END AS price_state FROM orders
"""
CTES["raw_clean"] = """
SELECT k, CASE WHEN k % 97 <> 5 THEN day END AS date, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS channel,
  CASE WHEN leads_state = 'ok' THEN CASE WHEN k % 7 = 0 THEN o_custkey + 1000 WHEN k % 79 = 1 THEN -3 ELSE o_custkey END END AS leads,
  o_custkey + CASE WHEN k % 73 = 4 THEN 5 ELSE -1 END AS valid_leads, CASE WHEN price_state = 'ok' THEN price END AS gross_revenue, leads_state, price_state FROM raw_cells
"""


def standardised(spark, sf, once=False):
    """The export mapped and standardised; written ``once`` for queries that read it in several steps."""
    return mapping.standardise(mapping.apply_mapping(raw_export(spark, sf), FIELDS, keep=["row_id"]), "row_id", once)


# ------------------------------------------------------------------ sources and sinks
@query("source_csv_scan", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS o_totalprice FROM orders")
def _(spark, sf):
    path = folder(spark)
    o = table(spark, sf, "orders")
    priority = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "N/A").otherwise(F.col("o_orderpriority"))
    o.select("o_orderkey", priority.alias("o_orderpriority"), F.col("o_totalprice").cast("decimal(18,2)")).write.option("header", True).csv(path)
    df = files.scan_csv(spark, path)
    return df.select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("source_csv_any_encoding", "SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE o_orderstatus WHEN 'F' THEN '交易完成' WHEN 'O' THEN '待收货' ELSE '其他,状态' END AS state FROM orders")
def _(spark, sf):
    path = folder(spark)
    state = F.when(F.col("o_orderstatus") == "F", "交易完成").when(F.col("o_orderstatus") == "O", "待收货").otherwise("其他,状态")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), state.alias("state"))
    rows.where("k % 2 = 0").write.option("header", True).csv(f"{path}/utf8")
    # Spark writes no GB18030: its bytes go out one by one, as ISO-8859-1 characters
    bytewise = F.pandas_udf(lambda s: s.map(lambda t: t.encode("gb18030").decode("latin-1")), "string")
    odd = rows.where("k % 2 = 1").select("k", bytewise("state").alias("state"))
    odd.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/gb18030")
    return files.scan_csv_any_encoding(spark, f"{path}/*").select("k", "state")


@query("source_csv_line_breaks", "SELECT CAST(p_partkey AS VARCHAR) AS k, p_name || CHR(10) || 'made by \"' || p_brand || '\"' AS note FROM part")
def _(spark, sf):
    path = folder(spark)
    note = F.concat("p_name", F.lit('\nmade by "'), "p_brand", F.lit('"'))
    table(spark, sf, "part").select(F.col("p_partkey").alias("k"), note.alias("note")).write.option("header", True).option("escape", '"').csv(path)
    return files.scan_csv(spark, path, multiline=True)


@query("source_preview", "SELECT 7 AS row_count, TRUE AS known FROM (SELECT 1) AS t")
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    first = files.preview(lines, 7)
    found = first.join(lines.distinct(), list(first.columns), "left_semi")
    return found.agg(F.count("*").cast("int").alias("row_count"), F.lit(True).alias("known"))


@query("source_summary", "SELECT COUNT(*) AS row_count, CAST(6 AS BIGINT) AS column_count, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns FROM orders")
def _(spark, sf):
    return edge(files.summarise(table(spark, sf, "orders")))


def published(spark, sf):
    """The fact, checked and published as a new version; its folder."""
    path = folder(spark)
    imports.publish(mapping.standardise(daily_fact(spark, sf), once=True), path, {c: c for c in COLUMNS})
    return path


@query(
    "source_published_fact",
    "SELECT CAST(date AS VARCHAR) AS date, business_line, product, channel, region, team, salesperson, impressions, leads, valid_leads, contacted_leads, followed_leads, paid_users, paid_orders, CAST(gross_revenue AS DOUBLE) AS gross_revenue, refund_users, refund_orders, CAST(refund_amount AS DOUBLE) AS refund_amount FROM f_daily",
)
def _(spark, sf):
    return edge(tables.read_fact(spark, published(spark, sf)))


@query(
    "source_fact_of_a_quarter",
    "SELECT CAST(date AS VARCHAR) AS date, product, channel, salesperson, leads, CAST(gross_revenue AS DOUBLE) AS gross_revenue FROM f_daily WHERE date BETWEEN DATE '1997-02-10' AND DATE '1997-05-09'",
)
def _(spark, sf):
    fact = tables.read_fact(spark, published(spark, sf), start="1997-02-10", end="1997-05-09")
    return edge(fact, "date", "product", "channel", "salesperson", "leads", "gross_revenue")


@query(
    "source_metadata_and_availability",
    "SELECT 'current' AS dataset_id, (SELECT COUNT(*) FROM f_daily) AS row_count, f.x AS canonical_field, TRUE AS is_available, f.x AS source_field FROM (SELECT UNNEST(["
    + ", ".join(f"'{c}'" for c in COLUMNS) + "]) AS x) AS f",
)
def _(spark, sf):
    path = published(spark, sf)
    meta = tables.metadata(spark, path).select("dataset_id", "row_count")
    return edge(tables.availability(spark, path).join(meta, "dataset_id"), "dataset_id", "row_count", "canonical_field", "is_available", "source_field")


@query(
    "source_checked_staging_scan",
    "SELECT CAST(month AS VARCHAR) AS month, merchant_key, merchant_name_raw, mapping_status FROM m_months",
)
def _(spark, sf):
    from bizdiag.sources.adapters import merchant_month

    df = merchant_month(spark, sf)
    needed = ("month", "merchant_key", "merchant_name_raw", "mapping_status", "coverage_status")
    return edge(tables.scan_checked(df, needed, ("month", "merchant_key"), "staging"), *needed[:4])


@query("source_mart_write_and_read", "SELECT CAST(month AS VARCHAR) AS month, merchant_key, CAST(gmv AS DOUBLE) AS gmv FROM m_months")
def _(spark, sf):
    from bizdiag.sources.adapters import merchant_month

    path = folder(spark)
    tables.write_mart(merchant_month(spark, sf).select("month", "merchant_key", "gmv"), path, ["month"])
    return edge(spark.read.parquet(path))


# ------------------------------------------------------------------ mapping and cleaning
@query(
    "mapping_apply",
    """SELECT CAST(k AS VARCHAR) AS row_id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '  ' ELSE ' ' || o_orderpriority || ' ' || CHR(160) || CHR(12288) END AS channel,
  CAST(o_custkey + CASE WHEN k % 73 = 4 THEN 5 ELSE -1 END AS VARCHAR) AS valid_leads,
  CASE WHEN k % 97 = 5 THEN '无效日期' WHEN k % 11 = 1 THEN STRFTIME(day, '%-m/%-d/%Y 00:00') WHEN k % 11 = 2 THEN STRFTIME(day, '%B %-d, %Y') WHEN k % 11 = 3 THEN STRFTIME(day, '%-d-%b-%Y')
    WHEN k % 5 = 1 THEN STRFTIME(day, '%Y/%m/%d') WHEN k % 5 = 2 THEN CAST(DATE_DIFF('day', DATE '1899-12-30', day) AS VARCHAR) WHEN k % 5 = 3 THEN STRFTIME(day, ' %Y%m%d')
    WHEN k % 5 = 4 THEN STRFTIME(day, '%Y-%m-%d 10:30:00') ELSE STRFTIME(day, '%Y-%m-%d') END AS date,
  CASE WHEN k % 89 = 3 THEN '1.5' WHEN k % 83 = 2 THEN 'n/a' WHEN k % 7 = 0 THEN CAST(o_custkey + 1000 AS VARCHAR) || '.0' WHEN k % 79 = 1 THEN '-3' ELSE CAST(o_custkey AS VARCHAR) END AS leads,
  CASE WHEN k % 71 = 6 THEN 'inf' WHEN k % 61 = 9 THEN '1e30' WHEN k % 3 = 0 THEN '¥' || CAST(price AS VARCHAR) WHEN k % 67 = 8 THEN '' ELSE CAST(price AS VARCHAR) END AS gross_revenue FROM raw_cells""",
)
def _(spark, sf):
    return mapping.apply_mapping(raw_export(spark, sf), FIELDS, keep=["row_id"])


@query(
    "standardise_export",
    "SELECT CAST(k AS VARCHAR) AS row_id, CAST(date AS VARCHAR) AS date, channel, CAST(leads AS BIGINT) AS leads, CAST(valid_leads AS BIGINT) AS valid_leads, CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(NULL AS VARCHAR) AS team, CAST(NULL AS BIGINT) AS impressions FROM raw_clean",
)
def _(spark, sf):
    return edge(standardised(spark, sf).frame, "row_id", "date", "channel", "leads", "valid_leads", "gross_revenue", "team", "impressions")


_issues = """SELECT 'invalid_date' AS code, 'date' AS field, COUNT(*) AS affected_count FROM raw_clean WHERE date IS NULL HAVING COUNT(*) > 0
UNION ALL SELECT 'invalid_numeric', 'leads', COUNT(*) FROM raw_clean WHERE leads_state = 'bad' HAVING COUNT(*) > 0
UNION ALL SELECT 'non_integer_count', 'leads', COUNT(*) FROM raw_clean WHERE leads_state = 'split' HAVING COUNT(*) > 0
UNION ALL SELECT 'invalid_numeric', 'gross_revenue', COUNT(*) FROM raw_clean WHERE price_state = 'bad' HAVING COUNT(*) > 0"""


@query("normalisation_issues", _issues)
def _(spark, sf):
    return edge(mapping.normalisation_issues(standardised(spark, sf)), "code", "field", "affected_count")


@query(
    "clean_identifiers_and_names",
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '00' || CAST(s_suppkey AS VARCHAR) END AS identifier,
  LOWER(s_name) AS name, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS number, CASE WHEN s_nationkey < 9 THEN '2024-0' || CAST(s_nationkey + 1 AS VARCHAR) ELSE NULL END AS month FROM supplier""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    dirty = s.select(
        k.cast("string").alias("id"),
        F.when(k % 2 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(".0 "))).otherwise(F.concat(F.lit("00"), k.cast("string"))).alias("i"),
        F.concat(F.lit("\u3000"), F.substring("s_name", 1, 9), F.lit("\u00a0"), F.substring("s_name", 10, 99), F.when(k % 3 == 0, "有限公司").otherwise("")).alias("n"),
        F.format_number("s_acctbal", 2).alias("v"),
        F.when(F.col("s_nationkey") < 9, F.concat(F.lit("账期2024/0"), (F.col("s_nationkey") + 1).cast("string"), F.lit("月"))).otherwise("无").alias("m"),
    )
    return dirty.select(
        "id", cleaning.identifier_col(F.col("i")).alias("identifier"), cleaning.name_col(F.col("n")).alias("name"),
        cleaning.lenient_number_col(F.col("v")).alias("number"), cleaning.month_col(F.col("m")).alias("month"),
    )


@query("clean_trim_all", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias(" c_custkey "), F.concat(F.lit("  "), F.col("c_name")).alias("c_name"),
        F.concat(F.col("c_mktsegment"), F.lit(" \t")).alias("c_mktsegment "),
    )
    return cleaning.trim_all(c)


@query(
    "clean_order_item_typing",
    """SELECT merchant_key, COUNT(*) AS line_count, COUNT(order_status_raw) AS with_status, CAST(SUM(purchase_amount) AS DOUBLE) AS amount, CAST(SUM(quantity) AS DOUBLE) AS quantity, CAST(MIN(order_date) AS VARCHAR) AS first_day,
  COUNT(DISTINCT product_key) AS products FROM i_lines GROUP BY 1""",
)
def _(spark, sf):
    back = {v: k for k, v in orders.SOURCE_COLUMNS.items()}
    items = order_items(spark, sf).withColumn("order_number", F.col("order_id"))
    raw = items.select(
        "merchant_key",
        *[
            (
                F.date_format(c, "yyyy/MM/dd HH:mm:ss") if c == "order_date"
                else F.concat(F.lit(" "), F.col(c), F.lit(".0")) if c in ("order_id", "product_key")
                else F.coalesce(F.col(c).cast("string"), F.lit(" "))
            ).alias(back[c])
            for c in back
        ],
    )
    df = orders.type_order_items(raw)
    return edge(
        df.groupBy("merchant_key").agg(
            F.count("*").alias("line_count"), F.count("order_status_raw").alias("with_status"), F.sum("purchase_amount").alias("amount"),
            F.sum("quantity").alias("quantity"), F.min("order_date").alias("first_day"), F.countDistinct("product_key").alias("products"),
        )
    )


# ------------------------------------------------------------------ quality
_unmapped = [c for c in COLUMNS if c not in FIELDS]
_checks = f"""{_issues.replace("AS affected_count", "AS affected_count, 'ERROR' AS severity").replace("COUNT(*) FROM", "COUNT(*), 'ERROR' FROM")}
UNION ALL SELECT 'unmapped_optional_field', f.x, (SELECT COUNT(*) FROM orders), 'WARNING' FROM (SELECT UNNEST([{', '.join(f"'{c}'" for c in _unmapped)}]) AS x) AS f
""" + "".join(
    f"""UNION ALL SELECT 'mapped_field_nulls', '{c}', COUNT(*) FILTER (WHERE {c} IS NULL), 'WARNING' FROM raw_clean HAVING COUNT(*) FILTER (WHERE {c} IS NULL) > 0
UNION ALL SELECT 'missing_ratio_exceeded', '{c}', COUNT(*) FILTER (WHERE {c} IS NULL), 'WARNING' FROM raw_clean HAVING COUNT(*) FILTER (WHERE {c} IS NULL) > 0.05 * COUNT(*)
"""
    for c in FIELDS
) + "".join(
    f"UNION ALL SELECT 'negative_value', '{c}', COUNT(*) FILTER (WHERE {c} < 0), 'WARNING' FROM raw_clean HAVING COUNT(*) FILTER (WHERE {c} < 0) > 0\n"
    for c in ("leads", "valid_leads", "gross_revenue")
) + """UNION ALL SELECT 'leads_gte_valid_leads', 'valid_leads', COUNT(*) FILTER (WHERE valid_leads > leads), 'WARNING' FROM raw_clean HAVING COUNT(*) FILTER (WHERE valid_leads > leads) > 0
UNION ALL SELECT 'duplicate_canonical_grain', NULL, CAST(SUM(n) AS BIGINT), 'ERROR' FROM (SELECT date, channel, COUNT(*) AS n FROM raw_clean GROUP BY 1, 2 HAVING COUNT(*) > 1) AS d HAVING SUM(n) > 0"""


@query("quality_issues", f"SELECT code, field, affected_count, severity FROM ({_checks}) AS u")
def _(spark, sf):
    return edge(quality.quality_issues(standardised(spark, sf, once=True)), "code", "field", "affected_count", "severity")


@query(
    "quality_report",
    f"""SELECT COUNT(*) FILTER (WHERE severity = 'ERROR') = 0 AS is_valid, COUNT(*) FILTER (WHERE severity = 'ERROR') AS blocking_count, COUNT(*) FILTER (WHERE severity = 'WARNING') AS warning_count,
  CAST(0 AS BIGINT) AS info_count, (SELECT COUNT(*) FROM orders) AS row_count FROM ({_checks}) AS u""",
)
def _(spark, sf):
    return edge(quality.quality_report(standardised(spark, sf, once=True)))


@query("quality_duplicate_grain", "SELECT CAST(date AS VARCHAR) AS date, channel, COUNT(*) AS row_count FROM raw_clean GROUP BY 1, 2 HAVING COUNT(*) > 1")
def _(spark, sf):
    return edge(quality.duplicate_groups(standardised(spark, sf)))


@query(
    "quality_column_checks_of_fact",
    "SELECT 'mapped_field_nulls' AS code, 'channel' AS field, COUNT(*) FILTER (WHERE channel IS NULL) AS affected_count FROM f_daily UNION ALL SELECT 'missing_ratio_exceeded', 'channel', COUNT(*) FILTER (WHERE channel IS NULL) FROM f_daily"
    + "".join(
        f" UNION ALL SELECT '{code}', '{c}', COUNT(*) FILTER (WHERE {c} IS NULL) FROM f_daily"
        for c in ("gross_revenue", "refund_amount") for code in ("mapped_field_nulls", "missing_ratio_exceeded")
    ),
)
def _(spark, sf):
    return edge(quality.column_checks(mapping.standardise(daily_fact(spark, sf))), "code", "field", "affected_count")


@query(
    "quality_issue_samples",
    """SELECT code, field, CAST(rn AS BIGINT) AS position, CAST(k AS VARCHAR) AS text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code, field ORDER BY k) AS rn FROM (
SELECT 'negative_value' AS code, 'leads' AS field, k FROM raw_clean WHERE leads < 0 UNION ALL SELECT 'negative_value', 'valid_leads', k FROM raw_clean WHERE valid_leads < 0
UNION ALL SELECT 'leads_gte_valid_leads', 'valid_leads', k FROM raw_clean WHERE valid_leads > leads
UNION ALL SELECT 'mapped_field_nulls', 'date', k FROM raw_clean WHERE date IS NULL UNION ALL SELECT 'mapped_field_nulls', 'channel', k FROM raw_clean WHERE channel IS NULL
UNION ALL SELECT 'mapped_field_nulls', 'leads', k FROM raw_clean WHERE leads IS NULL UNION ALL SELECT 'mapped_field_nulls', 'gross_revenue', k FROM raw_clean WHERE gross_revenue IS NULL
UNION ALL SELECT 'invalid_date', 'date', k FROM raw_clean WHERE date IS NULL UNION ALL SELECT 'invalid_numeric', 'leads', k FROM raw_clean WHERE leads_state = 'bad'
UNION ALL SELECT 'non_integer_count', 'leads', k FROM raw_clean WHERE leads_state = 'split' UNION ALL SELECT 'invalid_numeric', 'gross_revenue', k FROM raw_clean WHERE price_state = 'bad'
UNION ALL SELECT 'duplicate_canonical_grain', NULL, k FROM (SELECT k, COUNT(*) OVER (PARTITION BY date, channel) AS n FROM raw_clean) AS d WHERE n > 1
UNION ALL SELECT 'missing_ratio_exceeded', 'date', k FROM raw_clean WHERE date IS NULL AND (SELECT AVG(CASE WHEN date IS NULL THEN 1.0 ELSE 0.0 END) FROM raw_clean) > 0.05
UNION ALL SELECT 'missing_ratio_exceeded', 'channel', k FROM raw_clean WHERE channel IS NULL AND (SELECT AVG(CASE WHEN channel IS NULL THEN 1.0 ELSE 0.0 END) FROM raw_clean) > 0.05
UNION ALL SELECT 'missing_ratio_exceeded', 'leads', k FROM raw_clean WHERE leads IS NULL AND (SELECT AVG(CASE WHEN leads IS NULL THEN 1.0 ELSE 0.0 END) FROM raw_clean) > 0.05
UNION ALL SELECT 'missing_ratio_exceeded', 'valid_leads', k FROM raw_clean WHERE valid_leads IS NULL AND (SELECT AVG(CASE WHEN valid_leads IS NULL THEN 1.0 ELSE 0.0 END) FROM raw_clean) > 0.05
UNION ALL SELECT 'missing_ratio_exceeded', 'gross_revenue', k FROM raw_clean WHERE gross_revenue IS NULL AND (SELECT AVG(CASE WHEN gross_revenue IS NULL THEN 1.0 ELSE 0.0 END) FROM raw_clean) > 0.05) AS c) AS r WHERE rn <= 10""",
)
def _(spark, sf):
    df = quality.issue_samples(standardised(spark, sf, once=True), "row_id")
    return edge(df.where("sample = 'row'"), "code", "field", "position", "text")


# ------------------------------------------------------------------ profiles
def _profile_sql(columns, dates) -> str:
    rows = []
    for c in columns:
        d = f"CAST(MIN({c}) AS DATE)" if c in dates else "CAST(NULL AS DATE)"
        e = f"CAST(MAX({c}) AS DATE)" if c in dates else "CAST(NULL AS DATE)"
        rows.append(
            f"SELECT '{c}' AS field, COUNT(*) AS row_count, COUNT({c}) AS non_null_count, COUNT(DISTINCT {c}) AS unique_count, CAST({d} AS VARCHAR) AS first_date, CAST({e} AS VARCHAR) AS last_date, "
            f"CAST(COUNT({c}) AS DOUBLE) / COUNT(*) AS non_null_rate, '{'date_candidate' if c in dates else 'text_or_mixed'}' AS dtype FROM lineitem"
        )
    return " UNION ALL ".join(rows)


LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


@query("profile_lineitem", _profile_sql(LINE_COLUMNS, ("l_shipdate",)))
def _(spark, sf):
    return edge(profile.profile(table(spark, sf, "lineitem")))


@query(
    "profile_duplicate_rows",
    "SELECT CAST(SUM(n) AS BIGINT) AS row_count, CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT COUNT(*) AS n FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 7 = 0) AS l GROUP BY ALL) AS t"
    .replace("GROUP BY ALL", "GROUP BY " + ", ".join(LINE_COLUMNS)),
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")  # whole rows, some of them twice
    return edge(profile.duplicate_rows(lines.unionByName(lines.where("l_orderkey % 7 = 0"))))


def _sample_sql(c: str) -> str:
    text = f"CASE WHEN REGEXP_MATCHES({c}, '1\\d{{10}}') THEN '<PHONE_MASKED>' WHEN LENGTH({c}) > 40 THEN SUBSTRING({c}, 1, 37) || '...' ELSE {c} END"
    return f"SELECT '{c}' AS field, CAST(rn AS BIGINT) AS position, {text} AS sample FROM (SELECT {c}, ROW_NUMBER() OVER (ORDER BY {c}) AS rn FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS {c} FROM customer) AS d) AS t WHERE rn <= 3"


@query("profile_masked_samples", " UNION ALL ".join(_sample_sql(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def _(spark, sf):
    return edge(profile.masked_samples(table(spark, sf, "customer")))
