"""Data-quality checks of a standardised frame. All column checks share one aggregate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizdiag.definitions import CONSISTENCY_RULES, QUALITY_CONFIG
from bizdiag.operators.mapping import Standardised, first_values, normalisation_issues
from bizdiag.schema import COLUMNS, DATE, DIMENSIONS, MEASURES

# Messages.
MESSAGES = {
    "invalid_canonical_schema": "Standardized columns do not match the canonical schema order",
    "empty_data": "The standardized dataset contains no rows",
    "missing_required_date": "The required canonical date field was not mapped",
    "unmapped_optional_field": "Optional canonical field was not mapped and remains unavailable",
    "mapped_field_nulls": "Mapped field contains NULL values",
    "missing_ratio_exceeded": "Mapped field NULL ratio exceeds the configured warning threshold",
    "negative_value": "Negative values are preserved and require business review",
    "duplicate_canonical_grain": "Duplicate rows share canonical grain fields",
    "consistency": "Consistency warning based on a general relationship; it is not a confirmed business error",
}


def checked_config(config: Mapping = QUALITY_CONFIG) -> dict:
    """Config with its limits checked."""
    c = {**QUALITY_CONFIG, **config}
    if not 0 <= c["missing_warning_threshold"] <= 1 or c["sample_rows_limit"] < 1:
        raise ValueError("invalid quality config")
    return c


def _issue(code: str, severity: str, field: str | None, count: Column, message: str) -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"),
        F.lit(field).cast("string").alias("field"), F.lit(message).alias("message"),
        count.cast("bigint").alias("affected_count"),
    )


def column_checks(s: Standardised, config: Mapping = QUALITY_CONFIG) -> DataFrame:
    """NULL, ratio, negative, consistency, unmapped and emptiness issues in one pass."""
    c = checked_config(config)
    aggs = [F.count("*").alias("_rows")]
    rows, issues = F.col("_rows"), []
    if tuple(x for x in s.frame.columns if x in COLUMNS) != COLUMNS:
        issues.append(_issue("invalid_canonical_schema", "ERROR", None, F.lit(1), MESSAGES["invalid_canonical_schema"]))
    issues.append(F.when(rows == 0, _issue("empty_data", "ERROR", None, F.lit(0), MESSAGES["empty_data"])))
    if DATE in s.unavailable:
        issues.append(_issue("missing_required_date", "ERROR", DATE, rows, MESSAGES["missing_required_date"]))
    for f in s.unavailable:
        if f != DATE:
            issues.append(_issue("unmapped_optional_field", "WARNING", f, rows, MESSAGES["unmapped_optional_field"]))

    def flagged(cond: Column, name: str, code: str, field: str, message: str) -> None:
        aggs.append(F.count_if(cond).alias(name))
        issues.append(F.when(F.col(name) > 0, _issue(code, "WARNING", field, F.col(name), message)))

    for f in s.mapped:
        flagged(F.col(f).isNull(), f"null_{f}", "mapped_field_nulls", f, MESSAGES["mapped_field_nulls"])
        over = F.col(f"null_{f}") > F.col("_rows") * float(c["missing_warning_threshold"])
        issues.append(
            F.when(
                over & (rows > 0),
                _issue("missing_ratio_exceeded", "WARNING", f, F.col(f"null_{f}"), MESSAGES["missing_ratio_exceeded"]),
            )
        )
    for f in MEASURES:
        if f in s.mapped:
            flagged(F.col(f) < 0, f"neg_{f}", "negative_value", f, MESSAGES["negative_value"])
    if c["consistency_checks_enabled"]:
        for upper, lower, code in CONSISTENCY_RULES:
            if upper in s.mapped and lower in s.mapped:
                flagged(F.col(lower) > F.col(upper), code, code, lower, MESSAGES["consistency"])
    return s.frame.agg(*aggs).select(F.inline(F.array_compact(F.array(*issues))))


def grain(s: Standardised) -> list[str]:
    """Date and mapped dimensions."""
    return [DATE, *[d for d in DIMENSIONS if d in s.mapped]]


def duplicate_groups(s: Standardised) -> DataFrame:
    """Grain values shared by several rows (NULL equals NULL), with their row count."""
    return s.frame.groupBy(*grain(s)).agg(F.count("*").alias("row_count")).where("row_count > 1")


def duplicate_issue(s: Standardised) -> DataFrame:
    """At most one issue: all rows which share their grain with another row."""
    total = duplicate_groups(s).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("n"))
    message = f"{MESSAGES['duplicate_canonical_grain']}: {', '.join(grain(s))}"
    return total.where("n > 0").select(
        F.inline(F.array(_issue("duplicate_canonical_grain", "ERROR", None, F.col("n"), message)))
    )


def quality_issues(s: Standardised, config: Mapping = QUALITY_CONFIG) -> DataFrame:
    """All issues of a standardised frame."""
    out = column_checks(s, config).unionByName(
        normalisation_issues(s).select("code", F.lit("ERROR").alias("severity"), "field", "message", "affected_count")
    )
    if checked_config(config)["duplicate_check_enabled"] and DATE in s.mapped:
        out = out.unionByName(duplicate_issue(s))
    return out


def quality_report(s: Standardised, config: Mapping = QUALITY_CONFIG) -> DataFrame:
    """One row: counts per severity, row count, and whether loading is allowed."""
    level = lambda x: F.count_if(F.col("severity") == x)
    rows = s.frame.agg(F.count("*")).scalar()
    return quality_issues(s, config).agg(
        level("ERROR").alias("blocking_count"), level("WARNING").alias("warning_count"),
        level("INFO").alias("info_count"),
    ).select(
        (F.col("blocking_count") == 0).alias("is_valid"), "blocking_count", "warning_count", "info_count",
        rows.alias("row_count"),
    )


def issue_samples(s: Standardised, row_id: str, n: int | None = None, config: Mapping = QUALITY_CONFIG) -> DataFrame:
    """First n rows and distinct values of every data issue, by row id.

    An exceeded ratio has the rows of the field's NULLs and no values. Duplicates have no field; their
    values are the grains of the first n rows, fields joined by ``|``, NULL as nothing.
    """
    c = checked_config(config)
    limit = n or c["sample_rows_limit"]
    cells = []

    def cell(cond: Column, code: str, field: str, value: Column) -> None:
        cells.append(
            F.when(
                cond,
                F.struct(
                    F.lit(code).alias("code"), F.lit(field).alias("field"),
                    F.col(row_id).cast("string").alias("row_id"), value.cast("string").alias("value"),
                ),
            )
        )

    for f in s.mapped:
        cell(F.col(f).isNull(), "mapped_field_nulls", f, F.col(f))
        if f in MEASURES:
            cell(F.col(f) < 0, "negative_value", f, F.col(f))
    for upper, lower, code in CONSISTENCY_RULES:
        if upper in s.mapped and lower in s.mapped:
            pair = F.concat_ws("|", F.col(upper).cast("string"), F.col(lower).cast("string"))
            cell(F.col(lower) > F.col(upper), code, lower, pair)
    found = s.frame.select(F.inline(F.array_compact(F.array(*cells))))
    bad = s.bad_cells.select("code", "field", "row_id", "value")
    out = first_values(found.unionByName(bad), limit)
    exceeded = column_checks(s, c).where("code = 'missing_ratio_exceeded'").select("field")  # at most the 18 fields
    nulls = out.where("code = 'mapped_field_nulls' and sample = 'row'").join(exceeded, "field", "left_semi")
    out = out.unionByName(nulls.withColumn("code", F.lit("missing_ratio_exceeded")))
    if c["duplicate_check_enabled"] and DATE in s.mapped:
        out = out.unionByName(_duplicate_samples(s, row_id, limit))
    return out


def _duplicate_samples(s: Standardised, row_id: str, limit: int) -> DataFrame:
    """First ``limit`` rows that share their grain with another row, and their grains.

    Of each grain only the first ``limit`` rows can be among them, and a second row proves the duplicate. Spark
    cuts each grain to these before the shuffle, so a grain of many rows is no large group.
    """
    number = F.coalesce(F.col(row_id).try_cast("bigint"), F.lit(0))
    shown = F.concat_ws("|", *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in grain(s)])
    place = Window.partitionBy(*grain(s)).orderBy("_n", "_id")
    rows = s.frame.select(*grain(s), number.alias("_n"), F.col(row_id).cast("string").alias("_id"), shown.alias("_grain"))
    first = rows.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= limit + 1)
    several = F.max("_k").over(Window.partitionBy(*grain(s))) > 1
    shared = first.withColumn("_several", several).where("_several").orderBy("_n", "_id").limit(limit)
    position = F.row_number().over(Window.orderBy("_n", "_id"))  # of at most ``limit`` rows
    row, value = (
        F.struct(F.lit(kind).alias("sample"), "position", F.col(text).alias("text")) for kind, text in (("row", "_id"), ("value", "_grain"))
    )
    return shared.withColumn("position", position).select(
        F.lit("duplicate_canonical_grain").alias("code"), F.lit(None).cast("string").alias("field"), F.inline(F.array(row, value))
    )
