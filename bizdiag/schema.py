"""The canonical daily fact and the vocabularies shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical columns in their fixed order.
DATE = "date"
DIMENSIONS = ("business_line", "product", "channel", "region", "team", "salesperson")
COUNTS = (
    "impressions", "leads", "valid_leads", "contacted_leads", "followed_leads",
    "paid_users", "paid_orders", "refund_users", "refund_orders",
)
MONEY = ("gross_revenue", "refund_amount")
COLUMNS = (
    "date", "business_line", "product", "channel", "region", "team", "salesperson",
    "impressions", "leads", "valid_leads", "contacted_leads", "followed_leads",
    "paid_users", "paid_orders", "gross_revenue", "refund_users", "refund_orders",
    "refund_amount",
)
MEASURES = COLUMNS[7:]


def column_type(field: str) -> T.DataType:
    """Spark type of one canonical column."""
    if field == DATE:
        return T.DateType()
    if field in DIMENSIONS:
        return T.StringType()
    if field in COUNTS:
        return T.LongType()
    if field in MONEY:
        return T.DecimalType(18, 2)
    raise ValueError(f"unknown canonical field: {field}")


FACT_SCHEMA = T.StructType(
    [T.StructField(f, column_type(f), nullable=f != DATE) for f in COLUMNS]
)

# Status names.
AVAILABLE = "available"
MISSING_FIELD = "unavailable_missing_field"
DEPENDENCY = "unavailable_dependency"
ZERO_DENOMINATOR = "unavailable_zero_denominator"
NO_DATA = "unavailable_no_data"

UNAVAILABLE_CURRENT = "unavailable_current"
UNAVAILABLE_BASELINE = "unavailable_baseline"


def require_dimension(field: str) -> str:
    """Reject a name which is not one of the six dimensions."""
    if field not in DIMENSIONS:
        raise ValueError(f"not a dimension: {field}")
    return field
