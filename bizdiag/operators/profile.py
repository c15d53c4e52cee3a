"""Profile of any table: filled share, distinct values, date ranges, duplicate rows, masked samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header words of date columns, and the dates found in texts.
DATE_WORDS = ("日期", "时间", "月份", "date", "month", "day", "dt")
DATE_PATTERN = r"([12]\d{3})[年./_-]?(\d{1,2})[月./_-]?(\d{1,2})?"
PHONE, ID_NUMBER, SAMPLE_LENGTH = r"1\d{10}", r"\d{17}[0-9Xx]", 40


def _values(df: DataFrame) -> DataFrame:
    """Distinct non-empty values of every column with their counts, from one shuffle."""
    cells = [
        F.struct(
            F.lit(name).alias("field"), F.col(f"`{name}`").cast("string").alias("value"),
            F.lit(kind in ("date", "timestamp", "timestamp_ntz")).alias("typed_date"),
        )
        for name, kind in df.dtypes
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("field", "typed_date", F.nullif("value", F.lit("")).alias("value"))
        .agg(F.count("*").alias("n"))
    )


def text_date(c: Column) -> Column:
    """First date found in a text; a missing day is the first of the month."""
    part = lambda i: F.nullif(F.regexp_extract(c, DATE_PATTERN, i), F.lit(""))
    text = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(F.coalesce(part(3), F.lit("1")), 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def profile(df: DataFrame) -> DataFrame:
    """Per field: filled share, distinct values and date range."""
    lowered = F.lower("field")
    dated = F.lit(False)
    for word in DATE_WORDS:
        dated = dated | lowered.contains(word)
    parsed = F.when(F.col("typed_date"), F.substring("value", 1, 10).try_cast("date")).when(
        dated, text_date(F.col("value"))
    )
    filled = F.col("value").isNotNull()
    found = _values(df).withColumn("_date", parsed).groupBy("field").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("non_null_count"),
        F.count_if(filled).alias("unique_count"),
        F.min("_date").alias("first_date"),
        F.max("_date").alias("last_date"),
    )
    return found.withColumn(
        "non_null_rate", F.col("non_null_count") / F.nullif(F.col("row_count"), F.lit(0))
    ).withColumn("dtype", F.when(F.col("first_date").isNotNull(), "date_candidate").otherwise("text_or_mixed"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical row."""
    same = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("n"))
    return same.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def masked(c: Column) -> Column:
    """Text with phone and id numbers hidden and long texts cut."""
    text = F.trim(c)
    return (
        F.when(text.rlike(PHONE), "<PHONE_MASKED>")
        .when(text.rlike(ID_NUMBER), "<ID_MASKED>")
        .when(F.length(text) > SAMPLE_LENGTH, F.concat(F.substring(text, 1, SAMPLE_LENGTH - 3), F.lit("...")))
        .otherwise(text)
    )


def masked_samples(df: DataFrame, n: int = 3) -> DataFrame:
    """The n smallest distinct values of every field, masked."""
    order = Window.partitionBy("field").orderBy("value")
    return (
        _values(df).where(F.col("value").isNotNull())
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= n)
        .select("field", "position", masked(F.col("value")).alias("sample"))
    )
