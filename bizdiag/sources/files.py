"""CSV exports: plain UTF-8 scans, scans of unknown encoding, previews and summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings tried in this order.
ENCODINGS = ("utf-8-sig", "gb18030")
# Texts that stand for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def without_missing(df: DataFrame, tokens: tuple[str, ...] = MISSING) -> DataFrame:
    """NULL in place of the texts that stand for a missing value."""
    return df.select(
        *[(F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")) if k == "string" else F.col(f"`{c}`")).alias(c) for c, k in df.dtypes]
    )


def scan_csv(spark: SparkSession, path: str, rows: int | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header, UTF-8 with or without a mark; every column is text, missing-value tokens are NULL.

    ``multiline`` reads line breaks inside quotes; such files are not splittable, so each is one task.
    """
    if rows is not None and rows < 1:
        raise ValueError("rows must be at least 1")
    df = without_missing(spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(path))
    return df if rows is None else df.limit(rows)


def decode_header(name: str) -> str:
    """Header read byte by byte, decoded like the rows."""
    for encoding in ENCODINGS:
        try:
            return name.encode("latin-1").decode(encoding).strip()
        except UnicodeDecodeError:
            continue
    raise ValueError("header is neither UTF-8 nor GB18030")


@F.pandas_udf(T.StringType())
def _gb18030(values: pd.Series) -> pd.Series:
    return values.map(lambda b: None if b is None else bytes(b).decode("gb18030"))


def scan_csv_any_encoding(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV files of one layout whose encoding is UTF-8 or GB18030, decided per file.

    Files are read as single bytes (ISO-8859-1), so they stay splittable: neither encoding uses a
    line break, comma or quote byte inside a character. A file whose bytes are not all valid UTF-8
    is decoded as GB18030 in Arrow batches; UTF-8 files never leave the JVM. ``multiline`` as in
    ``scan_csv``; missing-value tokens are NULL.
    """
    raw = (
        spark.read.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').option("multiLine", multiline).csv(path)
    )
    names = [decode_header(c) for c in raw.columns]
    raw = raw.select(
        *[F.encode(F.col(f"`{c}`"), "ISO-8859-1").alias(f"c{i}") for i, c in enumerate(raw.columns)],
        F.col("_metadata.file_path").alias("_file"),
    )
    valid = F.lit(True)
    for i in range(len(names)):
        valid = valid & F.coalesce(F.is_valid_utf8(F.col(f"c{i}").cast("string")), F.lit(True))
    files = raw.groupBy(F.col("_file").alias("_f")).agg(F.bool_and(valid).alias("_utf8"))
    rows = raw.join(files, F.col("_file") == F.col("_f"))

    def decoded(c: str) -> Column:
        other = _gb18030(F.when(~F.col("_utf8"), F.col(c)))
        return F.when(F.col("_utf8"), F.col(c).cast("string")).otherwise(other)

    texts = rows.select(*[decoded(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("_file").alias("source_file"))
    return without_missing(texts)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """First n rows."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return df.limit(n)


def summarise(df: DataFrame) -> DataFrame:
    """Row count, column count and column names as one row."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), F.array_join(names, ",").alias("columns")
    )
