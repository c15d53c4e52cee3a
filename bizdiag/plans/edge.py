"""Result types at the edge: dates as ISO text, money as double, so that any client reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge(df: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns (all when none is named) with portable types."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        if kinds[c] == "date":
            out.append(F.date_format(c, "yyyy-MM-dd").alias(c))
        elif kinds[c].startswith("decimal"):
            out.append(F.col(c).cast("double").alias(c))
        elif kinds[c] in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("bigint").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
