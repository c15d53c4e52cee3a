"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 20_000


def numbered(df: DataFrame, group: list[str], order: list[str], into: str, rows: int) -> DataFrame:
    """``into``: gapless numbers from 0 within each group.

    A group is dealt into cells by a hash of ``order``; cells are counted, and rows are sorted only
    inside their cell, so that a group with most of the rows still spreads over many tasks. ``rows``
    is the number of rows in all; it sets the number of cells. NULL group values form a group.
    """
    cells = max(16, -(-rows // CELL_ROWS))
    named = df.withColumn("_cell", F.pmod(F.xxhash64(F.lit(29), *order), F.lit(cells)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = named.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    offsets = counts.select(
        *[F.col(g).alias(f"_{g}") for g in group],
        F.col("_cell").alias("_at"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("_cell") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*order))
    ranked = named.withColumn("_inside", inside)
    return ranked.join(offsets, same).withColumn(into, (F.col("_before") + F.col("_inside") - 1).cast("long")).select(*df.columns, into)
