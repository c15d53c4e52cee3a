"""Exact ranks, percentiles and quantiles without putting a whole group into one task.

``rank() over (partition by month)`` sorts a month in one task, and ``percentile`` keeps all
distinct values of a group in one buffer. Both stop working when one group holds a large share of
a big table. Here equal values are collapsed first (a partial aggregate), distinct values fall
into ordered cells, a prefix sum runs over the cells of a group (at most a few ten thousand rows,
whatever the data size), and only the values inside one cell are sorted together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizdiag.functions.lineage import written

#: Cells per power of two.
_CELLS = 256
#: Finer cells of a cell, and the rows up to which a cell is split into its values.
_SPLIT, _FEW = 4096.0, 65_536
#: Bits that ``monotonically_increasing_id`` has for the place inside a partition.
_PLACE_BITS = 33


def value_cell(c: Column) -> Column:
    """Integer cell which never decreases when ``c`` grows (256 cells per power of two, whatever the unit).

    ``log2`` is a strict logarithm over a constant, which by its contract is the same on every machine and
    never falls when its argument grows. NULL has no cell; NaN is in that of the greatest values.
    """
    x = c.cast("double")
    size = F.least(F.log2(F.abs(x)), F.lit(1024.0)) * float(_CELLS) + float(1075 * _CELLS)  # at least 256
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x < 0, -F.floor(size)).when(x.isNotNull(), F.floor(size))


def value_positions(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row per distinct non-NULL value of a group: ``n``, rows ``below`` it and group ``total``."""
    distinct = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count("*").alias("n"))
        .withColumn("_cell", value_cell(F.col(value)))
    )
    per_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    cells = distinct.groupBy(*group, "_cell").agg(F.sum("n").alias("_in_cell"))
    running = per_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_cell").alias("_c"),
        F.coalesce(F.sum("_in_cell").over(running), F.lit(0)).alias("_before"),
        F.sum("_in_cell").over(per_group).alias("total"),
    )
    match = F.col("_cell") == F.col("_c")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = (
        Window.partitionBy(*group, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    return distinct.join(cells, match).select(
        *group,
        value,
        "n",
        (F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"),
        "total",
    )


def with_rank(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    rank: str | None = None,
    percentile: str | None = None,
) -> DataFrame:
    """Add the descending minimum rank and/or the ascending average-tie percentile of ``value``.

    A NULL value gets a NULL rank. Group columns must not be NULL.
    """
    return with_ranks(df, group, {value: (rank, percentile)})


def with_ranks(
    df: DataFrame, group: Sequence[str], wanted: Mapping[str, tuple[str | None, str | None]]
) -> DataFrame:
    """``with_rank`` of several values: value -> (name of the rank or None, name of the percentile or None).

    Every value is placed from ``df`` itself and its table of distinct values is written, so that no value's
    joins run again for the next one. Runs jobs when called.
    """
    out = df
    for i, (value, (rank, percentile)) in enumerate(wanted.items()):
        columns = [F.col(g).alias(f"_r{i}_{g}") for g in group] + [F.col(value).alias(f"_r{i}")]
        if rank:
            columns.append((F.col("total") - F.col("below") - F.col("n") + 1).alias(rank))
        if percentile:
            # (below + (n + 1) / 2) / total, as one exact division
            columns.append(
                (
                    (F.col("below") * 2 + F.col("n") + 1).cast("double")
                    / (F.col("total") * 2).cast("double")
                ).alias(percentile)
            )
        pos = written(value_positions(df.select(*group, value), group, value).select(*columns))
        match = F.col(value) == F.col(f"_r{i}")
        for g in group:
            match = match & (F.col(g) == F.col(f"_r{i}_{g}"))
        out = out.join(pos, match, "left").drop(f"_r{i}", *[f"_r{i}_{g}" for g in group])
    return out


def _cells_hit(rows: DataFrame, group: Sequence[str], wanted: Mapping[str, float | Column]) -> DataFrame:
    """Cells of a narrowing step that hold a wanted position: their rows, bounds and the rows below them."""
    cells = rows.groupBy(*group, "_base", "_cell").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_total").alias("_total")
    )
    before = Window.partitionBy(*group, "_base").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = F.sum("_n").over(Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1)))
    cells = cells.select(
        *group, "_base", "_cell", "_n", "_lo", "_hi",
        (F.col("_base") + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_below"),
        F.coalesce("_total", all_rows).alias("_total"),
    )
    holds = F.lit(False)
    for q in wanted.values():
        for k in _neighbours(F.col("_total"), q)[:2]:
            holds = holds | _holds(k)
    return cells.where(holds)


def _neighbours(total: Column, q: float | Column) -> tuple[Column, Column, Column]:
    """Positions (from 0) of the two values that a linear quantile lies between, and its way from the first."""
    at = (total - 1) * q
    low = F.floor(at)
    return low, F.least(low + 1, total - 1), at - low


def _holds(k: Column) -> Column:
    return (F.col("_below") <= k) & (k < F.col("_below") + F.col("_n"))


def quantiles(
    df: DataFrame, group: Sequence[str], value: str, wanted: Mapping[str, float | Column]
) -> DataFrame:
    """Exact linear quantiles per group of the finite values as doubles, plus their number as ``n_values``.

    Selection by narrowing: rows are counted by cell (a partial aggregate, so the shuffle has a row for each
    cell and not for each value), a prefix sum tells the few cells that hold a wanted position, and only rows
    of these are counted again by finer cells between the cell's least and greatest value. A cell of few rows
    is split into its values at once. A step ends for a cell when it holds one value, so a tie of any size ends
    it; three small aggregates are usual. Values are neither joined on nor sorted. Runs jobs when called.
    """
    v = F.col(value).cast("double")
    rows = df.select(*group, v.alias("_v")).where(F.abs("_v") < float("inf"))  # NULL, NaN and infinity go
    rows = rows.withColumns({
        "_base": F.lit(0).cast("bigint"), "_total": F.lit(None).cast("bigint"), "_cell": value_cell(F.col("_v")).cast("double"),
    })
    found = []
    while True:
        rows = written(rows)
        cells = written(_cells_hit(rows, group, wanted))
        found.append(cells.where("_lo = _hi"))
        wide = cells.where("_lo < _hi")
        if not wide.limit(1).count():
            break
        names = {c: f"_p{c}" for c in (*group, "_base", "_cell", "_total")}
        parents = wide.select("_n", "_lo", "_hi", "_below", *[F.col(c).alias(p) for c, p in names.items()])
        match = F.lit(True)
        for c in (*group, "_base", "_cell"):
            match = match & F.col(c).eqNullSafe(F.col(names[c]))
        # every step of this is monotone in floating point, so cells never overlap
        finer = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _SPLIT).cast("double")
        rows = rows.join(parents, match).select(
            *group, "_v", F.col("_below").alias("_base"), F.col(names["_total"]).alias("_total"),
            F.when(F.col("_n") <= _FEW, F.col("_v")).otherwise(finer).alias("_cell"),
        )
    held = found[0]
    for more in found[1:]:
        held = held.unionByName(more)
    aggs, out = [F.max("_total").alias("n_values")], []
    for i, (name, q) in enumerate(wanted.items()):
        low, high, way = _neighbours(F.col("_total"), q)
        aggs += [
            F.max(F.when(_holds(low), F.col("_lo"))).alias(f"_l{i}"),
            F.max(F.when(_holds(high), F.col("_lo"))).alias(f"_h{i}"),
            F.max(way).alias(f"_w{i}"),
        ]
        out.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_w{i}")).alias(name))
    return held.groupBy(*group).agg(*aggs).select(*group, "n_values", *out)


def with_order_number(
    df: DataFrame, group: Sequence[str], value: str, label: str, name: str
) -> DataFrame:
    """Number the rows of a group by ``value`` descending, ``label`` ascending, NULLs last.

    ``(group, label)`` must be unique. Rows are sorted over ranges of (group, value, label) whose cut
    points Spark samples, so a tie of any size and with any labels spreads over many tasks. A row's
    place in its range, plus the rows of the ranges before it, is its number: one small table has a
    row for each range, and nothing is joined on values. Runs the sort when called.
    """
    order = [F.col(value).desc_nulls_last(), F.col(label).asc_nulls_last()]
    number = F.monotonically_increasing_id()  # the range's number, then the place in it
    placed = written(df.orderBy(*[F.col(g) for g in group], *order).withColumn("_at", number))
    spot = placed.withColumn("_range", F.call_function("shiftright", "_at", F.lit(_PLACE_BITS)))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spot.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_rows"))
    ranges = ranges.select("_r", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_ahead"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    out = spot.join(ranges, F.col("_range") == F.col("_r")).withColumn(name, F.col("_ahead") + place + 1)
    if group:
        firsts = out.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.min(name).alias("_first"))
        match = F.lit(True)
        for g in group:
            match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        out = out.join(firsts, match).withColumn(name, F.col(name) - F.col("_first") + 1)
    return out.select(*df.columns, name)
