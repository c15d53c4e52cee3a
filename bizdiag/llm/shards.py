"""Sharding by minimax contiguous partition.

Equal texts form an atomic group; groups are ordered by a 64-bit hash of the text (so that neither
the order of ids nor a hot text makes a hot range), and get exact prefix sums of their bytes. The
smallest feasible shard capacity is found by binary search with greedy checks, and the sequence is
cut there. A group larger than the capacity is a shard of its own; the capacity then evens out the rest.

The driver never holds all groups. It holds intervals of prefix sums (least, greatest, number of
groups), so that a greedy check can be run with a lower and an upper bound of each cut. Where the two
bounds differ, and only there, the intervals are split further by one Spark aggregation, until both
searches end at the same capacity: that is the exact one.

Null text: its size is the overhead alone, its checksum is null, and all null texts are one group.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizdiag.functions.lineage import written
from bizdiag.llm.rows import CELL_ROWS, numbered

OVERHEAD = 8
GRID = 16_384


@dataclass
class Ends:
    """What is known of the groups' prefix sums: disjoint intervals in order, and the largest groups."""

    low: list[int]
    high: list[int]
    count: list[int]
    #: Start -> end of the largest groups; no other group can exceed the capacity.
    large: dict[int, int] = field(default_factory=dict)

    def cut(self, start: int, capacity: int, upper: bool) -> int:
        """A bound of the greatest group end within ``capacity`` of ``start``; ``start`` itself if there is none."""
        x = start + capacity
        i = bisect.bisect_right(self.low, x) - 1
        found = 0 if i < 0 else self.high[i] if self.high[i] <= x else x if upper else self.low[i]
        return max(found, start)

    def greedy(self, capacity: int, shards: int, total: int, upper: bool) -> list[int]:
        """Shard ends; the last is ``total`` if the capacity suffices."""
        cuts, at = [], 0
        while at < total and len(cuts) < shards:
            end = self.cut(at, capacity, upper)
            if end == at:
                end = self.large.get(at, at)
            if end == at:
                break
            cuts.append(end)
            at = end
        return cuts

    def smallest(self, shards: int, total: int, upper: bool) -> int:
        """The smallest capacity for which the greedy check reaches the end."""
        low, high = 1, total
        while low < high:
            middle = (low + high) // 2
            if self.greedy(middle, shards, total, upper)[-1:] == [total]:
                high = middle
            else:
                low = middle + 1
        return low

    def open_ranges(self, low: int, high: int, shards: int, total: int) -> list[tuple[int, int]]:
        """Ranges (low, high] of the intervals in which a cut may lie for a capacity from ``low`` to ``high``."""
        first, last = self.greedy(low, shards, total, False), self.greedy(high, shards, total, True)
        first += first[-1:] * (shards - len(first)) if first else [0] * shards
        wanted = set()
        for a, b in zip(first, [*last, *[total] * (shards - len(last))]):
            i, j = bisect.bisect_left(self.high, a), bisect.bisect_right(self.low, b)
            wanted.update(k for k in range(i, j) if self.count[k] > 1)
        wanted = wanted or {k for k, n in enumerate(self.count) if n > 1}
        merged: list[list[int]] = []
        for k in sorted(wanted):
            if merged and merged[-1][1] == k - 1:
                merged[-1][1] = k
            else:
                merged.append([k, k])
        return [(self.low[i] - 1, self.high[j]) for i, j in merged]


def _intervals(ends: DataFrame, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Least and greatest end and number of ends of each cell; about ``GRID`` cells in all. Ranges are in order."""
    grid = max(16, GRID // len(ranges))
    lows, highs = (F.array(*[F.lit(r[i]).cast("long") for r in ranges]) for i in (0, 1))
    k = F.size(F.filter(lows, lambda low: low < F.col("end")))  # the number of the range, from 1
    found = ends.select("end", k.alias("k")).filter("k > 0").select("end", "k", F.element_at(lows, F.col("k")).alias("low"), F.element_at(highs, F.col("k")).alias("high"))
    width = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / grid))
    cell = F.floor((F.col("end") - F.col("low") - 1) / width).alias("cell")
    cells = found.filter("end <= high").groupBy("k", cell).agg(F.min("end"), F.max("end"), F.count("*"))
    return [tuple(r)[2:] for r in cells.collect()]


def evened(ends: DataFrame, cuts: list[int], capacity: int) -> list[int]:
    """The same number of shards with even sizes between the oversize groups, where the capacity allows that.

    Greedy cuts fill each shard up and leave what remains to the last; here each run of shards is cut at
    the group ends next below equal parts of it.
    """
    runs, at = [], 0
    for cut in cuts:
        if cut - at > capacity:
            runs.append([at, cut])  # one group
        elif runs and runs[-1][-1] == at and runs[-1][-1] - runs[-1][-2] <= capacity:
            runs[-1].append(cut)
        else:
            runs.append([at, cut])
        at = cut
    parts = [run[0] + (run[-1] - run[0]) * i // (len(run) - 1) for run in runs for i in range(1, len(run) - 1)]
    if not parts:
        return cuts
    found = dict(zip(parts, ends.agg(*[F.max(F.when(F.col("end") <= x, F.col("end"))) for x in parts]).first()))
    out = []
    for run in runs:
        count = len(run) - 1
        even = [found[run[0] + (run[-1] - run[0]) * i // count] for i in range(1, count)] + [run[-1]]
        sizes = [b - (a or 0) for a, b in zip([run[0], *even], even) if b is not None]
        out += even if len(sizes) == count and min(sizes) > 0 and max(sizes) <= capacity else run[1:]
    return out


def minimax_cuts(ends: DataFrame, shards: int, total: int) -> tuple[int, list[int]]:
    """The smallest capacity and the shards' ends. ``ends``: one row (size, end) for each group, sizes over 0."""
    largest = ends.orderBy(F.desc("size"), "end").limit(shards).collect()
    large = {r["end"] - r["size"]: r["end"] for r in largest}
    points = sorted({*large, *large.values(), total} - {0})
    known = [(p, p, 1) for p in points]
    ranges = [(a, b - 1) for a, b in zip([0, *points], points) if b - 1 > a and large.get(a) != b]
    while True:
        inside = lambda x: any(a < x[0] and x[1] <= b for a, b in ranges)
        known = sorted([x for x in known if not inside(x)] + (_intervals(ends, ranges) if ranges else []))
        state = Ends(*([x[i] for x in known] for i in range(3)), large)
        low, high = state.smallest(shards, total, True), state.smallest(shards, total, False)
        if low == high:
            return high, evened(ends, state.greedy(high, shards, total, False), high)
        ranges = state.open_ranges(low, high, shards, total)


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard`` (from 0) and ``slot`` (gapless from 0 in the shard) of every row.

    Runs jobs when called (it writes a narrow table of the rows and one of the groups).
    """
    rows = written(
        docs.select(
            key,
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        )
    )
    n = rows.count()
    bits = max(6, (n // CELL_ROWS).bit_length())
    block = F.shiftright("h", 64 - bits).alias("block")
    groups = rows.groupBy("h").agg(F.sum("size").alias("size")).select("h", "size", block)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.groupBy("block").agg(F.sum("size").alias("bytes")).select("block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("start"))
    so_far = Window.partitionBy("block").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    ends = written(groups.join(starts, "block").select("h", "size", (F.col("start") + F.sum("size").over(so_far)).alias("end")))
    total = ends.agg(F.max("end")).first()[0]
    last: list[int] = []
    if total:
        _, cuts = minimax_cuts(ends.select("size", "end"), shards, total)
        last = [r["h"] for r in ends.filter(F.col("end").isin(cuts[:-1])).select("h").collect()]
    shard = sum(((F.col("h") > h).cast("int") for h in last), F.lit(0))
    return numbered(rows.withColumn("shard", shard), ["shard"], [key, "h"], "slot", n).drop("h")
