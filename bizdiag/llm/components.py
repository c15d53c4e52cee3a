"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizdiag.functions.lineage import written


def _starred(links: DataFrame) -> bool:
    """Whether each id has one smaller neighbour at most, and then no larger one."""
    end = lambda id_, up: F.struct(F.col(id_).alias("id"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = links.select(F.inline(F.array(end("a", 1), end("b", 0)))).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.count_if(F.expr("up > 1 or up = 1 and down = 1"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id in the links (``a``, ``b``) but those alone.

    Each round writes its links and reads them back, so lineage stays short and a lost executor costs
    one round at most. In a round each id passes its smallest neighbour to its larger neighbours, then
    to its smaller ones; the number of links never grows, and rounds grow with the logarithm of the
    longest path. It ends when the links are stars, which a round would leave as they are.
    """
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    while not _starred(now):
        least = now.select(F.inline(F.array(pair("a", "b"), pair("b", "a")))).groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = now.join(least, "b").select("a", F.least("b", "m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.inline(F.array(pair("a", "m"), pair("b", "m"))))
        now = written(small.filter("a <> b").distinct())
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
