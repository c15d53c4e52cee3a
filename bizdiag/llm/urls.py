"""URL filters by a sort-merge range join.

The canonical key of a URL is its host with the labels reversed, each ended by ``/``, then ``#`` and
its path. A host rule is a prefix of such keys and so an interval of the sorted keys; intervals of
hosts are nested or disjoint. Keys are cut into ranges at quantiles of a sample; a rule is sent to
every range that its interval meets. Within a range, keys and rules are sorted together and swept
once with a stack of the open (nested) host rules. A key that holds a large share of the rows is
spread over all ranges whose bounds it equals.

Null or malformed URLs (no ``://``) have an empty host and path and no rule.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bizdiag.llm.batches import sampled, splits

SAMPLE_A_RANGE = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_key(host: str) -> str:
    """``a.b.c`` -> ``c/b/a/``; an empty host (of a rule: any host) has an empty key."""
    return "".join(f"{x}/" for x in reversed(host.split("."))) if host else ""


def parsed(pages: DataFrame, key: str, url: str) -> DataFrame:
    """``page``, ``host``, ``path`` and the canonical ``key`` of each row."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    out = pages.select(F.col(key).alias("page"), F.translate(part(1), UPPER, UPPER.lower()).alias("host"), part(2).alias("path"))
    labels = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "/"), F.lit("/"))
    return out.withColumn("key", F.concat(F.when(F.col("host") == "", F.lit("")).otherwise(labels), F.lit("#"), "path"))


class Rules:
    """The rules of one host: the longest path that a given path starts with is found by its length."""

    def __init__(self, prefix: str):
        self.prefix = prefix
        self.by_path: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []

    def add(self, path: str, rule: str, verdict: str) -> None:
        """A later rule of the same host and path gives way to an earlier one."""
        self.by_path.setdefault(path, (rule, verdict))
        self.lengths = sorted({len(p) for p in self.by_path}, reverse=True)

    def best(self, path: str) -> tuple[str, str] | None:
        """The rule with the longest fitting path."""
        return next((self.by_path[path[:n]] for n in self.lengths if n <= len(path) and path[:n] in self.by_path), None)


def sweep(rows: Iterable[tuple], otherwise: str):
    """Rows (range, key, kind, page, host, path, rule, verdict), sorted; a (page, ...) for each page."""
    stack: list[Rules] = []
    at = None
    for part, key, kind, page, host, path, rule, verdict in rows:
        if part != at:
            stack, at = [], part
        if kind == 0:
            prefix = host_key(host)
            while stack and not prefix.startswith(stack[-1].prefix):
                stack.pop()
            if not stack or stack[-1].prefix != prefix:
                stack.append(Rules(prefix))
            stack[-1].add(path, rule, verdict)
            continue
        while stack and not key.startswith(stack[-1].prefix):
            stack.pop()
        found = [x for level in stack if (x := level.best(path))]
        # the longest rule wins; of equally long ones that with the longer host, which lies higher on the stack
        best = max(enumerate(found), key=lambda x: (len(x[1][0]), x[0]), default=(0, (None, otherwise)))[1]
        yield page, host, path, *best


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], otherwise: str = "allow", key: str = "page_id", url: str = "url"
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    ``rules``: (verdict, host, path). A rule fits its host and all subdomains if the path starts with
    its path; the longest rule (host and path) wins, of equals the one with the longer host. Rows
    that no rule fits get the verdict ``otherwise`` and no rule.
    """
    spark, kind = pages.sparkSession, pages.schema[key].dataType
    rows = parsed(pages, key, url)
    ranges = 4 * splits(pages)
    some = sorted(r[0] for r in sampled(rows.select("page", "key"), ["page", "key"], SAMPLE_A_RANGE * ranges).select("key").collect())
    bounds = some[:: max(1, len(some) // ranges)][1:]  # range k holds the keys from bound k - 1 to bound k
    shape = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("page", kind)]
        + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    )

    def dealt(batches):
        for b in batches:
            keys, parts = b.column("key").to_pylist(), []
            for i, k in enumerate(keys):
                first, last = bisect.bisect_left(bounds, k), bisect.bisect_right(bounds, k)
                parts.append(first if first == last else first + zlib.crc32(str(b.column("page")[i].as_py()).encode()) % (last - first + 1))
            none, n = pa.nulls(len(keys), pa.string()), len(keys)
            columns = [pa.array(parts, pa.int32()), b.column("key"), pa.array([1] * n, pa.int32()), b.column("page"), b.column("host"), b.column("path"), none, none]
            yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    # a rule reaches the ranges that its interval meets; there it is sorted at its own key or at the range's bound
    opened = []
    for verdict, host, path in sorted(rules, key=lambda r: (host_key(r[1]), r[2])):
        prefix = host_key(host)
        stop = bisect.bisect_left(bounds, prefix[:-1] + "0") if prefix else len(bounds)
        for p in range(bisect.bisect_left(bounds, prefix), stop + 1):
            opened.append((p, max(prefix, bounds[p - 1] if p else ""), 0, None, host, path, f"{host}{path}", verdict))
    both = rows.mapInArrow(dealt, shape).unionByName(spark.createDataFrame(opened, shape))
    # rules before pages, outer rules before inner ones
    depth = F.when(F.col("kind") == 0, F.length("host"))
    ready = both.repartition(splits(pages), "part").sortWithinPartitions("part", "key", "kind", depth)

    def swept(batches):
        every = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        names, part = ["page", "host", "path", "rule", "verdict"], []
        types = [page_type, *[pa.string()] * 4]
        pack = lambda x: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*x), types)], names=names)
        for row in sweep(every, otherwise):
            part.append(row)
            if len(part) == 20_000:
                yield pack(part)
                part = []
        if part:
            yield pack(part)

    page_type = to_arrow_type(kind)
    out = T.StructType([T.StructField("page", kind), *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])
    return ready.mapInArrow(swept, out).withColumnRenamed("page", key)
