"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components are quantised to floor(scale * x). In each block of rows the index keeps posting segments
by impact: segment s holds the postings (row, component) whose quantised magnitude lies in the s-th
band, bands in descending order. Queries take the segments in that order. After each segment, what
the open ones can still add to a row's score is bounded (by the norms of query and row remainder, and
by the largest open impact); a query stops only when its k-th best lower bound proves all rows but
its possible members out. Possible members are rescored exactly in whole numbers.

All queries meet all blocks; blocks and chunks of queries have a bounded size, so that a task holds one
of each, and only the k best of each block leave it. Vectors without id, null vectors, and vectors with
null or non-finite components take no part; vectors of different lengths do not meet. Rows with the
query's id count as its own. Equal scores go by the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizdiag.llm.batches import groups, splits
from bizdiag.llm.vectors import matrix, usable

BLOCK_ROWS = 16_384
CHUNK_QUERIES = 8_192
TILE = 256
#: Shares of the postings in each segment, by descending impact.
SEGMENTS = (0.3, 0.3, 0.4)


class Index:
    """Posting segments of one block, in a number type that is exact for the sums at hand."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, largest: float):
        self.ids = ids
        bound = largest * np.abs(rows).max(initial=0) * rows.shape[1]
        self.kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
        self.rows = rows.astype(np.int64) if self.kind is not object else np.array([[int(x) for x in r] for r in rows.tolist()], object)
        size = np.abs(rows)
        edges = [np.inf, *np.quantile(size, 1 - np.cumsum(SEGMENTS)[:-1], method="higher"), -1.0]
        whole = self.rows.astype(self.kind)
        self.segments = []  # postings of the band, and what the bands below it can still add: norms and largest impact
        for high, low in zip(edges, edges[1:]):
            rest = np.where(size < low, size, 0)
            postings = np.where((size < high) & (size >= low), whole, 0).T.copy()
            self.segments.append((postings, (np.sqrt((rest**2).sum(1)), rest.max(initial=0))))

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(number of the query, id, score) of each query's k best rows."""
        out = []
        for start in range(0, len(queries), TILE):
            part = np.arange(start, min(start + TILE, len(queries)))
            norm, total = np.sqrt((queries[part] ** 2).sum(1)), np.abs(queries[part]).sum(1)
            sums = np.zeros((len(part), len(self.ids)), self.kind)
            left = np.arange(len(part))
            mine = own[part][:, None] == self.ids[None, :]
            for segment, (rest, most) in self.segments:
                if not len(left):
                    break
                sums[left] += queries[part[left]].astype(self.kind) @ segment
                slack = np.minimum(norm[left][:, None] * rest[None, :], (total[left] * most)[:, None]) * (1 + 1e-6)
                now = np.where(mine[left], -np.inf, sums[left].astype(np.float64))
                if now.shape[1] > k:
                    floor = np.partition(now - slack, -k, axis=1)[:, -k]
                    floor -= np.abs(floor) * 1e-9
                else:
                    floor = np.full(len(left), -np.inf)
                may = (now + slack >= floor[:, None]) & ~mine[left]
                counts = may.sum(1)
                done = np.flatnonzero((counts <= 8 * k) | (most == 0))
                for i in done:
                    rows = np.flatnonzero(may[i])
                    q = queries[part[left[i]]]
                    exact = self.rows[rows] @ (q.astype(np.int64) if self.kind is not object else np.array([int(x) for x in q.tolist()], object))
                    order = np.lexsort((self.ids[rows], -exact))[:k] if self.kind is not object else sorted(range(len(rows)), key=lambda r: (-exact[r], self.ids[rows[r]]))[:k]
                    out += [(int(part[left[i]]), int(self.ids[rows[r]]), int(exact[r])) for r in order]
                left = np.delete(left, done)
        return out


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``key`` and ``score`` of each query's k best other rows. Counts rows when called."""
    raw = table.filter(F.col(key).isNotNull() & usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("x"), F.size(vector).alias("dim"), is_query.alias("q"), F.xxhash64(vector).alias("mark")
    )

    def sent(batches):
        for b in batches:
            whole = [np.floor(scale * np.array(x, np.float64)).astype("<f8").tobytes() for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("dim"), b.column("q"), b.column("mark"), pa.array(whole, pa.binary())], names=["id", "dim", "q", "mark", "x"])

    rows = raw.mapInArrow(sent, "id long, dim int, q boolean, mark long, x binary")
    n, n_queries = raw.select(F.count("*"), F.count_if("q")).first()
    blocks, parts = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // CHUNK_QUERIES))
    dealt = lambda c, m: F.pmod(F.xxhash64("id", "mark"), F.lit(m)).cast("int").alias(c)
    every = lambda c, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(c)
    left = rows.select("dim", dealt("block", blocks), every("part", parts), F.lit(0).alias("kind"), "id", "mark", "x")
    right = rows.filter("q").dropDuplicates(["id", "mark"]).select("dim", every("block", blocks), dealt("part", parts), F.lit(1).alias("kind"), "id", "mark", "x")
    both = left.unionByName(right).repartition(splits(table), "dim", "block", "part").sortWithinPartitions("dim", "block", "part", "kind")

    def search(batches):
        for g in groups(batches, ["dim", "block", "part"]):
            query = g.column("kind").to_numpy() == 1
            if query.all() or not query.any():
                continue
            x, ids, marks = matrix(g.column("x"), np.dtype("<f8")), g.column("id").to_numpy(), g.column("mark").to_numpy()
            q = x[query]
            found = Index(ids[~query], x[~query], np.abs(q).max(initial=0)).best(q, ids[query], k)
            if found:
                i, other, score = zip(*found)
                i = np.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(ids[query][i]), pa.array(marks[query][i]), pa.array(other, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "mark", key, "score"])

    found = both.mapInArrow(search, f"query_id long, mark long, {key} long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")
