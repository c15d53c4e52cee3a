"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves; a codebook for each half (k-means on a bounded sample) makes a product
grid of cells, and every vector has its home in one. A vector visits the cells where a vector that it is
linked with can lie: the least squared distance to a cell (from the planes between codewords, summed over
both halves) never exceeds that of a pair, which is 2 - 2 * cosine. So every pair at the threshold or above
meets, whatever the sample was; the codebooks only steer work. Pairs that meet are verified by cosine in
double precision. Where vectors lie in all directions, the bound rules out few cells, and most pairs are compared.

Each pair is looked for once: of two cells one's vectors visit the other, and inside a cell the vector with
the smaller number visits. Cells with many homes or visitors are cut into blocks, so a task holds a bounded
part; it returns counts and a spanning forest of its links, never the links. Equal vectors are one node
with a weight.

Null, zero and non-finite vectors link with nothing and are kept; so do rows without id, whose
component is null. Vectors of different lengths do not meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizdiag.functions.lineage import written
from bizdiag.llm.batches import groups, sampled, splits
from bizdiag.llm.components import components
from bizdiag.llm.vectors import matrix, numbers, usable

TRAIN_ROWS = 8_192
CODEWORDS = 256
CELL_ROWS = 2_048
BLOCK = 4_096
TILE = 512
#: Grid entries that are worked on at a time when visits are listed.
ENTRIES = 1 << 22
#: Far above the rounding of distances; added to the reach.
SLACK = 1e-6


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` codewords (fewer, if there are fewer different rows) by k-means from spread-out rows."""
    x = np.unique(x, axis=0)
    words = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(12):
        near = ((words**2).sum(1)[None, :] - 2 * x @ words.T).argmin(1)
        count = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], words)
    return np.unique(words, axis=0)


class Grid:
    """The product grid of two codebooks."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.words = (first, second)
        self.half = first.shape[1]
        apart = [np.sqrt(((w[:, None] - w[None, :]) ** 2).sum(2)) for w in self.words]
        # rounding could put a row on the wrong side of planes between words that are all but equal: these bound nothing
        self.apart = [np.where(a > 1e-6, a, np.inf) for a in apart]

    def _halves(self, x: np.ndarray):
        for part, words in zip((x[:, : self.half], x[:, self.half :]), self.words):
            yield (words**2).sum(1)[None, :] - 2 * part @ words.T

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        i, j = (d.argmin(1) for d in self._halves(x))
        return i * len(self.words[1]) + j

    def gaps(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half, the squared distance that a row must move at least to be in each codeword's region."""
        out = []
        for d, apart in zip(self._halves(x), self.apart):
            gap = np.zeros_like(d)
            for k in range(d.shape[1]):  # the plane between codeword k and each other one
                np.maximum(gap, (d - d[:, k : k + 1]) / (2 * apart[k][None, :]), out=gap)
            out.append(np.maximum(gap, 0) ** 2)
        return out

    def visits(self, x: np.ndarray, reach: float) -> list[np.ndarray]:
        """The cells within reach of each row that it visits, nearest first: its home, and of each two cells one visits the other."""
        first, second = self.gaps(x)
        out = []
        for a, b, home in zip(first, second, self.homes(x)):
            i, j = np.flatnonzero(a <= reach), np.flatnonzero(b <= reach)
            sums = a[i][:, None] + b[j][None, :]
            r, c = np.nonzero(sums <= reach)
            order = np.argsort(sums[r, c], kind="stable")
            cell = (i[r] * len(self.words[1]) + j[c])[order]
            out.append(cell[(cell == home) | ((cell < home) == ((cell + home) % 2 == 0))])
        return out


def forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest number reachable from each of ``size`` numbers by the links (a, b)."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _grid(nodes: DataFrame, n: int, kind: np.dtype) -> Grid:
    """Codebooks from a bounded sample."""
    x = units(matrix(sampled(nodes, "node", TRAIN_ROWS).select("x").toArrow().column("x"), kind))
    k = int(min(CODEWORDS, max(2, (n / CELL_ROWS) ** 0.5)))
    half = x.shape[1] // 2
    return Grid(codebook(x[:, :half], k), codebook(x[:, half:], k))


def _links(nodes: DataFrame, n: int, least: float, kind: np.dtype) -> DataFrame:
    """(a, b, n): links of a spanning forest of each block (n null), and numbers of links (b null)."""
    grid, reach = _grid(nodes, n, kind), 2 * (1 - least) + SLACK
    shared = nodes.sparkSession.sparkContext.broadcast((grid, reach))

    def place(batches):
        grid_, reach_ = shared.value
        rows = max(1, ENTRIES // (len(grid_.words[0]) * len(grid_.words[1])))
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                x = units(matrix(b.column("x"), kind))
                columns = [b.column("node"), b.column("weight"), b.column("x"), pa.array(grid_.homes(x).astype(np.int32)), pa.array(grid_.visits(x, reach_), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "weight", "x", "cell", "visits"])

    placed = written(nodes.select("node", "weight", "x").mapInArrow(place, "node long, weight long, x binary, cell int, visits array<int>"))
    parts = lambda c: F.ceil(F.count("*") / BLOCK).cast("int").alias(c)
    visitors = placed.select(F.explode("visits").alias("cell"), F.col("cell").alias("home"), "node", "weight", "x")
    sizes = placed.groupBy("cell").agg(parts("homes")).join(visitors.groupBy("cell").agg(parts("guests")), "cell")
    sizes = F.broadcast(written(sizes))  # at most CODEWORDS squared rows
    spread = lambda m: F.pmod(F.xxhash64("node"), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    home = placed.join(sizes, "cell").select("cell", spread(F.col("homes")).alias("i"), every(F.col("guests")).alias("j"), F.lit(0).alias("kind"), "node", "weight", "x")
    guest = visitors.join(sizes, "cell").select("cell", every(F.col("homes")).alias("i"), spread(F.col("guests")).alias("j"), F.when(F.col("cell") == F.col("home"), 1).otherwise(2).alias("kind"), "node", "weight", "x")
    ready = home.unionByName(guest).repartition(splits(nodes), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "kind")

    def verify(batches):
        for g in groups(batches, ["cell", "i", "j"]):
            guest_, abroad = g.column("kind").to_numpy() > 0, g.column("kind").to_numpy() == 2
            if guest_.all() or not guest_.any():
                continue
            x, node, weight = units(matrix(g.column("x"), kind)), g.column("node").to_numpy(), g.column("weight").to_numpy()
            here, there = np.flatnonzero(~guest_), np.flatnonzero(guest_)
            links = np.zeros(len(node), np.int64)
            label = np.arange(len(node))
            for start in range(0, len(there), TILE):
                v = there[start : start + TILE]
                i, j = np.nonzero((x[v] @ x[here].T >= least) & (abroad[v][:, None] | (node[v][:, None] < node[here][None, :])))
                if len(i):
                    i, j = v[i], here[j]
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    label = forest(np.r_[label, i], np.r_[np.arange(len(label)), j], len(label))
            linked = np.flatnonzero(links)
            if len(linked):
                none = pa.nulls(len(linked), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), none, pa.array(links[linked])], names=["a", "b", "n"])
                other = linked[label[linked] != linked]
                yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[label[other]]), pa.nulls(len(other), pa.int64())], names=["a", "b", "n"])

    return ready.mapInArrow(verify, "a long, b long, n long")


def near_duplicates(table: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, ``n_links`` (other rows linked directly), ``component_id`` and ``kept`` of every row. Runs jobs when called."""
    kind = numbers(table, vector)
    ok = F.col(key).isNotNull() & usable(vector) & F.coalesce(F.exists(vector, lambda c: c != 0), F.lit(False))
    raw = table.select(F.col(key).cast("long").alias("id"), F.when(ok, F.col(vector)).alias("x"))

    def sent(batches):
        for b in batches:
            x = [None if v is None else np.array(v, kind).tobytes() for v in b.column("x").to_pylist()]
            node = [None if v is None else int.from_bytes(hashlib.md5(v).digest()[:8], "little", signed=True) for v in x]
            size = [0 if v is None else len(v) // kind.itemsize for v in x]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(x, pa.binary())], names=["id", "node", "dim", "x"])

    rows = written(raw.mapInArrow(sent, "id long, node long, dim int, x binary"))
    nodes = written(rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("dim").alias("dim"), F.first("x").alias("x")))
    found = None
    for dim, n in sorted(tuple(r) for r in nodes.groupBy("dim").count().collect()):
        part = _links(nodes.filter(F.col("dim") == dim), n, least, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found)
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    of = components(found.filter("b is not null").select("a", "b")).select(F.col("id").alias("node"), "component")
    named = nodes.select("node", "least", "weight").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").join(counts, "node", "left")
    out = rows.select("id", "node").join(named.select("node", "weight", "links", "component_id"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(key),
        (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
