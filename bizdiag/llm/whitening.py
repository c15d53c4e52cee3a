"""Embedding whitening by QR, bidiagonalisation and a qd solver.

Entries become whole numbers (``floor(scale * c)``), so sums and the distances reported are exact. The fit
list holds each distinct vector once. Its rows are centred (x - S / n, the whole part exactly) and reduced to
triangles, block after block inside a task and then 16 triangles at a time, until one is left: R, whose
R^T R is n times the covariance, which is never formed. The driver gets R (dimensions squared, whatever the rows)
and solves it (``qd.py``): Householder reflections to a bidiagonal matrix, dqds for its singular values,
twisted factorisations for the directions. Every row is then projected by a broadcast of those.

Rows take no part whose vector is null, empty, holds null or non-finite entries or entries whose whole number
would not be exact in double precision, or has another length than most vectors (of equally many, the greater
length). Components of no variance (a deviation of at most ``NONE`` times the first one's) have no rows; so a
table with fewer than two distinct vectors gives none. Rows without id, and rows that repeat one, are all
returned. Components of equal variance are any basis of their space, the same for all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizdiag.functions.lineage import written
from bizdiag.llm import qd
from bizdiag.llm.batches import groups
from bizdiag.llm.vectors import usable

SCALE = 256
COMPONENTS = 4
NONE = 1e-10
#: Whole numbers beyond this are not exact in double precision.
EXACT = 2.0**53
#: Numbers of a block at least, and triangles that meet in one task.
BLOCK, FAN = 1 << 20, 16
_HALF = 26
_KINDS = [np.dtype(f"<i{k}") for k in (1, 2, 4, 8)]


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose entries are all finite and exact."""
    exact = F.forall(F.col("vector"), lambda c: F.abs(c.cast("double")) < F.lit(EXACT / SCALE))
    return vectors.filter(usable("vector")).filter(exact)


def whole(batch: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    """The whole numbers of a batch's vectors, all of one length."""
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(batch.num_rows, -1)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest type that holds it; equal rows are equal bytes."""
    most = np.maximum(x.max(1), -(x.min(1) + 1))
    width = np.searchsorted([1 << 7, 1 << 15, 1 << 31], most, side="right")
    out: list[bytes] = [b""] * len(x)
    for k, kind in enumerate(_KINDS):
        at = np.flatnonzero(width == k)
        raw, size = x[at].astype(kind).tobytes(), x.shape[1] * kind.itemsize
        for i, row in enumerate(at.tolist()):
            out[row] = raw[i * size : (i + 1) * size]
    return out


def unpacked(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of whole numbers from packed ones."""
    rows = column.to_pylist()
    out = np.empty((len(rows), dimensions), np.int64)
    sizes = np.array([len(r) for r in rows])
    for kind in _KINDS:
        at = np.flatnonzero(sizes == dimensions * kind.itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join([rows[i] for i in at]), kind).reshape(len(at), dimensions)
    return out


def _fit_list(rows: DataFrame) -> DataFrame:
    """(x): each distinct packed vector once."""

    def run(batches):
        for part in batches:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(packed(whole(part)), pa.binary())], names=["x"])

    return rows.select("vector").mapInArrow(run, "x binary").distinct()


def _sums(fit: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches):
        n, high, low = 0, np.zeros(dimensions, np.int64), np.zeros(dimensions, np.int64)
        for part in batches:
            x = unpacked(part.column("x"), dimensions)
            n += len(x)
            high += (x >> _HALF).sum(0)
            low += (x & ((1 << _HALF) - 1)).sum(0)
        if n:
            columns = [pa.array(np.arange(dimensions), pa.int32()), pa.array([n] * dimensions, pa.int64()), pa.array(high), pa.array(low)]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "high", "low"])

    parts = fit.mapInArrow(run, "dim int, n long, high long, low long")
    whole_sum = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("decimal(38,0)").alias(c)
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), whole_sum("high"), whole_sum("low")).orderBy("dim").collect()
    return found[0]["n"], [(int(r["high"]) << _HALF) + int(r["low"]) for r in found]


class Centre:
    """The mean of whole-number vectors, taken off exactly but for its fraction."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        near = [(2 * s + n) // (2 * n) for s in sums]
        self.near = np.array(near, np.int64)
        self.fraction = np.array([(s - n * k) / n for s, k in zip(sums, near)])

    def off(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return (x - self.near).astype(np.float64) - self.fraction

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2; null beyond 64 bits."""
        most = self.n * max(int(x.max()), -int(x.min())) + max(map(abs, self.sums))
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _square(r: np.ndarray, dimensions: int) -> np.ndarray:
    """A triangle with rows of zeros below, if it has too few."""
    out = np.zeros((dimensions, dimensions))
    out[: len(r)] = r
    return out


def triangle(fit: DataFrame, centre: Centre, dimensions: int) -> np.ndarray:
    """R of the centred rows: R^T R is n times their covariance."""
    rows_at_once = max(dimensions, BLOCK // dimensions)

    def reduced(batches):
        from pyspark import TaskContext

        r = np.zeros((0, dimensions))
        for part in batches:
            for start in range(0, part.num_rows, rows_at_once):
                x = unpacked(part.column("x").slice(start, rows_at_once), dimensions)
                r = np.linalg.qr(np.concatenate([r, centre.off(x)]), mode="r")
        if len(r):
            yield _triangle(TaskContext.get().partitionId(), _square(r, dimensions))

    def joined(batches):
        for group in groups(batches, ["part"]):
            r = np.zeros((0, dimensions))
            for raw in group.column("r"):
                r = np.linalg.qr(np.concatenate([r, np.frombuffer(raw.as_py()).reshape(dimensions, dimensions)]), mode="r")
            yield _triangle(group.column("part")[0].as_py(), _square(r, dimensions))

    triangles = written(fit.mapInArrow(reduced, "part long, r binary"))
    most = triangles.agg(F.max("part")).first()[0]
    while most:
        most //= FAN
        triangles = triangles.select(F.floor(F.col("part") / FAN).alias("part"), "r")
        triangles = triangles.repartition("part").sortWithinPartitions("part").mapInArrow(joined, "part long, r binary")
    return np.frombuffer(triangles.first()["r"]).reshape(dimensions, dimensions)


def _triangle(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])


def _identity_error(fit: DataFrame, centre: Centre, turn: np.ndarray, dimensions: int) -> float:
    """The largest entry, by size, of the whitened fit list's covariance minus the identity."""
    k = turn.shape[1]
    names = [f"w{i}" for i in range(k)]

    def run(batches):
        for part in batches:
            if part.num_rows:
                w = centre.off(unpacked(part.column("x"), dimensions)) @ turn
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, i])) for i in range(k)], names=names)

    out = fit.mapInArrow(run, ", ".join(f"{c} double" for c in names))
    off = [F.abs(F.covar_pop(names[i], names[j]) - F.lit(float(i == j))) for i in range(k) for j in range(i, k)]
    return out.agg(F.greatest(F.lit(0.0), *off)).first()[0]


_SCHEMA = "component int, n long, deviation long, whitened double"


def whitened(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, ``component`` (from 1, by falling variance), ``n`` (size of the fit list), ``deviation``, ``whitened``,
    ``explained`` (share of all variance) and ``identity_error`` for each row that takes part and each component.

    Runs jobs when called.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, {_SCHEMA}"
    rows = _usable(vectors.select(vectors[key].alias("key"), vectors[vector].alias("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    wide = 0.0
    if lengths:
        dimensions = lengths[0]["d"]
        rows = rows.filter(F.size("vector") == dimensions)
        fit = written(_fit_list(rows))
        centre = Centre(*_sums(fit, dimensions))
        r = triangle(fit, centre, dimensions)
        values, directions = qd.leading(r, components)
        wide = float((r * r).sum())
    if not wide:  # nothing varies
        empty = rows.sparkSession.createDataFrame([], f"{schema}, explained double, identity_error double")
        return empty.withColumnRenamed("key", key)
    some = values > NONE * NONE * values[0]
    values, directions = values[some], directions[:, some]
    turn = directions / np.sqrt(values / centre.n)
    error = _identity_error(fit, centre, turn, dimensions)
    k = len(values)

    def run(batches):
        for part in batches:
            if part.num_rows:
                x = whole(part)
                m = len(x)
                columns = [
                    part.column("key").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, centre.n, np.int64)),
                    pa.array([v for v in centre.deviation(x) for _ in range(k)], pa.int64()),
                    pa.array((centre.off(x) @ turn).ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "n", "deviation", "whitened"])

    shares = F.array(*[F.lit(float(v / wide)) for v in values])
    out = rows.mapInArrow(run, schema)
    return out.withColumns({"explained": F.get(shares, F.col("component") - 1), "identity_error": F.lit(float(error))}).withColumnRenamed("key", key)
