"""Small helpers for Arrow batches inside tasks and for bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20


def chunks(batches, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text each (or one row, if that is longer)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def sampled(df: DataFrame, key: str | list[str], rows: int) -> DataFrame:
    """About ``rows`` rows (all, if there are fewer), chosen by a hash of ``key`` and so the same in every run."""
    keys = [key] if isinstance(key, str) else key
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(1 << 30)) < F.lit(int(rows / total * (1 << 30))))


def unused(name: str, names: list[str]) -> str:
    """``name``, with as many underscores in front as it takes to be none of ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def splits(df: DataFrame, least: int = 1) -> int:
    """Number of shuffle partitions that the session is set to."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal ``keys``, from batches sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.ones(batch.num_rows + 1, bool)
        new[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        edges = np.flatnonzero(new)
        for a, b in zip(edges[:-1], edges[1:]):
            name = tuple(c[a] for c in columns)
            if name != at:
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                at, held = name, []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
