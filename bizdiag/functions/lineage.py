"""Cutting lineage with tables written to the shared checkpoint folder.

The folder is the session's ``spark.checkpoint.dir``, which a cluster points at storage that all its
nodes share. Where it is unset, the session's warehouse is used, which Spark itself expects to be
shared; on a cluster whose warehouse is a local path there is no shared folder, and that is an error.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Folders written and not yet released, by application.
_held: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables."""
    context = spark.sparkContext
    found = spark.conf.get(_KEY, None) or context.getConf().get(_KEY) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not context.master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
    return f"{warehouse}/bizdiag-intermediate"


def new_folder(spark: SparkSession, prefix: str = "bizdiag") -> str:
    """A new path below the shared folder, held until ``release``."""
    path = f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"
    _held.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a Parquet table: computed once, whatever reads it later.

    Runs a job. The table stays until ``release``, or until the end of the ``scratch`` block around it.
    """
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written so far (all but the first ``since``). Frames that read them end with this."""
    paths = _held.get(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths[since:]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del paths[since:]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own what is written inside the block: it is deleted at its end."""
    before = len(_held.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)
