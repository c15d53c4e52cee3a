"""Published fact versions, checked scans of staging and mart tables, mart sinks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import date, datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizdiag.operators.staging import require_unique
from bizdiag.schema import COLUMNS, FACT_SCHEMA, column_type

DATASET = "current"


class QualityBlocked(ValueError):
    """The report holds errors, so nothing is published."""


class PublishConflict(RuntimeError):
    """Another version became current since the number that this one builds on was read."""


def availability_rows(spark: SparkSession, mapped: Mapping[str, str]) -> DataFrame:
    """18 rows: which canonical field is mapped to which source column."""
    rows = [(DATASET, i, f, f in mapped, mapped.get(f)) for i, f in enumerate(COLUMNS)]
    return spark.createDataFrame(
        rows, "dataset_id string, position int, canonical_field string, is_available boolean, source_field string"
    )


def publish_fact(
    df: DataFrame, report: DataFrame, path: str, mapped: Mapping[str, str], after: int | None = None
) -> int:
    """Write fact, metadata and availability as a new version, then make it current.

    ``report`` is the one-row quality report. ``after`` is the number of the version that this one follows
    (``current_number``; by default the one current when the call begins). The version becomes visible only
    with the last write, the manifest of the next number, which is created only if absent: of two writers
    that follow the same version one gets ``PublishConflict``, and what it wrote is deleted. Clocks play no part.
    """
    spark = df.sparkSession
    after = current_number(spark, path) if after is None else after
    verdict = report.select("is_valid", "row_count").first()
    if not verdict["is_valid"]:
        raise QualityBlocked("the quality report holds errors")
    version = uuid.uuid4().hex
    root = f"{path}/versions/{version}"
    # rebalancing splits a month which holds a large share of the rows
    fact = df.select(*[F.col(c).cast(column_type(c)).alias(c) for c in COLUMNS])
    fact = fact.withColumn("month", F.date_format("date", "yyyy-MM")).hint("rebalance", "month")
    try:
        fact.write.partitionBy("month").parquet(f"{root}/fact")
        rows = _read(spark, f"{root}/fact").count()
        if rows != verdict["row_count"]:
            raise ValueError("the report was made for other rows")
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        spark.createDataFrame(
            [(DATASET, rows, now)], "dataset_id string, row_count bigint, loaded_at timestamp_ntz"
        ).write.parquet(f"{root}/metadata")
        availability_rows(spark, mapped).write.parquet(f"{root}/availability")
        _commit(spark, path, after + 1, version)
    except Exception:
        _delete(spark, root)
        raise
    return rows


def _hadoop(spark: SparkSession, path: str):
    """The path's file system and the path as objects of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def current_number(spark: SparkSession, path: str) -> int:
    """Number of the current version; 0 where nothing is published."""
    fs, at = _hadoop(spark, f"{path}/manifests")
    if not fs.exists(at):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def _commit(spark: SparkSession, path: str, number: int, version: str) -> None:
    """Create the manifest of a number, whole or not at all, unless there is one.

    The file is written under a name of its own and renamed without overwriting, which HDFS does in one
    atomic step. On a store that cannot rename so, only one writer at a time is safe.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    # names that begin with a dot are no versions
    fs, draft = _hadoop(spark, f"{path}/manifests/.{version}")
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{number:020d}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), no_options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise PublishConflict(f"version {number} of {path} is already published") from e
        raise


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def _current(spark: SparkSession, path: str) -> str:
    number = current_number(spark, path)
    if not number:
        raise FileNotFoundError(f"nothing is published at {path}")
    return f"{path}/versions/{spark.read.text(f'{path}/manifests/{number:020d}').first()[0]}"


def read_fact(
    spark: SparkSession, path: str, limit: int | None = None, start: date | str | None = None, end: date | str | None = None
) -> DataFrame:
    """Current fact in canonical column order; only the months from ``start`` to ``end`` are opened."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    df = _read(spark, f"{_current(spark, path)}/fact")
    for bound, keeps in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
        if bound is not None:
            df = df.where(keeps(F.col("month"), F.lit(str(bound)[:7])) & keeps(F.col("date"), F.lit(str(bound)).cast("date")))
    df = df.select(*COLUMNS)
    return df if limit is None else df.limit(limit)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Row count and load time of the current version."""
    return _read(spark, f"{_current(spark, path)}/metadata")


def availability(spark: SparkSession, path: str) -> DataFrame:
    """Field availability in schema order; an incomplete table is an error."""
    df = _read(spark, f"{_current(spark, path)}/availability").orderBy("position")
    return checked_availability(df).drop("position")


def checked_availability(df: DataFrame) -> DataFrame:
    """The rows, failing the job when a canonical field is missing."""
    found = df.agg(F.collect_set("canonical_field")).scalar()  # at most the 18 known names
    missing = F.array_except(F.array(*[F.lit(c) for c in COLUMNS]), found)
    return df.where(
        F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("availability lacks: "), F.array_join(missing, ","))))
        .otherwise(F.lit(True))
    )


def available_fields(availability: DataFrame) -> set[str]:
    """Names of the mapped fields (at most 18 values)."""
    return {r[0] for r in availability.where("is_available").select("canonical_field").collect()}


def schema_rows(spark: SparkSession) -> DataFrame:
    """Column, type and nullability of the canonical fact."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(FACT_SCHEMA)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean")


def scan_checked(
    df: DataFrame, required: Sequence[str], unique_key: Sequence[str] = (), name: str = "table"
) -> DataFrame:
    """The rows, when all columns are present and the key is unique."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns: {missing}")
    return require_unique(df, list(unique_key), name) if unique_key else df


# Columns that the readers of a mart need.
_CONTRIBUTION = ("previous_month", "current_month", "previous_amount", "current_amount", "amount_change", "period_status")
MART_COLUMNS = {
    "monthly diagnosis": (
        "month", "previous_month", "purchase_amount", "order_count", "aov", "purchase_amount_change",
        "purchase_amount_change_rate", "order_count_change", "order_count_change_rate", "aov_change",
        "aov_change_rate", "comparison_quality_status",
    ),
    "customer contribution": (*_CONTRIBUTION, "customer_key", "customer_name"),
    "product contribution": (*_CONTRIBUTION, "product_key", "product_name", "mapping_quality_status"),
    "diagnosis facts": (
        "current_period", "previous_period", "fact_rank", "is_core_fact", "output_type", "diagnosis_dimension", "fact_code",
        "fact_text", "evidence_level", "impact_amount", "impact_ratio", "quality_flags", "supporting_data",
    ),
}


def scan_mart(spark: SparkSession, path: str, name: str, unique_key: Sequence[str] = ()) -> DataFrame:
    """A written mart with all columns of its kind (a name in ``MART_COLUMNS``) and a unique key."""
    return scan_checked(spark.read.parquet(path), MART_COLUMNS[name], unique_key, name)


def single_pair(
    df: DataFrame, columns: Sequence[str] = ("previous_period", "current_period"), by: Sequence[str] = ()
) -> DataFrame:
    """The one period pair of a mart, or of each group ``by``; several pairs, or no row at all, fail the job.

    Only the least and the greatest pair of a group are kept, so a group of any size is combined map-side.
    """
    pair = F.struct(*columns)
    found = df.groupBy(*by).agg(F.min(pair).alias("_least"), F.max(pair).alias("_greatest"))
    one = F.when(F.col("_least") == F.col("_greatest"), True)  # NULL for an empty mart
    ok = F.coalesce(one, F.raise_error(F.lit("expected exactly one period pair")).cast("boolean"))
    return found.where(ok).select(*by, "_least.*")


def write_mart(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a mart table; partitions of uneven size are split while writing."""
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
