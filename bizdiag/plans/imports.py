"""Import of an export in one call: read, map, standardise, check, publish."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bizdiag.functions.lineage import scratch, written
from bizdiag.operators import mapping, quality
from bizdiag.sources import files, tables


def publish(s: mapping.Standardised, target: str, fields: Mapping[str, str]) -> int:
    """Check a standardised frame and publish it; its rows are computed once. Returns their number.

    Raises ``tables.QualityBlocked`` when the report holds errors.
    """
    with scratch(s.frame.sparkSession):
        staged = s if s.stored else dataclasses.replace(s, frame=written(s.frame))
        report = written(quality.quality_report(staged))
        return tables.publish_fact(staged.frame, report, target, fields)


def import_csv(spark: SparkSession, source: str, fields: Mapping[str, str], target: str, multiline: bool = False) -> int:
    """Publish the CSV files at ``source`` (UTF-8 or GB18030); ``fields``: canonical name -> source column."""
    raw = files.scan_csv_any_encoding(spark, source, multiline).withColumn("_row", F.monotonically_increasing_id())
    with scratch(spark):
        rows = written(raw)  # row numbers must not change between the checks and the table
        s = mapping.standardise(mapping.apply_mapping(rows, fields, keep=["_row"]), "_row", once=True)
        return publish(s, target, fields)
