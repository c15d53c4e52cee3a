import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from bizdiag.functions.lineage import release
    from bizdiag.session import local_session

    session = local_session(8, "bizdiag-tests", "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    release(session)
    session.stop()


@pytest.fixture
def fact(spark):
    """Build a canonical frame from rows of keyword values; text dates and amounts are cast."""
    from pyspark.sql import functions as F

    from bizdiag.schema import COLUMNS, column_type

    def make(rows):
        names = [c for c in COLUMNS if any(c in r for r in rows)]
        schema = ", ".join(f"{c} string" for c in names)
        text = [tuple(None if r.get(c) is None else str(r[c]) for c in names) for r in rows]
        df = spark.createDataFrame(text, schema)
        return df.select(
            *[(F.col(c) if c in names else F.lit(None)).cast(column_type(c)).alias(c) for c in COLUMNS]
        )

    return make
